"""Loading files or whole folders into one table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayframe.functions.coerce import as_text
from assayframe.plans.durable import durable
from assayframe.sources.inspect import file_heads, inspect_text, list_files
from assayframe.sources.typing import blank_tokens, infer_types
from assayframe.sources.workbook import read_workbooks

ROW_ID = "_row_id"
# Splits whose offsets are broadcast, at most.
BROADCAST_SPLITS = 100_000

# Reader per file extension; others are read as delimited text.
READERS = {".csv": "csv", ".txt": "csv", ".tsv": "csv", ".xlsx": "xlsx", ".xls": "xls", ".json": "json"}

# Names Spark knows the encodings by.
SPARK_CHARSETS = {"latin-1": "ISO-8859-1", "utf-8": "UTF-8", "utf-16": "UTF-16", "cp1252": "windows-1252"}


@dataclass
class Loaded:
    """A loaded table and what is known about its files."""

    df: DataFrame
    file_name: str
    file_type: str
    encoding: str | None = None
    delimiter: str | None = None
    truncated: bool = False
    files: int = 0
    size_bytes: int = 0
    messages: tuple[str, ...] = ()

    def metadata(self) -> DataFrame:
        """One row describing the load; the row count is part of the plan."""
        return self.df.agg(F.count(F.lit(1)).alias("rows_loaded")).select(
            F.lit(self.file_name).alias("file"), F.lit(self.file_type).alias("type"), F.lit(self.encoding).cast("string").alias("encoding"),
            F.lit(self.delimiter).cast("string").alias("delimiter"), "rows_loaded", F.lit(self.files).cast("bigint").alias("files"),
            F.lit(self.size_bytes).cast("bigint").alias("size_bytes"), F.lit(self.truncated).alias("truncated"),
        )


def _with_row_id(df: DataFrame) -> DataFrame:
    """Order key of a row: file, block in the file, position in the block."""
    key = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    return df.select("*", key.alias(ROW_ID))


def numbered_rows(df: DataFrame) -> DataFrame:
    """``df`` with its order key turned into dense row numbers from 1: files by path, rows as they stand in them.

    The splits are counted, one row each, and every row's number follows from its place in its split and the rows before
    the split; no row moves.
    """
    file, block, place = (F.col(f"{ROW_ID}.{name}") for name in ("file", "block", "place"))
    splits = sorted(tuple(r) for r in df.groupBy(file.alias("file"), block.alias("block")).agg(F.min(place).alias("first"), F.count("*").alias("n")).collect())
    before = [0, *accumulate(n for *_, n in splits)]
    rows = [(f, b, first, k) for (f, b, first, _), k in zip(splits, before)]
    offsets = df.sparkSession.createDataFrame(rows, "_file string, _block long, _first long, _before long")
    side = F.broadcast(offsets) if len(rows) <= BROADCAST_SPLITS else offsets
    joined = df.join(side, (file == F.col("_file")) & (block == F.col("_block")))
    return joined.withColumn(ROW_ID, F.col("_before") + place - F.col("_first") + 1).drop("_file", "_block", "_first", "_before")


def _spark_charset(spark: SparkSession, encoding: str) -> str:
    charset = SPARK_CHARSETS.get(encoding.lower(), encoding)
    if charset == "windows-1252" and spark.conf.get("spark.sql.legacy.javaCharsets", "false") != "true":
        # The reader only takes this charset in legacy mode. Latin-1 differs from it in 0x80-0x9F;
        # those cells are put right afterwards.
        return "ISO-8859-1"
    return charset


# What the bytes 0x80-0x9F mean in windows-1252, where defined.
CP1252_HIGH = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š",
    0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—",
    0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}


def _as_cp1252(df: DataFrame) -> DataFrame:
    source, target = "".join(map(chr, CP1252_HIGH)), "".join(CP1252_HIGH.values())
    views = {c: F.translate(F.col(f"`{c}`"), source, target) for c, t in df.dtypes if t == "string"}
    renamed = {c: c.translate(CP1252_HIGH) for c in df.columns}
    return df.withColumns(views).withColumnsRenamed(renamed)


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    encoding: str | None = None,
    delimiter: str | None = None,
    na_tokens: list[str] | None = None,
    with_row_id: bool = False,
) -> Loaded:
    """Read delimited text with a header, finding encoding, delimiter and columns per file.

    Files with the same header and form are read together, others are matched by
    column name. Only files whose quoted fields run over line ends, or that are
    UTF-16, are read unsplit. File names reach the driver only if files differ.
    """
    found = durable(inspect_text(spark, path))
    form = ["encoding", "delimiter", "quoted_newlines", "header"]
    sizes = found.groupBy(*form).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size")).orderBy(*form).collect()
    groups = [g.asDict() for g in sizes]
    for g in groups:
        same = F.lit(True)
        for c in form:
            same = same & F.col(c).eqNullSafe(F.lit(g[c]))
        g["paths"] = path if len(groups) == 1 else [r["path"] for r in found.where(same).select("path").orderBy("path").collect()]
    parts = []
    for g in groups:
        use_encoding, use_delimiter = encoding or g["encoding"], delimiter or g["delimiter"]
        unsplit = g["quoted_newlines"] or use_encoding.lower().startswith("utf-16")
        part = (
            spark.read.option("header", True).option("recursiveFileLookup", "true").option("sep", use_delimiter).option("encoding", _spark_charset(spark, use_encoding))
            .option("multiLine", unsplit).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
            .csv(g["paths"])
        )
        part = _with_row_id(part) if with_row_id else part
        if use_encoding.lower() == "cp1252" and _spark_charset(spark, use_encoding) != "windows-1252":
            part = _as_cp1252(part)
        parts.append(part)
    df = infer_types(blank_tokens(by_name(parts), na_tokens))
    encodings = sorted({encoding or g["encoding"] for g in groups})
    delimiters = sorted({delimiter or g["delimiter"] for g in groups})
    return Loaded(
        df, str(path), "csv", "|".join(encodings) if len(encodings) > 1 else encodings[0],
        delimiters[0] if len(delimiters) == 1 else None, files=sum(g["files"] for g in groups), size_bytes=sum(g["size"] for g in groups),
    )


def by_name(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts, matched by column name; columns whose types differ become text."""
    types: dict[str, set[str]] = {}
    for part in parts:
        for c, t in part.dtypes:
            types.setdefault(c, set()).add(t)
    mixed = {c for c, t in types.items() if len(t) > 1}
    texts = [part.withColumns({c: as_text(F.col(f"`{c}`"), part.schema[c].dataType) for c in part.columns if c in mixed}) for part in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), texts)


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON arrays of records, or single objects over several lines."""
    return spark.read.option("multiLine", True).option("recursiveFileLookup", "true").json(path)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One JSON record per line."""
    return spark.read.option("recursiveFileLookup", "true").json(path)


def read_columns(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Column-oriented JSON: ``{"a": {"0": 1, "1": 2}, "b": {...}}``."""
    whole = spark.read.option("wholetext", True).option("recursiveFileLookup", "true").text(path)
    parsed = whole.select(
        F.col("_metadata.file_path").alias("file"), F.from_json("value", "map<string, map<string, string>>").alias("columns")
    )
    cells = parsed.select("file", F.explode("columns").alias("column", "cells")).select("file", "column", F.explode("cells").alias("key", "cell"))
    names = [r["column"] for r in cells.select("column").distinct().orderBy("column").collect()]
    rows = cells.groupBy("file", "key").pivot("column", names).agg(F.first("cell"))
    return infer_types(rows.orderBy("file", F.expr("try_cast(key AS BIGINT)"), "key").drop("file", "key"))


def json_layouts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, size, layout)`` of each file: ``records``, ``columns`` or ``lines``, told from its head."""
    text = F.trim(F.regexp_replace(F.decode("head", "UTF-8"), "^\ufeff", ""))
    layout = (
        F.when(text.rlike(r"^\s*\["), "records")
        .when(text.rlike(r'^\s*\{\s*"(\\.|[^"\\])*"\s*:\s*\{\s*"-?\d+"\s*:'), "columns")
        .when(text.rlike(r"^\s*\{[^\n]*\}\s*(\n|$)"), "lines")
        .otherwise("records")
    )
    return file_heads(list_files(spark, path)).select("path", "size", layout.alias("layout"))


def json_layout(spark: SparkSession, path: str | list[str]) -> str:
    """The layout of one file."""
    row = json_layouts(spark, path).orderBy("path").first()
    return row["layout"] if row else "records"


def read_json(spark: SparkSession, path: str | list[str]) -> Loaded:
    """Read JSON files of the three layouts, each file by its own."""
    readers = {"records": read_records, "columns": read_columns, "lines": read_lines}
    found = durable(json_layouts(spark, path))
    groups = found.groupBy("layout").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size")).orderBy("layout").collect()
    parts = [
        readers[g["layout"]](spark, path if len(groups) == 1 else [r["path"] for r in found.where(F.col("layout") == g["layout"]).select("path").orderBy("path").collect()])
        for g in groups
    ]
    return Loaded(
        by_name(parts) if parts else read_records(spark, path), str(path), "json", "utf-8",
        files=sum(g["files"] for g in groups), size_bytes=sum(g["size"] for g in groups))


def read_sheets(spark: SparkSession, path: str | list[str]) -> Loaded:
    """Read workbooks, the first sheet of each."""
    df, sheets = read_workbooks(spark, path)
    totals = list_files(spark, path).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size")).first()
    note = (f"Workbook has sheets: {', '.join(sheets[:10])}",)
    return Loaded(infer_types(blank_tokens(df)), str(path), "xlsx", files=totals["files"], size_bytes=totals["size"] or 0, messages=note)


def load_dataset(
    spark: SparkSession,
    path: str,
    encoding: str | None = None,
    delimiter: str | None = None,
    max_rows: int | None = None,
    with_row_id: bool = False,
) -> Loaded:
    """Read a file, or every file of a folder by its own extension; nothing is cut unless ``max_rows`` is given.

    ``with_row_id`` adds ``_row_id``, the number of each row in the order of files and lines, for operators that need an
    order; delimited files only.
    """
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kinds = F.coalesce(*[F.when(suffix == s, kind) for s, kind in READERS.items()], F.lit("csv"))
    files = list_files(spark, path).select("path", kinds.alias("kind"))
    found = sorted(r["kind"] for r in files.select("kind").distinct().collect()) or ["csv"]
    if "xls" in found:
        raise ValueError("binary .xls workbooks cannot be read; save them as .xlsx or .csv")
    if with_row_id and found != ["csv"]:
        raise ValueError("row numbers need delimited files")
    parts = []
    for kind in found:
        where = path if len(found) == 1 else [r["path"] for r in files.where(F.col("kind") == kind).select("path").orderBy("path").collect()]
        parts.append(read_json(spark, where) if kind == "json" else read_sheets(spark, where) if kind == "xlsx" else read_delimited(spark, where, encoding, delimiter, with_row_id=with_row_id))
    loaded = parts[0]
    if with_row_id:
        loaded.df = numbered_rows(loaded.df)
    if len(parts) > 1:
        known = lambda name: "|".join(sorted({v for p in parts if (v := getattr(p, name))})) or None
        loaded = Loaded(
            by_name([p.df for p in parts]), path, "|".join(found), known("encoding"), known("delimiter"),
            files=sum(p.files for p in parts), size_bytes=sum(p.size_bytes for p in parts), messages=tuple(m for p in parts for m in p.messages))
    if max_rows is not None:
        loaded.truncated = loaded.df.limit(max_rows + 1).count() > max_rows
        loaded.df = loaded.df.limit(max_rows)
    return loaded


def preview(df: DataFrame, rows: int = 5, order_by: str | None = None) -> DataFrame:
    """The first rows, by the given order if there is one."""
    return (df.orderBy(order_by) if order_by else df).limit(rows)
