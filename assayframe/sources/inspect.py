"""Finding out encoding, delimiter and layout of files before reading them.

The head of each file is read inside tasks, and one distributed scan of the raw
lines checks the whole text, so no file passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Delimiter candidates, earlier ones win ties.
DELIMITERS = [",", ";", "\t", "|"]
HEAD_BYTES = 65_536

# Bytes that windows-1252 leaves undefined; text holding them is read as latin-1.
CP1252_GAPS = "81|8D|8F|90|9D"


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, size)`` of the files; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"))


def file_heads(files: DataFrame) -> DataFrame:
    """``(path, size, head)``: the first bytes of each file, the whole first line among them, read by the tasks."""

    def read_heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.parse import unquote, urlparse

        from pyarrow import fs

        for batch in batches:
            heads = []
            for location in batch["path"]:
                parts = urlparse(location)
                if parts.scheme in ("", "file"):
                    system, name = fs.LocalFileSystem(), unquote(parts.path)
                else:
                    system, name = fs.FileSystem.from_uri(location)
                with system.open_input_file(name) as stream:
                    head = stream.read(HEAD_BYTES)
                    # on to the end of the first line, however long it is
                    while not (b"\n" in head or b"\r" in head) and (more := stream.read(HEAD_BYTES)):
                        head += more
                    heads.append(head)
            yield batch.assign(head=heads)

    return files.mapInPandas(read_heads, "path string, size bigint, head binary")


def best_delimiter(line: Column) -> Column:
    """The candidate that occurs most often in the line."""
    counts = F.array(*[
        F.struct((F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))).alias("n"), F.lit(-i).alias("place"), F.lit(d).alias("delimiter"))
        for i, d in enumerate(DELIMITERS)
    ])
    return F.array_max(counts)["delimiter"]


def _mark(head: Column) -> Column:
    """Encoding told by a byte order mark."""
    start = F.hex(F.substring(head, 1, 3))
    return F.when(start.startswith("EFBBBF"), "utf-8").when(start.startswith("FFFE") | start.startswith("FEFF"), "utf-16")


def first_lines(heads: DataFrame) -> DataFrame:
    """``(path, header, delimiter)`` from the first line of each file."""
    text = F.when(_mark(F.col("head")) == "utf-16", F.decode("head", "UTF-16")).otherwise(F.decode("head", "ISO-8859-1"))
    first = F.element_at(F.split(text, r"\r\n|\r|\n", 2), 1)
    return heads.select("path", first.alias("header"), best_delimiter(first).alias("delimiter"))


def detect_delimiters(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, delimiter)`` from the first line of each file."""
    return first_lines(file_heads(list_files(spark, path))).select("path", "delimiter")


def inspect_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, size, encoding, delimiter, header, quoted_newlines)`` of each text file.

    A file is UTF-8 when every raw line is valid UTF-8, else windows-1252 or
    latin-1. A line with an odd number of quotes means that quoted fields run
    over line ends.
    """
    read = file_heads(list_files(spark, path))
    heads = read.select("path", "size", _mark(F.col("head")).alias("mark"))
    raw = F.col("value")
    hexed = F.hex(raw.cast("binary"))
    lines = (
        spark.read.option("recursiveFileLookup", "true").text(path)
        .select(F.col("_metadata.file_path").alias("path"), raw)
        .groupBy("path")
        .agg(
            F.bool_and(F.is_valid_utf8(raw)).alias("utf8"),
            F.coalesce(F.bool_or(F.when(~F.is_valid_utf8(raw), hexed.rlike(f"^(..)*({CP1252_GAPS})"))), F.lit(False)).alias("gaps"),
            F.bool_or(F.when(F.is_valid_utf8(raw), (F.length(raw) - F.length(F.replace(raw, F.lit('"'), F.lit("")))) % 2 == 1)).alias("open_quotes"),
        )
    )
    guess = F.when(F.coalesce("utf8", F.lit(True)), "utf-8").when(F.col("gaps"), "latin-1").otherwise("cp1252")
    return (
        heads.join(lines, "path", "left")
        .join(first_lines(read), "path")
        .select("path", "size", F.coalesce("mark", guess).alias("encoding"), "delimiter", "header",
                F.coalesce("open_quotes", F.lit(False)).alias("quoted_newlines"))
    )
