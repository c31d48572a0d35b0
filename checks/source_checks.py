"""Readers and sinks, on files written from the given tables."""

from __future__ import annotations

import os
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from assayframe.sources import inspect, readers, sinks
from checks.clean_checks import LOG_LINES, MOMENT, STEPS, cleaning_run
from checks.inputs import dirty_orders, read
from checks.registry import check, dirty, pct, r  # noqa: F401


def scratch(spark: SparkSession) -> str:
    """A new folder in the cluster's shared space, or a temporary one on a single machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{shared or tempfile.gettempdir()}/assayframe-files-{uuid.uuid4().hex}"


CUSTOMER = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"




@check("csv_roundtrip", CUSTOMER)
def _(spark, sf):
    path = scratch(spark)
    sinks.write_csv(read(spark, sf, "customer"), path)
    return readers.load_dataset(spark, path).df


@check("csv_na_tokens", dirty(
    """SELECT order_id, CASE WHEN total IS NULL THEN NULL ELSE total END AS total, email, status, active FROM d"""))
def _(spark, sf):
    path = scratch(spark)
    table = dirty_orders(spark, sf).select("order_id", "total", "email", "status", "active")
    # Gaps are written as different tokens; all must come back as missing.
    marked = table.select(
        "order_id", F.coalesce(F.col("total").cast("string"), F.when(F.crc32("order_id") % 2 == 0, "NaN").otherwise("N/A")).alias("total"),
        F.coalesce("email", F.lit("#N/A")).alias("email"), "status", "active",
    )
    sinks.write_csv(marked, path)
    return readers.read_delimited(spark, path).df


@check("csv_quoted_newlines", "SELECT conv_id, turn, role, text FROM conversations")
def _(spark, sf):
    path = scratch(spark)
    sinks.write_csv(read(spark, sf, "conversations"), path)
    return readers.read_delimited(spark, path, na_tokens=[""]).df


@check("json_records", CUSTOMER)
def _(spark, sf):
    path = scratch(spark)
    # An array per segment and key range: a bounded number of records each.
    customer = read(spark, sf, "customer")
    chunk = F.floor(F.col("c_custkey") / 500).alias("chunk")
    arrays = customer.groupBy(chunk).agg(F.to_json(F.collect_list(F.struct(*customer.columns))).alias("value"))
    arrays.repartitionByRange("chunk").write.partitionBy("chunk").text(path)
    return readers.read_json(spark, path).df.select(*customer.columns)


@check("json_lines", CUSTOMER)
def _(spark, sf):
    path = scratch(spark)
    customer = read(spark, sf, "customer")
    customer.write.json(path)
    return readers.read_json(spark, path).df.select(*customer.columns)


@check("json_columns", CUSTOMER)
def _(spark, sf):
    path = scratch(spark)
    customer = read(spark, sf, "customer")
    chunk = F.floor(F.col("c_custkey") / 500).alias("chunk")
    columns = [
        F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string"), F.col(c)))).alias(c) for c in customer.columns
    ]
    objects = customer.groupBy(chunk).agg(*columns).select("chunk", F.to_json(F.struct(*customer.columns)).alias("value"))
    objects.repartitionByRange("chunk").write.partitionBy("chunk").text(path)
    return readers.read_json(spark, path).df.select(*customer.columns)


FOLDERS = {"comma": ",", "semicolon": ";", "tab": "\t", "pipe": "|"}


@check("delimiter_detect", """SELECT folder, delimiter, files > 0 AS found FROM (VALUES ('comma', ','), ('semicolon', ';'), ('tab', chr(9)), ('pipe', '|')) t(folder, delimiter)
  CROSS JOIN (SELECT count(*) AS files FROM supplier)""")
def _(spark, sf):
    path = scratch(spark)
    for folder, mark in FOLDERS.items():
        read(spark, sf, "supplier").write.option("header", True).option("sep", mark).csv(f"{path}/{folder}")
    folder = F.element_at(F.split("path", "/"), -2).alias("folder")
    found = inspect.detect_delimiters(spark, path).where(F.col("path").endswith(".csv"))
    return found.groupBy(folder, "delimiter").agg((F.count(F.lit(1)) > 0).alias("found"))


@check("delimited_mixed", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(spark, sf):
    path = scratch(spark)
    for folder in ("semicolon", "pipe"):
        read(spark, sf, "supplier").write.option("header", True).option("sep", FOLDERS[folder]).csv(f"{path}/{folder}")
    return readers.read_delimited(spark, path).df


@check("csv_swapped_headers", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 1 THEN c_acctbal END AS c_acctbal FROM customer")
def _(spark, sf):
    path = scratch(spark)
    customer = read(spark, sf, "customer")
    customer.where("c_custkey % 2 = 0").select("c_custkey", "c_name").write.option("header", True).csv(f"{path}/a")
    customer.where("c_custkey % 2 = 1").select("c_acctbal", "c_name", "c_custkey").write.option("header", True).csv(f"{path}/b")
    return readers.load_dataset(spark, path).df.select("c_custkey", "c_name", "c_acctbal")


@check("csv_long_ids", """SELECT 1234567890123456000 + c_custkey AS long_id, CAST(CAST(CAST('98765432109876543210' AS HUGEINT) + c_custkey AS HUGEINT) AS VARCHAR) AS longer_id,
  repeat('7', 40) || CAST(c_custkey AS VARCHAR) AS text_id FROM customer""")
def _(spark, sf):
    path = scratch(spark)
    key = F.col("c_custkey")
    longer = (F.lit("98765432109876543210").cast("decimal(38,0)") + key).cast("decimal(38,0)")
    ids = read(spark, sf, "customer").select((key + 1234567890123456000).alias("long_id"), longer.alias("longer_id"), F.concat(F.repeat(F.lit("7"), 40), key.cast("string")).alias("text_id"))
    sinks.write_csv(ids, path)
    found = readers.load_dataset(spark, path).df
    assert dict(found.dtypes) == {"long_id": "bigint", "longer_id": "decimal(38,0)", "text_id": "string"}
    return found.withColumn("longer_id", F.col("longer_id").cast("string"))


@check("json_mixed_layouts", CUSTOMER)
def _(spark, sf):
    path = scratch(spark)
    customer = read(spark, sf, "customer")
    customer.where("c_custkey % 2 = 0").write.json(f"{path}/lines")
    chunk = F.floor(F.col("c_custkey") / 500).alias("chunk")
    arrays = customer.where("c_custkey % 2 = 1").groupBy(chunk).agg(F.to_json(F.collect_list(F.struct(*customer.columns))).alias("value"))
    arrays.repartitionByRange("chunk").write.partitionBy("chunk").text(f"{path}/arrays")
    return readers.read_json(spark, path).df.select(*customer.columns)


@check("mixed_folder", CUSTOMER)
def _(spark, sf):
    path = scratch(spark)
    customer = read(spark, sf, "customer")
    customer.where("c_custkey % 2 = 0").write.json(f"{path}/json")
    sinks.write_csv(customer.where("c_custkey % 2 = 1"), f"{path}/csv")
    return readers.load_dataset(spark, path).df.select(*customer.columns)


_LATIN = "regexp_matches(text, '[\u00a0-\u00ff]')"


# Eight files for each encoding; a file without a letter beyond ASCII reads as UTF-8.
@check("encoding_class", f"""SELECT folder, CAST(doc_id % 8 AS INTEGER) AS chunk, CASE WHEN folder = 'UTF-8' OR NOT bool_or({_LATIN}) THEN 'utf-8' ELSE 'cp1252' END AS encoding
  FROM documents CROSS JOIN (VALUES ('UTF-8'), ('ISO-8859-1')) AS t(folder) GROUP BY folder, doc_id % 8""")
def _(spark, sf):
    path = scratch(spark)
    chunk = (F.col("doc_id") % 8).cast("int").alias("chunk")
    texts = read(spark, sf, "documents").select(F.regexp_replace("text", r"[^\x00-\xff]|[\x80-\x9f]", "?").alias("text"), chunk).repartitionByRange(8, "chunk")
    for encoding in ("UTF-8", "ISO-8859-1"):
        texts.write.partitionBy("chunk").option("header", True).option("encoding", encoding).option("escape", '"').csv(f"{path}/{encoding}")
    parts = F.split("path", "/")
    found = inspect.inspect_text(spark, path).where(F.col("path").endswith(".csv"))
    return found.select(F.element_at(parts, -3).alias("folder"), F.regexp_extract(F.element_at(parts, -2), r"=(\d+)", 1).cast("int").alias("chunk"), "encoding").distinct()


@check("load_metadata", """SELECT true AS is_file, 'csv' AS "type", 'utf-8' AS encoding, ',' AS delimiter, count(*) AS rows_loaded, true AS all_files, true AS all_bytes, false AS truncated FROM part""")
def _(spark, sf):
    path = scratch(spark)
    sinks.write_csv(read(spark, sf, "part"), path)
    stored = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    seen = readers.load_dataset(spark, path).metadata().crossJoin(F.broadcast(stored))
    return seen.select(
        (F.col("file") == path).alias("is_file"), "type", "encoding", "delimiter", "rows_loaded", (F.col("files") == F.col("n")).alias("all_files"),
        (F.col("size_bytes") == F.col("bytes")).alias("all_bytes"), "truncated")


@check("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def _(spark, sf):
    return readers.preview(read(spark, sf, "orders"), 5, "o_orderkey")


@check("parquet_sink", "SELECT * FROM nation")
def _(spark, sf):
    path = scratch(spark)
    sinks.write_parquet(read(spark, sf, "nation"), path)
    return spark.read.parquet(path)


def write_workbooks(df: DataFrame, path: str, chunk: str) -> None:
    """One small XLSX file per chunk, written by the tasks."""
    columns = [c for c in df.columns if c != chunk]
    system_path = path

    def save(block: pd.DataFrame) -> pd.DataFrame:
        import io
        import zipfile
        from xml.sax.saxutils import escape

        from pyarrow import fs

        def cell(value, column: int, row: int) -> str:
            ref = f"{chr(65 + column)}{row}"
            if isinstance(value, str):
                return f'<c r="{ref}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'
            return f'<c r="{ref}"><v>{value!r}</v></c>'

        lines = [columns] + [[v.item() if hasattr(v, "item") else v for v in line] for line in block[columns].itertuples(index=False)]
        body = "".join(f'<row r="{i}">' + "".join(cell(v, j, i) for j, v in enumerate(line)) + "</row>" for i, line in enumerate(lines, 1))
        main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        office = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as book:
            book.writestr("xl/workbook.xml", f'<workbook {main} {office}><sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>')
            book.writestr(
                "xl/_rels/workbook.xml.rels",
                '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml" Type="worksheet"/></Relationships>',
            )
            book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
        local = system_path if "://" in system_path else os.path.abspath(system_path)
        system, root = fs.FileSystem.from_uri(local)
        system.create_dir(root, recursive=True)
        name = f"{root}/part-{int(block[chunk].iloc[0])}.xlsx"
        with system.open_output_stream(name) as out:
            out.write(buffer.getvalue())
        return pd.DataFrame({"name": [name]})

    df.groupBy(chunk).applyInPandas(save, "name string").write.format("noop").mode("overwrite").save()


@check("xlsx_first_sheet", CUSTOMER)
def _(spark, sf):
    path = scratch(spark)
    write_workbooks(read(spark, sf, "customer").withColumn("chunk", F.floor(F.col("c_custkey") / 500)), path, "chunk")
    return readers.read_workbooks(spark, path)[0].transform(readers.infer_types)


@check("load_capped", "SELECT least(count(*), 50) AS rows_loaded, count(*) > 50 AS truncated FROM part")
def _(spark, sf):
    path = scratch(spark)
    sinks.write_csv(read(spark, sf, "part"), path)
    return readers.load_dataset(spark, path, max_rows=50).metadata().select("rows_loaded", "truncated")


@check("log_sink", dirty(f"SELECT operation, columns, detail, rows_affected, 'applied' AS status FROM ({LOG_LINES})", *STEPS))
def _(spark, sf):
    path = scratch(spark)
    sinks.write_log(cleaning_run(spark, sf).log(MOMENT).select("operation", "columns", "detail", "rows_affected", "status"), path)
    return readers.load_dataset(spark, path).df.withColumn("columns", F.coalesce("columns", F.lit("")))


# -- row numbers ---------------------------------------------------------------------------


@check("csv_row_numbers", "SELECT row_number() OVER (ORDER BY o_orderkey) AS _row_id, o_orderkey, o_custkey FROM orders")
def _(spark, sf):
    path = scratch(spark)
    sinks.write_csv(read(spark, sf, "orders").select("o_orderkey", "o_custkey").repartitionByRange(7, "o_orderkey").sortWithinPartitions("o_orderkey"), path)
    return readers.load_dataset(spark, path, with_row_id=True).df
