"""First sheets of XLSX workbooks. Each workbook is one task's work; a folder is read in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

CELL_SCHEMA = "path string, row_no int, cells map<int,string>, sheets array<string>"


def sheet_rows(files: DataFrame) -> DataFrame:
    """``(path, row_no, cells, sheets)`` for every row of each first sheet."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import datetime as dt
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        office = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
        builtin_dates = set(range(14, 23)) | {45, 46, 47}

        def tree(book: zipfile.ZipFile, name: str):
            return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None

        def text_of(node) -> str:
            return "".join(t.text or "" for t in node.iter(f"{main}t"))

        def column_no(ref: str) -> int:
            n = 0
            for ch in re.match(r"[A-Z]+", ref).group():
                n = n * 26 + ord(ch) - 64
            return n - 1

        def date_styles(book: zipfile.ZipFile) -> set:
            styles = tree(book, "xl/styles.xml")
            if styles is None:
                return set()
            custom = {int(f.get("numFmtId")) for f in styles.iter(f"{main}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))}
            formats = styles.find(f"{main}cellXfs")
            return {i for i, f in enumerate(formats if formats is not None else []) if int(f.get("numFmtId", 0)) in builtin_dates | custom}

        def cell_text(cell, shared: list, dates: set):
            kind, value = cell.get("t"), cell.findtext(f"{main}v")
            if kind == "inlineStr":
                return text_of(cell)
            if value is None:
                return None
            if kind == "s":
                return shared[int(value)]
            if kind == "b":
                return "True" if value == "1" else "False"
            if kind in (None, "n") and int(cell.get("s", 0)) in dates:
                return str(dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(float(value) * 86400)))
            return value

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    names = tree(book, "xl/workbook.xml").findall(f"{main}sheets/{main}sheet")
                    sheets = [s.get("name") for s in names]
                    links = {r.get("Id"): r.get("Target") for r in tree(book, "xl/_rels/workbook.xml.rels")}
                    target = links[names[0].get(office)].lstrip("/")
                    strings = tree(book, "xl/sharedStrings.xml")
                    shared = [] if strings is None else [text_of(s) for s in strings.findall(f"{main}si")]
                    dates = date_styles(book)
                    sheet = tree(book, target if target.startswith("xl/") else f"xl/{target}")
                    rows = []
                    for place, row in enumerate(sheet.iter(f"{main}row")):
                        cells = {column_no(c.get("r")): cell_text(c, shared, dates) for c in row.findall(f"{main}c")}
                        rows.append((path, place, cells, sheets))
                yield pd.DataFrame(rows, columns=["path", "row_no", "cells", "sheets"])

    return files.mapInPandas(parse, CELL_SCHEMA)


def read_workbooks(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, list[str]]:
    """The rows of all first sheets under their header names, and the sheet names of the first file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    rows = sheet_rows(files)
    headers = rows.where("row_no = 0").orderBy("path").select("cells", "sheets").first()
    if headers is None:
        return spark.createDataFrame([], "value string"), []
    names = {place: name or f"column_{place}" for place, name in sorted(headers["cells"].items())}
    table = rows.where("row_no > 0").select(*[F.col("cells")[place].alias(name) for place, name in names.items()])
    return table, list(headers["sheets"])
