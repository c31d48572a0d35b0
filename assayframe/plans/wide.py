"""One scan, many columns: a wide aggregate turned into one row per column."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Expressions per aggregate. Larger ones generate methods that the JVM does not compile, which
# costs more than reading further columns in a scan of their own.
MAX_EXPRESSIONS = 40


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def long_aggregate(df: DataFrame, entries: list[tuple[dict, dict]], types: dict[str, str] | None = None) -> DataFrame:
    """Aggregate ``df`` once and return one row per entry.

    Each entry is ``(labels, aggregates)``: literal columns and aggregate
    expressions. ``types`` names aggregates that an entry may leave out; they
    are NULL there and cost nothing. Entries are aggregated in
    blocks of ``MAX_EXPRESSIONS``; column pruning keeps the scan of each block
    to its own columns, so a columnar source is still read about once.
    """
    names = list(dict.fromkeys(name for _, aggs in entries for name in aggs))
    names = list(types) if types else names
    parts = []
    for block in _blocks(entries):
        row = df.agg(
            *[
                expr.alias(f"e{i}_{name}")
                for i, (_, aggs) in enumerate(block)
                for name, expr in aggs.items()
            ]
        )
        # Built as one SQL text: per-field Column calls would cost more than the query on small tables.
        rows = [
            "named_struct("
            + ", ".join(
                [f"'{k}', {sql_literal(v)}" for k, v in labels.items()]
                + [f"'{n}', " + (f"e{i}_{n}" if n in aggs else f"CAST(NULL AS {types[n]})") for n in names]
            )
            + ")"
            for i, (labels, aggs) in enumerate(block)
        ]
        parts.append(row.selectExpr(f"inline(array({', '.join(rows)}))"))
    return union_all(parts)


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few driver-side rows as a table whose size the optimizer knows.

    Rows made into an RDD have no known size, so joins with them would shuffle.
    """
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    names = ", ".join(f"`{n}`" for n, _ in fields)
    typed = ", ".join(f"CAST(`{n}` AS {t}) AS `{n}`" for n, t in fields)
    values = ", ".join("(" + ", ".join(map(sql_literal, row)) + ")" for row in rows) or "(" + ", ".join("NULL" for _ in fields) + ")"
    return spark.sql(f"SELECT {typed} FROM VALUES {values} AS t({names})" + ("" if rows else " WHERE false"))


def sql_literal(value: str | int | float | dt.datetime | None) -> str:
    """SQL text of a Python scalar."""
    if value is None:
        return "NULL"
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    return str(value)


def _blocks(entries: list[tuple[dict, dict]]) -> list[list[tuple[dict, dict]]]:
    blocks, size = [[]], 0
    for entry in entries:
        if size and size + len(entry[1]) > MAX_EXPRESSIONS:
            blocks.append([])
            size = 0
        blocks[-1].append(entry)
        size += len(entry[1])
    return blocks


def unpivot_text(df: DataFrame, views: dict[str, Column]) -> DataFrame:
    """``(column, value)`` for every non-null cell of the given text views."""
    cells = F.array(
        *[F.struct(F.lit(name).alias("column"), view.alias("value")) for name, view in views.items()]
    )
    return df.select(F.inline(cells)).where(F.col("value").isNotNull())
