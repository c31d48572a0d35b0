"""Missing cells: per column, in total, and as a mask."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayframe.functions.coerce import percent, rounded
from assayframe.operators.kinds import hash_sample
from assayframe.plans.facts import Facts
from assayframe.plans.wide import long_aggregate


def _counts(facts: Facts) -> DataFrame:
    entries = [
        ({"pos": i, "column": c}, {"rows": F.count(F.lit(1)), "missing": F.count_if(facts.col(c).isNull())})
        for i, c in enumerate(facts.columns)
    ]
    return long_aggregate(facts.table, entries)


def missing_by_column(table: Facts | DataFrame) -> DataFrame:
    """``(column, missing, missing_pct)``, most missing first."""
    facts = Facts.of(table)
    return (
        _counts(facts)
        .orderBy(F.desc("missing"), "pos")
        .select("column", "missing", F.coalesce(percent(F.col("missing"), F.col("rows")), F.lit(0.0)).alias("missing_pct"))
    )


def missing_totals(table: Facts | DataFrame) -> DataFrame:
    """Total and missing cells, their share, completeness, and how many columns have gaps."""
    facts = Facts.of(table)
    totals = _counts(facts).agg(
        F.sum("rows").alias("total_cells"),
        F.sum("missing").alias("total_missing"),
        F.count_if(F.col("missing") > 0).alias("columns_with_missing"),
    )
    filled = F.col("total_cells") - F.col("total_missing")
    return totals.select(
        "total_cells",
        "total_missing",
        F.coalesce(percent(F.col("total_missing"), F.col("total_cells")), F.lit(0.0)).alias("overall_pct"),
        F.coalesce(percent(filled, F.col("total_cells")), F.lit(100.0)).alias("completeness_pct"),
        "columns_with_missing",
    )


def missing_columns(table: Facts | DataFrame) -> DataFrame:
    """The columns that have at least one missing cell."""
    return missing_by_column(table).where(F.col("missing") > 0)


def missing_mask(table: Facts | DataFrame, keep_in: int = 1) -> DataFrame:
    """0/1 mask of every cell next to the order column; ``keep_in`` samples one row in so many."""
    facts = Facts.of(table)
    if facts.order_by is None:
        raise ValueError("a mask needs an order column to name its rows")
    rows = facts.table if keep_in <= 1 else hash_sample(facts.table, facts.order_by, keep_in)
    return rows.select(
        facts.order_by, *[facts.col(c).isNull().cast("int").alias(c) for c in facts.columns]
    )


def co_missing(table: Facts | DataFrame) -> DataFrame:
    """Rows per combination of missing columns, and the share of all rows."""
    facts = Facts.of(table)
    names = F.concat_ws(", ", *[F.when(facts.col(c).isNull(), F.lit(c)) for c in facts.columns])
    total = facts.table.agg(F.count(F.lit(1)).alias("rows")).scalar()
    return (
        facts.table.groupBy(names.alias("missing_columns"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("missing_columns", "n", rounded(100.0 * F.col("n") / total, 2).alias("share_pct"))
    )
