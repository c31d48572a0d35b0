"""Duplicate rows: counts, previews and removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayframe.functions.coerce import as_text, is_nested, percent
from assayframe.plans.duplicates import duplicate_groups, repeated_rows, row_fingerprint, without_nan
from assayframe.plans.facts import Facts


def duplicate_summary(table: Facts | DataFrame) -> DataFrame:
    """Rows beyond the first of each identical row, their share, and the shape without them.

    Rows count as identical if two independent 64-bit hashes of all cells agree.
    """
    facts = Facts.of(table)
    # sixteen bytes stand for a row: no payload is shuffled, copies fold on the map side
    groups = facts.table.select(*row_fingerprint(facts.table, facts.columns)).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    counted = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))
    return counted.select(
        F.col("surplus").alias("duplicate_rows"),
        F.coalesce(percent(F.col("surplus"), F.col("rows")), F.lit(0.0)).alias("share_pct"),
        (F.col("rows") - F.col("surplus")).alias("rows_after"),
        F.lit(len(facts.columns)).alias("columns_after"),
    )


def duplicate_preview(table: Facts | DataFrame, top: int = 20) -> DataFrame:
    """The first rows (by the order column) that repeat an earlier row."""
    facts = Facts.of(table)
    order = facts.order_by
    if order is None:
        raise ValueError("a preview of later copies needs an order column")
    groups = duplicate_groups(facts.table, facts.columns, {"_first": F.min(order)}).select("_hash", "_first", *facts.columns)
    rows = repeated_rows(facts.table, facts.columns).alias("r")
    groups = groups.alias("g")
    same = F.col("r._hash") == F.col("g._hash")
    for c in facts.columns:
        same = same & F.col(f"r.`{c}`").eqNullSafe(F.col(f"g.`{c}`"))
    later = rows.join(groups, same & (F.col(f"r.{order}") > F.col("g._first")))
    return later.select(f"r.{order}", *[F.col(f"r.`{c}`") for c in facts.columns]).orderBy(order).limit(top)


def deduplicated_preview(table: Facts | DataFrame, top: int = 20) -> DataFrame:
    """The first rows (by the order column) once later copies are removed."""
    facts = Facts.of(table)
    kept = drop_duplicates(facts.table, facts.columns, order_by=facts.order_by)
    return kept.orderBy(facts.order_by).limit(top)


def drop_duplicates(df: DataFrame, subset: list[str] | None = None, order_by: str | None = None) -> DataFrame:
    """Keep one row per identical key.

    With ``order_by`` the earliest row is kept. That is an aggregate, not a
    window, so copies collapse on the map side and a hot key never fills a task.
    Without it any representative does, which for whole rows is the same thing.
    """
    keys = subset if subset is not None else [c for c in df.columns if c != order_by]
    nested = [k for k in keys if is_nested(df.schema[k].dataType)]
    clean = without_nan(df)
    if order_by is None and not nested:
        return df.dropDuplicates(subset)
    # nested cells are compared as canonical text, and come back as they are
    views = [as_text(F.col(f"`{k}`"), df.schema[k].dataType).alias(f"k{i}") if k in nested else F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys or c in nested])
    row = F.any_value(whole) if order_by is None else F.min_by(whole, f"`{order_by}`")
    earliest = clean.groupBy(*views).agg(row.alias("row"))
    place = {k: f"k{i}" for i, k in enumerate(keys) if k not in nested}
    return earliest.select(*[(F.col(place[c]) if c in place else F.col("row")[c]).alias(c) for c in df.columns])


def duplicates_removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many rows a deduplication removed."""
    left = after.agg(F.count(F.lit(1)).alias("n")).scalar()
    return before.agg(F.count(F.lit(1)).alias("rows_before")).select(
        "rows_before", left.alias("rows_after"), (F.col("rows_before") - left).alias("removed")
    )
