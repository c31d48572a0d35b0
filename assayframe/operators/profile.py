"""Column profile: counts, moments, extremes, modes and row order facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayframe.functions.coerce import percent, rounded
from assayframe.functions.stats import sample_kurtosis, sample_skewness
from assayframe.operators.kinds import KIND_TYPES, kinds_frame
from assayframe.plans.facts import Facts
from assayframe.plans.wide import long_aggregate, small_frame

PROFILE_COLUMNS = [
    "column", "inferred_dtype", "count", "unique", "missing", "missing_pct", "mean", "std", "min", "max",
    "skew", "kurtosis", "mode", "earliest", "latest", "true_share", "first", "last",
]


def column_counts(table: Facts | DataFrame) -> DataFrame:
    """``(column, inferred_dtype, count, unique, missing, missing_pct)`` per column."""
    facts = Facts.of(table)
    entries = [
        ({"pos": i, "column": c, "inferred_dtype": facts.dtype(c).simpleString()},
         {"rows": F.count(F.lit(1)), "count": F.count(facts.col(c))})
        for i, c in enumerate(facts.columns)
    ]
    counts = long_aggregate(facts.table, entries)
    distinct = facts.counts(facts.columns).groupBy("column").agg(F.count(F.lit(1)).alias("unique"))
    return (
        counts.join(distinct, "column", "left")
        .select(
            "pos", "column", "inferred_dtype", "count",
            F.coalesce("unique", F.lit(0)).alias("unique"),
            (F.col("rows") - F.col("count")).alias("missing"),
            percent(F.col("rows") - F.col("count"), F.col("rows")).alias("missing_pct"),
        )
        .orderBy("pos")
    )


def numeric_moments(table: Facts | DataFrame) -> DataFrame:
    """Mean, spread, extremes and corrected shape of every numerical column."""
    facts = Facts.of(table)
    entries = []
    for c in facts.numeric:
        x = facts.number(c)
        entries.append((
            {"column": c},
            {"n": F.count(x), "m": F.avg(x), "s": F.stddev_samp(x), "min": F.min(x), "max": F.max(x),
             "g1": F.skewness(x), "g2": F.kurtosis(x)},
        ))
    if not entries:
        return small_frame(facts.df.sparkSession, [], "column string, mean double, std double, min double, max double, skew double, kurtosis double"
        )
    # Merging the partial moments of a constant column may leave rounding noise.
    varied = F.col("min") < F.col("max")
    return long_aggregate(facts.df, entries).select(
        "column",
        rounded(F.col("m"), 3).alias("mean"),
        F.when(F.col("n") > 1, F.when(varied, rounded(F.col("s"), 4)).otherwise(0.0)).alias("std"),
        "min",
        "max",
        F.when(F.col("n") > 3, rounded(sample_skewness(F.when(varied, F.col("g1")), F.col("n")), 3)).alias("skew"),
        rounded(sample_kurtosis(F.when(varied, F.col("g2")), F.col("n")), 3).alias("kurtosis"),
    )


def first_last(table: Facts | DataFrame, order_by: str | None = None) -> DataFrame:
    """First and last non-null cell of every column by the given order."""
    facts = Facts.of(table)
    order_by = order_by or facts.order_by
    if order_by is None:
        raise ValueError("first and last values need an order column")
    order = F.col(f"`{order_by}`")
    entries = []
    for i, c in enumerate(facts.columns):
        text = facts.text(c)
        known = F.when(text.isNotNull(), order)
        entries.append(({"pos": i, "column": c}, {"first": F.min_by(text, known), "last": F.max_by(text, known)}))
    return long_aggregate(facts.table, entries).select("column", "first", "last")


def modal_values(table: Facts | DataFrame) -> DataFrame:
    """Most frequent value of every categorical column, the smallest one on ties."""
    facts = Facts.of(table)
    return (
        facts.counts(facts.of_kind("categorical"))
        .groupBy("column")
        .agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
    )


def datetime_ranges(table: Facts | DataFrame) -> DataFrame:
    """Earliest and latest parsed timestamp of every datetime column."""
    facts = Facts.of(table)
    entries = []
    for c in facts.of_kind("datetime"):
        ts = facts.timestamp(c)
        entries.append(({"column": c}, {"earliest": F.min(ts), "latest": F.max(ts)}))
    if not entries:
        return small_frame(facts.df.sparkSession, [], "column string, earliest timestamp_ntz, latest timestamp_ntz")
    return long_aggregate(facts.df, entries)


def boolean_shares(table: Facts | DataFrame) -> DataFrame:
    """Share of true cells of every boolean column."""
    facts = Facts.of(table)
    entries = [({"column": c}, {"share": F.avg(facts.boolean(c).cast("int"))}) for c in facts.of_kind("boolean")]
    if not entries:
        return small_frame(facts.df.sparkSession, [], "column string, true_share double")
    return long_aggregate(facts.df, entries).select("column", rounded(F.col("share"), 3).alias("true_share"))


def profile(table: Facts | DataFrame) -> DataFrame:
    """The full column profile; ``first``/``last`` stay NULL without an order column."""
    facts = Facts.of(table)
    if facts.rows == 0:
        raise ValueError("cannot profile an empty table")
    out = column_counts(facts)
    for part in (numeric_moments, modal_values, datetime_ranges, boolean_shares):
        out = out.join(part(facts), "column", "left")
    if facts.order_by:
        out = out.join(first_last(facts), "column", "left")
    else:
        out = out.withColumns({"first": F.lit(None).cast("string"), "last": F.lit(None).cast("string")})
    return out.orderBy("pos").select(*PROFILE_COLUMNS)


def shape(table: Facts | DataFrame) -> DataFrame:
    """Rows, columns and columns per kind in one row."""
    facts = Facts.of(table)
    per_kind = [F.lit(len(facts.of_kind(k))).alias(f"n_{k}") for k in KIND_TYPES]
    return facts.table.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(facts.columns)).alias("n_cols"), *per_kind
    )


def kind_counts(table: Facts | DataFrame) -> DataFrame:
    """Columns per kind, every kind listed."""
    facts = Facts.of(table)
    every = small_frame(facts.df.sparkSession, [(k,) for k in KIND_TYPES], "kind string")
    found = kinds_frame(facts.df, facts.kinds).groupBy("kind").agg(F.count(F.lit(1)).alias("found"))
    return every.join(found, "kind", "left").select("kind", F.coalesce("found", F.lit(0)).alias("n_columns"))


def dtype_counts(table: Facts | DataFrame) -> DataFrame:
    """Columns per physical type."""
    facts = Facts.of(table)
    rows = [(facts.dtype(c).simpleString(),) for c in facts.columns]
    return (
        small_frame(facts.df.sparkSession, rows, "dtype string")
        .groupBy("dtype").agg(F.count(F.lit(1)).alias("n_columns"))
    )


def parse_types(table: Facts | DataFrame) -> DataFrame:
    """Spark type each column should be parsed with, by its kind."""
    facts = Facts.of(table)
    rows = [(c, k.kind, KIND_TYPES[k.kind].simpleString()) for c, k in facts.kinds.items()]
    return small_frame(facts.df.sparkSession, rows, "column string, kind string, target_dtype string")


def size_estimate(table: Facts | DataFrame) -> DataFrame:
    """Row count, mean CSV line length and the CSV size in MB they imply."""
    facts = Facts.of(table)
    line = F.concat_ws(",", *[F.coalesce(facts.text(c), F.lit("")) for c in facts.columns])
    return facts.table.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.octet_length(line) + 1).alias("bytes")
    ).select(
        "n_rows",
        rounded(F.try_divide("bytes", "n_rows"), 2).alias("avg_row_bytes"),
        rounded(F.col("bytes") / 1e6, 3).alias("size_mb"),
    )


def value_counts_with_nulls(table: Facts | DataFrame, column: str, top: int = 20) -> DataFrame:
    """Top values of a column, null being a value of its own, with their share of all rows."""
    facts = Facts.of(table)
    counts = facts.table.groupBy(facts.text(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = facts.table.agg(F.count(F.lit(1)).alias("rows")).scalar()
    return (
        counts.orderBy(F.desc("count"), F.asc_nulls_last("value"))
        .limit(top)
        .select("value", "count", percent(F.col("count"), total).alias("percentage"))
    )
