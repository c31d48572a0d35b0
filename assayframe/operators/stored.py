"""Column facts that are stored and merged: a profile of old and new data without reading the old data again.

``column_facts`` gives one row per column, or per column and value of ``by`` (a day, a batch), with counts, extremes, mean,
spread and two sketches as binary columns; write it beside the data it describes. ``merge_facts`` adds rows up, any number
of times and in any grouping, and ``facts_profile`` reads the result.

Counts, gaps and extremes of merged facts are exact, mean and spread exact up to rounding. Distinct values come from a
HyperLogLog sketch of ``2 ** HLL_BITS`` buckets, with a relative standard error of 0.83 / 2 ** (HLL_BITS / 2), 1.3 % here;
quantiles from a KLL sketch of size ``KLL_SIZE``, whose ranks are off by at most ``RANK_ERROR`` of all cells with a
probability of 99 %, merged or not. Columns of other types than numbers have counts and distinct values only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayframe.functions.coerce import as_text, present
from assayframe.plans.wide import long_aggregate

HLL_BITS = 12
KLL_SIZE = 400
RANK_ERROR = 0.01

TYPES = {
    "rows": "bigint", "n": "bigint", "low": "double", "high": "double", "mean": "double", "m2": "double", "distinct_sketch": "binary", "rank_sketch": "binary",
}


def _aggregates(df: DataFrame, column: str) -> dict[str, Column]:
    col, dtype = F.col(f"`{column}`"), df.schema[column].dataType
    found = {"rows": F.count(F.lit(1)), "n": F.count(present(col, dtype)), "distinct_sketch": F.hll_sketch_agg(as_text(col, dtype), F.lit(HLL_BITS))}
    if isinstance(dtype, T.NumericType):
        x = present(col, dtype).cast("double")
        found |= {
            "low": F.min(x), "high": F.max(x), "mean": F.avg(x), "m2": F.var_pop(x) * F.count(x), "rank_sketch": F.kll_sketch_agg_double(x, F.lit(KLL_SIZE))}
    return found


def column_facts(df: DataFrame, by: str | None = None) -> DataFrame:
    """``([by,] column, rows, n, low, high, mean, m2, distinct_sketch, rank_sketch)`` for every column but ``by``."""
    columns = [c for c in df.columns if c != by]
    if by is None:
        return long_aggregate(df, [({"column": c}, _aggregates(df, c)) for c in columns], TYPES)
    key = F.col(f"`{by}`")
    named = {c: _aggregates(df, c) for c in columns}
    grouped = df.groupBy(key.alias(by)).agg(*[a.alias(f"e{i}_{name}") for i, aggregates in enumerate(named.values()) for name, a in aggregates.items()])
    lines = [
        F.struct(F.lit(c).alias("column"), *[(F.col(f"e{i}_{name}") if name in aggregates else F.lit(None)).cast(kind).alias(name) for name, kind in TYPES.items()])
        for i, (c, aggregates) in enumerate(named.items())]
    return grouped.select(F.col(f"`{by}`"), F.inline(F.array(*lines)))


def merge_facts(facts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Facts added up by column, and by ``keys`` if given."""
    n, mean = F.col("n"), F.col("mean")
    total = F.sum(F.when(mean.isNotNull(), n))
    centre = F.sum(n * mean) / total
    # spread of all cells around their mean: that within the parts and that of the parts' means
    return facts.groupBy(*(keys or []), "column").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), centre.alias("mean"),
        (F.sum("m2") + F.greatest(F.sum(n * mean * mean) - total * centre * centre, F.lit(0.0))).alias("m2"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("rank_sketch").alias("rank_sketch"))


def facts_profile(facts: DataFrame, probabilities: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``(column, rows, count, missing, min, max, mean, std, unique, q25, ...)`` of stored or merged facts; ``unique`` and ``q..`` within the bounds above."""
    others = [c for c in facts.columns if c not in TYPES]
    n = F.col("n")
    ranks = [F.when(F.col("mean").isNotNull(), F.kll_sketch_get_quantile_double("rank_sketch", F.lit(float(p)))).alias(f"q{round(100 * p)}") for p in probabilities]
    return facts.select(
        *others, "rows", n.alias("count"), (F.col("rows") - n).alias("missing"), F.col("low").alias("min"), F.col("high").alias("max"), "mean",
        F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))).alias("std"), F.hll_sketch_estimate("distinct_sketch").alias("unique"), *ranks)
