"""Distribution statistics of single columns and associations between columns."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from assayframe.functions.coerce import percent, rounded
from assayframe.functions.stats import (
    distribution_label,
    histogram_bins,
    sample_kurtosis,
    sample_skewness,
    sign_word,
    strength_word,
)
from assayframe.plans.crosstabs import pair_counts
from assayframe.plans.durable import written
from assayframe.plans.facts import Facts
from assayframe.plans.frequency import top_per_group
from assayframe.plans.wide import MAX_EXPRESSIONS, long_aggregate, small_frame, union_all

# Report sizes and thresholds.
TOP_LABELS = 15
TOP_PAIRS = 10
ETA_CELLS = 10
ETA_SHOWN = 0.5
CRAMERS_SHOWN = 0.4
STRONG = 0.6

# Labels whose totals are broadcast, at most.
BROADCAST_LABELS = 100_000

# A variance this small against the squared cell size is numeric noise.
NOISE = 1e-14

RELATION_SCHEMA = "type string, x string, y string, metric double, metric_name string, direction string, detail string"


# -- single columns -----------------------------------------------------------


def numeric_modes(table: Facts | DataFrame) -> DataFrame:
    """``(column, mode)`` of numerical columns, the smallest value on ties."""
    facts = Facts.of(table)
    spark = facts.df.sparkSession
    if not facts.numeric:
        return small_frame(spark, [], "column string, mode double")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), facts.number(c).alias("v")) for c in facts.numeric])
    counts = facts.df.select(F.inline(cells)).where(F.col("v").isNotNull()).groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    # two hash aggregates over the counts; ordering by a struct would sort every distinct value
    most = counts.groupBy("column").agg(F.max("n").alias("n"))
    return counts.join(F.broadcast(most), ["column", "n"]).groupBy("column").agg(F.min("v").alias("mode"))


def numeric_shape(table: Facts | DataFrame) -> DataFrame:
    """Everything of :func:`describe` but the mode, which needs a shuffle of all values."""
    facts = Facts.of(table)
    quartiles = facts.quantiles([0.25, 0.5, 0.75])
    rows = [
        (i, c, q.get(0.25), q.get(0.5), q.get(0.75), *facts.moments.get(c, (None, None)))
        for i, (c, q) in enumerate((c, quartiles[c]) for c in facts.numeric)
    ]
    found = small_frame(facts.df.sparkSession, rows, "seq int, column string, q25 double, q50 double, q75 double, g1 double, g2 double")
    n = F.col("numbers")
    std = F.when(n > 1, F.col("sigma") * F.sqrt(n / (n - 1)))
    skew = sample_skewness(F.col("g1"), n)
    kurt = sample_kurtosis(F.col("g2"), n)
    return (
        facts.summary_frame.where((F.col("kind") == "numerical") & (n > 0))
        .join(found, "column")
        .select(
            "seq", "column", n.alias("count"), "mean", std.alias("std"), F.col("low").alias("min"), "q25", "q50", "q75",
            F.col("high").alias("max"), (std * std).alias("variance"), skew.alias("skew"), kurt.alias("kurtosis"),
            F.col("q50").alias("median"), (F.col("high") - F.col("low")).alias("range"),
            F.when(F.col("mean") != 0, std / F.col("mean")).alias("cv"),
            distribution_label(skew, kurt).alias("distribution_label"),
            histogram_bins(n, F.col("high") - F.col("low"), F.col("q75") - F.col("q25")).alias("histogram_bins"),
        )
    )


def describe(table: Facts | DataFrame) -> DataFrame:
    """Moments, quartiles, mode, range, dispersion, shape label and bin count per numerical column."""
    facts = Facts.of(table)
    return numeric_shape(facts).join(numeric_modes(facts), "column", "left").orderBy("seq").drop("seq")


def category_labels(table: Facts | DataFrame) -> DataFrame:
    """Distinct labels, dominance and a concentration label per categorical or boolean column."""
    facts = Facts.of(table)
    total = F.lit(facts.rows)
    every = small_frame(facts.df.sparkSession, [(i, c) for i, c in enumerate(facts.labelled)], "seq int, column string")
    seen = facts.counts(facts.labelled).groupBy("column").agg(
        F.count(F.lit(1)).alias("n_unique"), F.max("n").alias("most"), F.min("n").alias("least")
    )
    u, share = F.col("n_unique"), 100.0 * F.col("most") / total
    label = (
        F.when(u.isNull(), "empty")
        .when(u <= 1, "constant (single value)")
        .when(share > 70, "dominated by one category")
        .when((u / total > 0.4) & (u > 40), "high-cardinality / long-tail")
        .when((F.col("most") / F.col("least") < 1.5) & (u > 4), "roughly balanced")
        .otherwise("concentrated in few categories")
    )
    return (
        every.join(seen, "column", "left")
        .select(
            "seq", "column", F.coalesce(u, F.lit(0)).alias("n_unique"),
            F.coalesce(rounded(u / total, 3), F.lit(0.0)).alias("cardinality"),
            F.coalesce(rounded(share, 2), F.lit(0.0)).alias("dominant_share"),
            label.alias("distribution_label"),
        )
        .orderBy("seq").drop("seq")
    )


def category_summary(table: Facts | DataFrame, top: int = TOP_LABELS) -> DataFrame:
    """The top labels of each categorical or boolean column with the column's own facts."""
    facts = Facts.of(table)
    ranked = top_per_group(facts.counts(facts.labelled), ["column"], [F.desc("n"), F.asc("value")], top)
    return category_labels(facts).join(ranked, "column", "left").select(
        "column", "n_unique", "cardinality", "dominant_share", "distribution_label", "rank", "value",
        F.col("n").alias("count"), percent(F.col("n"), F.lit(facts.rows)).alias("percentage"),
    )


# -- numbers with numbers -------------------------------------------------------


def _centred(facts: Facts, c: str) -> Column:
    """The column shifted by its mean (a constant column to exact zeros), so sums do not cancel."""
    seen = facts.summary[c]
    shift = seen["low"] if seen["low"] == seen["high"] else seen["mean"]
    return facts.number(c) - F.lit(shift or 0.0)


def _pair_sums(numbers: DataFrame) -> DataFrame:
    """``(i, j, n, sx, sy, sxx, syy, sxy)`` of all pairs of columns of doubles, over the rows where both are present.

    One scan: every task multiplies its batches, gaps as zeros, with the masks of what is present, and reports one
    row per pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            cells = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            here = ~np.isnan(cells)
            x, m = np.where(here, cells, 0.0), here.astype(float)
            found = np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
            sums = found if sums is None else sums + found
        if sums is not None:
            i, j = np.triu_indices(sums.shape[1], 1)
            both, one, square, product = sums
            columns = [i, j, both[i, j].astype(np.int64), one[i, j], one[j, i], square[i, j], square[j, i], product[i, j]]
            types = [pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    parts = numbers.mapInArrow(run, "i int, j int, n bigint, sx double, sy double, sxx double, syy double, sxy double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def correlation_pairs(table: Facts | DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(x, y, n, r)``: Pearson correlation of each pair of numerical columns.

    Cells count only where both are present. One scan for all pairs; r is NULL for a column that
    is constant or holds infinite values.
    """
    facts = Facts.of(table)
    columns = facts.numeric if columns is None else columns
    spark = facts.df.sparkSession
    if len(columns) < 2:
        return small_frame(spark, [], "x string, y string, n bigint, r double")
    finite = [facts.summary[c]["finite"] == facts.summary[c]["numbers"] for c in columns]
    sums = _pair_sums(facts.df.select(*[_centred(facts, c).alias(f"c{i}") for i, c in enumerate(columns)]))
    named = small_frame(spark, [(i, c, int(f)) for i, (c, f) in enumerate(zip(columns, finite))], "place int, name string, finite int")
    pairs = small_frame(spark, [(i, j) for i, j in combinations(range(len(columns)), 2)], "i int, j int").join(sums, ["i", "j"], "left")
    for side, label in (("i", "x"), ("j", "y")):
        pairs = pairs.join(F.broadcast(named.select(F.col("place").alias(side), F.col("name").alias(label), F.col("finite").alias(f"finite_{label}"))), side)
    n = F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    sound = (n > 1) & (vx > NOISE * F.col("sxx")) & (vy > NOISE * F.col("syy")) & (F.col("finite_x") + F.col("finite_y") == 2)
    r = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy)
    return pairs.select(
        "x", "y", F.coalesce(n, F.lit(0)).alias("n"), F.when(sound, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r")
    )


def correlation_matrix(table: Facts | DataFrame) -> DataFrame:
    """The full symmetric matrix in long form ``(x, y, r)``, NULL where undefined."""
    facts = Facts.of(table)
    pairs = correlation_pairs(facts).select("x", "y", "r")
    both = F.array(
        F.struct(F.col("x"), F.col("y"), F.col("r")), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), F.col("r"))
    )
    own = [
        (c, c, None if facts.summary[c]["numbers"] < 2 or facts.summary[c]["low"] == facts.summary[c]["high"] else 1.0)
        for c in facts.numeric
    ]
    diagonal = small_frame(facts.df.sparkSession, own, "x string, y string, r double")
    return pairs.select(F.inline(both)).unionByName(diagonal)


def worded_correlations(table: Facts | DataFrame) -> DataFrame:
    """All defined correlations with their sign and wording."""
    r = F.col("r")
    return correlation_pairs(table).where(r.isNotNull()).select(
        "x", "y", "r", sign_word(r).alias("direction"),
        F.concat_ws(" ", strength_word(r), sign_word(r), F.lit("linear relationship")).alias("detail"))


def top_correlations(table: Facts | DataFrame, top: int = TOP_PAIRS) -> DataFrame:
    """The strongest pairs by absolute correlation, with their sign and wording."""
    return worded_correlations(table).orderBy(F.desc(F.abs("r")), "x", "y").limit(top)


# -- numbers with labels --------------------------------------------------------


def eta(table: Facts | DataFrame, max_levels: int | None = None) -> DataFrame:
    """``(cat, num, n, eta)`` for all label columns, or those with at most ``max_levels`` levels.

    Each row yields one struct per label column; partial aggregation folds them
    to one row per level and task, with centred sums of every number.
    """
    facts = Facts.of(table)
    if not facts.labelled or not facts.numeric:
        return small_frame(facts.df.sparkSession, [], "cat string, num string, n bigint, eta double")
    levels = facts.counts(facts.labelled).groupBy("column").agg(F.count(F.lit(1)).alias("u")).collect()
    few = {r["column"] for r in levels if r["u"] >= 2 and (max_levels is None or r["u"] <= max_levels)}
    cats = [c for c in facts.labelled if c in few]
    if not cats:
        return small_frame(facts.df.sparkSession, [], "cat string, num string, n bigint, eta double")
    cells = F.array(*[F.struct(F.lit(c).alias("cat"), facts.text(c).alias("level")) for c in cats])
    per_block = max(1, MAX_EXPRESSIONS // 3)
    parts = []
    for start in range(0, len(facts.numeric), per_block):
        block = facts.numeric[start : start + per_block]
        shifted = [_centred(facts, c).alias(f"x{i}") for i, c in enumerate(block)]
        sums = [
            agg
            for i in range(len(block))
            for agg in (F.count(f"x{i}").alias(f"n{i}"), F.sum(f"x{i}").alias(f"s{i}"), F.sum(F.col(f"x{i}") * F.col(f"x{i}")).alias(f"q{i}"))
        ]
        grouped = (
            facts.df.select(*shifted, F.inline(cells)).where(F.col("level").isNotNull()).groupBy("cat", "level").agg(*sums)
        )
        long = F.array(*[
            F.struct(F.lit(c).alias("num"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("s"), F.col(f"q{i}").alias("q"))
            for i, c in enumerate(block)
        ])
        parts.append(grouped.select("cat", F.inline(long)))
    totals = (
        union_all(parts).where(F.col("n") > 0).groupBy("cat", "num")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
             F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.count(F.lit(1)).alias("levels"))
    )
    shift = F.col("s") * F.col("s") / F.col("n")
    between, spread = F.col("b") - shift, F.col("q") - shift
    share = between / (F.col("n") * spread / (F.col("n") - 1))
    return totals.where((F.col("n") >= ETA_CELLS) & (F.col("levels") >= 2) & (spread > NOISE * F.col("q"))).select(
        "cat", "num", "n", F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).alias("eta")
    )


# -- labels with labels ---------------------------------------------------------


def contingency(table: Facts | DataFrame, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(x, y, a, b, n)``: rows per combination of labels, for all pairs of label columns or the given ones, in one scan."""
    facts = Facts.of(table)
    pairs = list(combinations(facts.labelled, 2)) if pairs is None else pairs
    schema = "x string, y string, a string, b string, n bigint"
    if not pairs:
        return small_frame(facts.df.sparkSession, [], schema)
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    texts = facts.df.select(*[facts.text(c).alias(f"c{i}") for i, c in enumerate(columns)])
    counted = pair_counts(texts, [(columns.index(x), columns.index(y)) for x, y in pairs])
    # pairs as numbers through the shuffle, as names behind it
    names = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in pairs])
    return counted.select(F.get(names, F.col("pair")).alias("xy"), "a", "b", "n").select("xy.x", "xy.y", "a", "b", "n")


def _share_of(counts: DataFrame, side: str, name: str) -> DataFrame:
    """``counts`` with the number of rows of each label of one side; hot labels are split by the skew join or broadcast."""
    totals = written(counts.groupBy("x", "y", side).agg(F.sum("n").alias(name)), "marginals")
    few = len(totals.limit(BROADCAST_LABELS + 1).select(name).take(BROADCAST_LABELS + 1)) <= BROADCAST_LABELS
    return counts.join(F.broadcast(totals) if few else totals, ["x", "y", side])


def cramers_v(table: Facts | DataFrame, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(x, y, n, v)`` for all pairs of label columns, or the given ones, with at least two levels each.

    Chi-square is ``n * (sum(o^2 / (row * column)) - 1)``, so only the observed
    combinations are needed.
    """
    counts = written(contingency(table, pairs), "contingency")
    per_pair = (
        _share_of(_share_of(counts, "a", "row"), "b", "col")
        .groupBy("x", "y")
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / (F.col("row") * F.col("col").cast("double"))).alias("s"),
             # each level's share of itself adds up to one
             F.round(F.sum(F.col("n") / F.col("row"))).cast("bigint").alias("rows"), F.round(F.sum(F.col("n") / F.col("col"))).cast("bigint").alias("cols"))
    )
    smaller = F.least("rows", "cols") - 1
    return per_pair.where(smaller >= 1).select(
        "x", "y", "n", F.sqrt(F.greatest(F.lit(0.0), F.col("s") - 1) / smaller).alias("v")
    )


# -- all associations -------------------------------------------------------------


def relationships(table: Facts | DataFrame, max_rows: int | None = None) -> DataFrame:
    """Associations of all three sorts, strongest first: every defined correlation, and notable eta and Cramér's V."""
    facts = Facts.of(table)
    numbers = worded_correlations(facts).select(
        F.lit("num-num").alias("type"), "x", "y", F.col("r").alias("metric"), F.lit("Pearson corr").alias("metric_name"),
        "direction", "detail",
    )
    e = F.col("eta")
    mixed = eta(facts).where(e >= ETA_SHOWN).select(
        F.lit("num-cat").alias("type"), F.col("cat").alias("x"), F.col("num").alias("y"), e.alias("metric"),
        F.lit("Eta (association)").alias("metric_name"), F.lit("").alias("direction"),
        F.format_string("Category of %s explains ~%.0f%% of variance in %s", "cat", 100 * e * e, "num").alias("detail"),
    )
    labels = cramers_v(facts).where(F.col("v") >= CRAMERS_SHOWN).select(
        F.lit("cat-cat").alias("type"), "x", "y", F.col("v").alias("metric"), F.lit("Cramér's V").alias("metric_name"),
        F.lit("").alias("direction"), F.format_string("Strong association between categories %s and %s", "x", "y").alias("detail"),
    )
    found = union_all([numbers, mixed, labels]).orderBy(F.desc(F.abs("metric")), "type", "x", "y")
    return found if max_rows is None else found.limit(max_rows)


def strong_relationships(table: Facts | DataFrame) -> DataFrame:
    """Associations of absolute strength 0.6 and above."""
    return relationships(table).where(F.abs("metric") >= STRONG).orderBy(F.desc(F.abs("metric")), "type", "x", "y")


def eda_suite(table: Facts | DataFrame) -> dict[str, DataFrame]:
    """All EDA tables of one input over shared facts."""
    facts = Facts.of(table)
    return {
        "numeric": describe(facts),
        "categorical": category_summary(facts),
        "correlations": correlation_matrix(facts),
        "relationships": relationships(facts),
    }
