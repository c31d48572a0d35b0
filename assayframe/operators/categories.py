"""Quality of labels: cardinality, top and rare values, spelling variants, advice."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayframe.functions.coerce import normalise_label, percent, rounded
from assayframe.plans.facts import Facts
from assayframe.plans.frequency import top_per_group

# Report sizes and thresholds.
TOP_VALUES = 10
RARE_SHARE = 0.01
SHOWN_VARIANTS = 5
TOP_VARIANT_GROUPS = 10
TEXTY_LENGTH = 50
TEXTY_DISTINCT = 0.9
ID_LIKE_RATIO = 0.95
HIGH_CARDINALITY = 50

ADVICE_FREE_TEXT = "Looks like free text / unique IDs: treat as text, not category."
ADVICE_STANDARDISE = "Similar labels differ in casing/whitespace — consider standardising."
ADVICE_GROUP = "High cardinality category — consider grouping rare values."


def _counts(facts: Facts, columns: list[str] | None) -> DataFrame:
    return facts.counts(facts.of_kind("categorical", "text") if columns is None else columns)


def cardinality(table: Facts | DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, n_unique, cardinality_ratio)``: distinct labels and their share of all rows."""
    facts = Facts.of(table)
    return (
        _counts(facts, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
        .select("column", "n_unique", rounded(F.col("n_unique") / facts.rows, 3).alias("cardinality_ratio"))
    )


def category_top(table: Facts | DataFrame, columns: list[str] | None = None, top: int = TOP_VALUES) -> DataFrame:
    """The most frequent labels of each column, ties by label."""
    facts = Facts.of(table)
    ranked = top_per_group(_counts(facts, columns), ["column"], [F.desc("n"), F.asc("value")], top)
    return ranked.select(
        "column", "rank", "value", F.col("n").alias("count"), percent(F.col("n"), F.lit(facts.rows)).alias("percentage")
    )


def category_rare(table: Facts | DataFrame, columns: list[str] | None = None, top: int = TOP_VALUES) -> DataFrame:
    """The most frequent among the labels below the rarity share."""
    facts = Facts.of(table)
    rare = _counts(facts, columns).where(F.col("n") / F.lit(facts.rows) < RARE_SHARE)
    ranked = top_per_group(rare, ["column"], [F.desc("n"), F.asc("value")], top)
    return ranked.select(
        "column", "rank", "value", F.col("n").alias("count"), percent(F.col("n"), F.lit(facts.rows)).alias("percentage")
    )


def label_groups(counts: DataFrame) -> DataFrame:
    """``(column, normalised, n_variants)`` of labels that have several spellings."""
    return (
        counts.withColumn("normalised", normalise_label(F.col("value")))
        .groupBy("column", "normalised")
        .agg(F.count(F.lit(1)).alias("n_variants"))
        .where(F.col("n_variants") > 1)
    )


def inconsistent_labels(table: Facts | DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The label groups with most spellings per column, with the first spellings shown.

    Spellings are only gathered for the few groups that are reported, and only
    the first few of each, so no group is ever held as a whole.
    """
    facts = Facts.of(table)
    counts = _counts(facts, columns)
    groups = top_per_group(
        label_groups(counts), ["column"], [F.desc("n_variants"), F.asc("normalised")], TOP_VARIANT_GROUPS
    )
    spellings = counts.select("column", normalise_label(F.col("value")).alias("normalised"), "value")
    shown = top_per_group(
        # At most ten groups per column: bounded by the schema.
        spellings.join(F.broadcast(groups), ["column", "normalised"]),
        ["column", "normalised"],
        [F.asc("value")],
        SHOWN_VARIANTS,
        rank="place",
    )
    return shown.groupBy("column", "rank", "normalised", "n_variants").agg(
        F.concat_ws(", ", F.sort_array(F.collect_list("value"))).alias("variants")
    )


def category_analysis(table: Facts | DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cardinality, label consistency and one piece of advice per column."""
    facts = Facts.of(table)
    counts = _counts(facts, columns)
    per_column = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_unique"),
        F.sum("n").alias("cells"),
        F.sum(F.length("value") * F.col("n")).alias("chars"),
    )
    variants = label_groups(counts).groupBy("column").agg(F.count(F.lit(1)).alias("inconsistent_groups"))
    ratio = F.col("n_unique") / F.lit(facts.rows)
    texty = (F.col("chars") / F.col("cells") > TEXTY_LENGTH) | (F.col("n_unique") > TEXTY_DISTINCT * F.col("cells"))
    groups = F.coalesce("inconsistent_groups", F.lit(0))
    return per_column.join(variants, "column", "left").select(
        "column",
        "n_unique",
        rounded(ratio, 3).alias("cardinality_ratio"),
        groups.alias("inconsistent_groups"),
        F.when((ratio > ID_LIKE_RATIO) & texty, ADVICE_FREE_TEXT)
        .when(groups > 0, ADVICE_STANDARDISE)
        .when(F.col("n_unique") > HIGH_CARDINALITY, ADVICE_GROUP)
        .otherwise("")
        .alias("suggestion"),
    )
