"""Plain-language findings: rules over the fact tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from assayframe.functions.stats import strength_word
from assayframe.operators.categories import inconsistent_labels
from assayframe.operators.duplicates import duplicate_summary
from assayframe.operators.eda import category_labels, numeric_shape, strong_relationships
from assayframe.operators.missing import missing_by_column, missing_totals
from assayframe.operators.outliers import outliers
from assayframe.operators.profile import shape
from assayframe.operators.validation import type_issues, validate
from assayframe.plans.facts import Facts
from assayframe.plans.wide import union_all

# Rule thresholds and report sizes. The sentences of the rules below are fixed values as well.
HIGH_SKEW = 1.5
MILD_SKEW = 0.5
HIGH_CV = 2
MISSING_INFO = 1
MISSING_WARNING = 5
MISSING_COLUMN = 10
OUTLIER_SHARE = 2
REDUNDANT = 0.9
DENSE = 100
TOP_ISSUES = 6
CLEAN_MESSAGE = "No critical issues detected. Dataset looks reasonably clean."

ORDERED = ["rule", "place", "sub"]


def _lines(frame: DataFrame, rule: int, place, category: str, severity, text: Column, sub: int = 0) -> DataFrame:
    """Insights of one rule; ``rule``, ``place`` and ``sub`` keep the report order."""
    severity = severity if isinstance(severity, Column) else F.lit(severity)
    return frame.select(
        F.lit(rule).alias("rule"), (place if isinstance(place, Column) else F.lit(place)).cast("int").alias("place"), F.lit(sub).alias("sub"),
        F.lit(category).alias("category"), severity.alias("severity"), text.alias("text"),
    )


def _fmt(value: Column) -> Column:
    return F.format_string("%,.2f", value)


def _pct(value: Column) -> Column:
    """A percentage already on the 0-100 scale."""
    return F.format_string("%.1f%%", value)


def structural_insights(facts: Facts) -> DataFrame:
    size = F.format_string(
        "The dataset has %,d rows and %d columns (%d numeric, %d categorical, %d datetime, %d free-text, %d boolean).",
        "n_rows", "n_cols", "n_numerical", "n_categorical", "n_datetime", "n_text", "n_boolean",
    )
    copies, share = F.col("duplicate_rows"), 100.0 * F.col("duplicate_rows") / F.lit(facts.rows)
    repeated = F.format_string("%,d fully duplicated rows (%.1f%%) will skew all downstream metrics if left untouched.", copies, share)
    pct = F.col("overall_pct")
    gaps = F.format_string("Overall missingness is %.1f%% across %,d cells.", pct, F.col("total_missing"))
    return union_all([
        _lines(shape(facts), 1, 0, "structure", "info", size),
        _lines(duplicate_summary(facts).where(copies > 0), 2, 0, "data_issue", "warning", repeated),
        _lines(missing_totals(facts).where(pct > MISSING_INFO), 3, 0, "data_issue",
               F.when(pct > MISSING_WARNING, "warning").otherwise("info"), gaps),
    ])


def distribution_insights(facts: Facts) -> DataFrame:
    numbers, labels = numeric_shape(facts), category_labels(facts)
    skew, name = F.col("skew"), F.col("column")
    high = F.format_string(
        "'%s' is highly skewed (%+.2f) — %s. Consider log/square-root transforms for models.", name, skew, F.col("distribution_label")
    )
    mild = F.format_string("'%s' is mildly skewed (%+.2f).", name, skew)
    spread = F.format_string(
        "'%s' has very high relative dispersion (CV=%s) — values are spread over many orders of magnitude.", name, _fmt(F.col("cv"))
    )
    ruling = F.col("distribution_label")
    dominated = F.format_string(
        "'%s' is dominated by a single category (%s of rows). Check whether ≤%d categories are truly meaningful.",
        name, _pct(F.col("dominant_share")), F.col("n_unique"),
    )
    constant = F.format_string("'%s' is constant — it carries no discriminating information.", name)
    places = F.array_position(F.array(*[F.lit(c) for c in facts.labelled] or [F.lit("")]), name)
    severe = F.abs(skew) >= HIGH_SKEW
    return union_all([
        _lines(numbers.where(F.abs(skew) >= MILD_SKEW), 4, F.col("seq"), "distribution",
               F.when(severe, "warning").otherwise("info"), F.when(severe, high).otherwise(mild)),
        _lines(numbers.where(F.col("cv") > HIGH_CV), 4, F.col("seq"), "distribution", "info", spread, sub=1),
        _lines(labels.where(ruling.contains("dominated") | ruling.contains("constant")), 5, places, "distribution", "info",
               F.when(ruling.contains("dominated"), dominated).otherwise(constant)),
    ])


def relationship_insights(facts: Facts) -> DataFrame:
    strong = strong_relationships(facts)
    m, sort = F.col("metric"), F.col("type")
    redundant = F.when(F.abs(m) > REDUNDANT, "This may indicate redundancy.").otherwise("")
    numbers = F.format_string(
        "%s %s correlation (%+.2f) between '%s' and '%s'. %s", F.initcap(F.split_part(strength_word(m), F.lit(" "), F.lit(1))), "direction", m, "x", "y", redundant
    )
    numbers = F.when(
        F.abs(m) >= 0.85, F.format_string("Very strong %s correlation (%+.2f) between '%s' and '%s'. %s", "direction", m, "x", "y", redundant)
    ).otherwise(numbers)
    mixed = F.format_string("'%s' varies strongly with '%s' (eta=%.2f): %s.", "y", "x", m, F.lower("detail"))
    labels = F.format_string(
        "'%s' and '%s' are strongly associated (Cramér's V=%.2f) — they may encode overlapping information.", "x", "y", m
    )
    # Associations keep the order of strength; ties by name.
    rank = F.format_string("%012.9f %s %s %s", 10 - F.abs(m), "type", "x", "y")
    text = F.when(sort == "num-num", numbers).when(sort == "num-cat", mixed).otherwise(labels)
    ranked = strong.select("*", text.alias("_text"), rank.alias("_rank")).orderBy("_rank")
    return _lines(ranked, 6, ((1 - F.abs(m)) * 1_000_000_000), "relationship", "info", F.col("_text"))


def quality_insights(facts: Facts, as_of: dt.datetime | None = None) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(c) for c in facts.columns]), F.col("column"))
    name = F.col("column")
    gaps = missing_by_column(facts).where(F.col("missing_pct") > MISSING_COLUMN)
    missing = F.format_string("Column '%s' is missing %s%% of its values (%,d cells).", name, _fmt(F.col("missing_pct")), F.col("missing"))
    issues = type_issues(facts)
    mistyped = F.format_string(
        "'%s' contains %d values that don't parse as %s (e.g. '%s').", name, "anomalous_count", "detected_as", "examples"
    )
    far = outliers(facts, "IQR").where((F.col("outliers") > 0) & (F.col("share_pct") >= OUTLIER_SHARE))
    flagged = F.format_string(
        "IQR method flags %d outliers (%s) in '%s' outside [%s, %s].", "outliers", _pct(F.col("share_pct")), name,
        _fmt(F.col("lower_bound")), _fmt(F.col("upper_bound")),
    )
    variants = inconsistent_labels(facts).where(F.col("rank") == 1)
    spelled = F.format_string(
        "'%s' has inconsistent labels: '%s' look like the same value (%d variants). Standardise casing before analysis.",
        name, "variants", "n_variants",
    )
    checks = validate(facts, as_of).where(F.col("severity") != "info")
    share = _pct(F.col("share_pct"))
    failed = F.format_string("%s check failed on '%s': %d violations (%s). %s", "check", name, "failures", share, "detail")
    suspect = F.format_string("%s check on '%s' found %d suspicious values (%s).", "check", name, "failures", share)
    error = F.col("severity") == "error"
    return union_all([
        _lines(gaps, 7, -F.col("missing") / F.lit(max(1, facts.rows)) * 1_000_000, "data_issue", "warning", missing),
        _lines(issues, 8, place, "data_issue", "warning", mistyped),
        _lines(far, 9, place, "anomaly", "warning", flagged),
        _lines(variants, 10, place, "data_issue", "warning", spelled),
        _lines(checks, 11, place, "data_issue", F.when(error, "error").otherwise("info"), F.when(error, failed).otherwise(suspect)),
    ])


def time_insights(facts: Facts) -> DataFrame:
    days = F.floor(F.unix_timestamp(F.col("last_ts").cast("timestamp")) / 86400.0 - F.unix_timestamp(F.col("first_ts").cast("timestamp")) / 86400.0)
    per_day = F.col("stamps") / F.col("days")
    density = F.when(per_day >= DENSE, "high").when(per_day >= 1, "medium").otherwise("sparse")
    spans = facts.summary_frame.where((F.col("kind") == "datetime") & (F.col("stamps") >= 2)).withColumn("days", days)
    text = F.format_string(
        "'%s' spans %d days (%s → %s) with %s data density (~%.1f records/day).", "column", "days",
        F.to_date("first_ts").cast("string"), F.to_date("last_ts").cast("string"), density, per_day,
    )
    return _lines(spans.where(F.col("days") > 0), 12, F.col("pos"), "structure", "info", text)


def cleaning_insights(log: DataFrame) -> DataFrame:
    steps = log.agg((F.count(F.lit(1)) - 2).alias("steps")).where(F.col("steps") > 0)
    text = F.format_string("Cleaning applied %d transformations — see the cleaning log for details.", "steps")
    return _lines(steps, 13, 0, "structure", "info", text)


def insights(table: Facts | DataFrame, as_of: dt.datetime | None = None, cleaning_log: DataFrame | None = None) -> DataFrame:
    """``(category, severity, text)``, errors first, then warnings, then the rest."""
    facts = Facts.settled(table)
    parts = [
        structural_insights(facts), distribution_insights(facts), relationship_insights(facts),
        quality_insights(facts, as_of), time_insights(facts),
    ]
    if cleaning_log is not None:
        parts.append(cleaning_insights(cleaning_log))
    urgency = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return union_all(parts).orderBy(urgency, *ORDERED, "text").select("category", "severity", "text")


def top_issues(found: DataFrame, top: int = TOP_ISSUES) -> DataFrame:
    """The first warnings and errors of an insight table, or a message that there are none."""
    urgent = F.col("severity").isin("error", "warning")
    issues = found.where(urgent).limit(top).select("severity", "text")
    none = found.agg(F.count_if(urgent).alias("n")).where(F.col("n") == 0)
    return issues.unionByName(none.select(F.lit("info").alias("severity"), F.lit(CLEAN_MESSAGE).alias("text")))


def health(found: DataFrame) -> DataFrame:
    """``(findings, issues, health)``: the share of findings that are no issues."""
    urgent = F.count_if(F.col("severity").isin("error", "warning"))
    return found.agg(F.count(F.lit(1)).alias("findings"), urgent.alias("issues")).select(
        "findings", "issues", (1 - F.col("issues") / F.greatest("findings", F.lit(1))).alias("health")
    )
