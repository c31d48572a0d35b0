"""The 0-100 quality score from five dimensions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from assayframe.functions.coerce import rounded
from assayframe.operators.categories import label_groups
from assayframe.operators.duplicates import duplicate_summary
from assayframe.operators.missing import missing_totals
from assayframe.operators.outliers import IQR_FACTOR, outliers
from assayframe.operators.validation import cell_rules, rule_totals, tally, type_rules
from assayframe.plans.facts import Facts
from assayframe.plans.wide import small_frame, union_all

# Dimension weights, in report order.
WEIGHTS = {"completeness": 0.25, "uniqueness": 0.15, "validity": 0.20, "consistency": 0.20, "accuracy": 0.20}


def grade(score: Column) -> Column:
    return (
        F.when(score >= 90, "Excellent").when(score >= 80, "Good").when(score >= 65, "Fair")
        .when(score >= 50, "Poor").otherwise("Critical")
    )


def _measures(facts: Facts, as_of: dt.datetime | None, iqr_factor: float) -> DataFrame:
    """One row of everything the dimensions need, each measure from its own small aggregate."""

    def one(frame: DataFrame, **measures: Column) -> DataFrame:
        row = frame.agg(*[expr.cast("double").alias(name) for name, expr in measures.items()])
        return row.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("amount")) for m in measures])))

    def total(expr) -> Column:
        return F.coalesce(F.sum(expr), F.lit(0))

    # value rules and type rules in one scan, without their examples
    types = type_rules(facts)
    rules = types + cell_rules(facts, as_of)
    tallied, mistyped = tally(facts, rules, rule_totals(facts, rules)), F.col("seq") < len(types)
    failures, severity = F.col("failures"), F.col("severity")
    labels = facts.counts(facts.of_kind("categorical", "text"))
    parts = [
        one(missing_totals(facts), completeness_pct=F.max("completeness_pct")),
        one(duplicate_summary(facts), duplicates=F.max("duplicate_rows")),
        one(
            tallied.where(~mistyped),
            weighted=total(failures * F.when(severity == "error", 1.5).otherwise(1.0)),
            violations=total(F.when(severity != "info", failures)),
            checks=F.count(F.lit(1)),
        ),
        one(tallied.where(mistyped), share_penalty=total(F.least(F.col("share_pct") * 0.6, F.lit(30.0))), mistyped=F.count(F.lit(1))),
        one(label_groups(labels), inconsistent=F.count_distinct("column")),
        one(outliers(facts, "IQR", iqr_factor), flagged=total("outliers"), tested=F.count(F.lit(1))),
    ]
    names = ["completeness_pct", "duplicates", "weighted", "violations", "checks", "share_penalty", "mistyped", "inconsistent", "flagged", "tested"]
    return union_all(parts).agg(*[F.max(F.when(F.col("measure") == n, F.col("amount"))).alias(n) for n in names])


def _dimensions(rows: int, cells: int) -> dict[str, tuple[Column, Column]]:
    """``(score, detail)`` expressions of each dimension."""
    n = F.lit(float(max(1, rows)))
    pct = F.col("completeness_pct")
    completeness = F.when(pct >= 99, 100.0).when(pct >= 95, 95.0).when(pct >= 90, 88.0).when(pct >= 75, 75.0).otherwise(50.0)
    dup = F.col("duplicates") / n
    uniqueness = 100 * (1 - dup) - F.when(dup > 0.05, 10 * F.least(dup, F.lit(0.5))).otherwise(0.0)
    validity = 100 - 40 * F.least(F.col("weighted") / n, F.lit(2.5))
    k = F.col("inconsistent")
    consistency = 100 - F.col("share_penalty") - F.when(k > 0, F.least(5 + 6 * k, F.lit(35.0))).otherwise(0.0)
    share = F.col("flagged") / F.when(F.col("tested") > 0, n * F.col("tested")).otherwise(F.lit(float(max(1, cells))))
    accuracy = 100 - 60 * F.least(share, F.lit(1.0))
    whole = lambda c: F.col(c).cast("bigint")
    return {
        "completeness": (completeness, F.format_string("%.1f%% of cells are filled", pct)),
        "uniqueness": (uniqueness, F.format_string("%.1f%% of rows are unique", 100 * (1 - dup))),
        "validity": (validity, F.when(F.col("checks") > 0, F.format_string("%d rule violations across %d checks", whole("violations"), whole("checks"))).otherwise("No validation rule violations found")),
        "consistency": (consistency, F.format_string("%d columns with type anomalies; %d categorical columns with inconsistent labels", whole("mistyped"), whole("inconsistent"))),
        "accuracy": (accuracy, F.when(F.col("tested") > 0, F.format_string("%d IQR-outlier cells in %d numeric columns", whole("flagged"), whole("tested"))).otherwise("No outlier cells detected")),
    }


def quality_score(
    table: Facts | DataFrame,
    as_of: dt.datetime | None = None,
    weights: dict[str, float] | None = None,
    iqr_factor: float = IQR_FACTOR,
) -> DataFrame:
    """``(dimension, score, weight, grade, detail)`` per dimension plus an ``overall`` row."""
    facts = Facts.settled(table)
    weights = weights or WEIGHTS
    if facts.rows == 0:
        rows = [(d, 0.0, weights[d], "Critical", "Empty dataframe") for d in WEIGHTS] + [("overall", 0.0, 1.0, "Critical", "Empty dataframe")]
        return small_frame(facts.df.sparkSession, rows, "dimension string, score double, weight double, grade string, detail string")
    dims = _dimensions(facts.rows, facts.rows * len(facts.columns))
    scored = _measures(facts, as_of, iqr_factor).select(
        *[rounded(F.greatest(F.lit(0.0), score), 1).alias(d) for d, (score, _) in dims.items()],
        *[detail.alias(f"{d}_detail") for d, (_, detail) in dims.items()],
    )
    overall = rounded(sum((F.col(d) * weights[d] for d in dims), F.lit(0.0)), 1)
    lines = [(d, F.col(d), F.lit(float(weights[d])), F.col(f"{d}_detail")) for d in dims]
    lines.append(("overall", overall, F.lit(1.0), F.lit("weighted mean of the dimensions")))
    return scored.select(F.inline(F.array(*[
        F.struct(F.lit(d).alias("dimension"), s.alias("score"), w.alias("weight"), grade(s).alias("grade"), t.alias("detail"))
        for d, s, w, t in lines
    ])))


def score_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of each dimension between two scores."""
    return (
        before.select("dimension", F.col("score").alias("before"))
        .join(after.select("dimension", F.col("score").alias("after")), "dimension")
        .select("dimension", "before", "after", rounded(F.col("after") - F.col("before"), 1).alias("delta"))
    )
