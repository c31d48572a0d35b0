"""All result tables in one long frame, and the quality suite behind it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from assayframe.functions.coerce import rounded
from assayframe.operators.categories import category_analysis
from assayframe.operators.duplicates import duplicate_summary
from assayframe.operators.eda import strong_relationships
from assayframe.operators.insights import insights
from assayframe.operators.missing import missing_by_column, missing_totals
from assayframe.operators.outliers import outliers
from assayframe.operators.profile import profile, shape
from assayframe.operators.score import quality_score
from assayframe.operators.validation import type_issues, validate
from assayframe.plans.facts import Facts
from assayframe.plans.wide import union_all


def quality_suite(table: Facts | DataFrame, as_of: dt.datetime | None = None) -> dict[str, DataFrame]:
    """All quality tables of one input over shared facts."""
    facts = Facts.settled(table)
    return {
        "missing": missing_by_column(facts),
        "duplicates": duplicate_summary(facts),
        "type_issues": type_issues(facts),
        "outliers": outliers(facts),
        "categorical": category_analysis(facts),
        "validation": validate(facts, as_of),
    }


def _section(name: str, frame: DataFrame, max_rows: int | None, max_chars: int | None) -> DataFrame:
    """Numbered JSON rows of one section."""
    shown = frame if max_rows is None else frame.limit(max_rows)
    texts = {c: F.col(f"`{c}`").cast("string") for c in frame.columns}
    cells = [(t if max_chars is None else F.substring(t, 1, max_chars)).alias(c) for c, t in texts.items()]
    # A section has a few rows per column or pair of columns of the table, so one task numbers them.
    place = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(F.monotonically_increasing_id()))
    return shown.select(F.lit(name).alias("section"), place.alias("seq"), F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("payload"))


def report(
    table: Facts | DataFrame,
    file_name: str = "dataset",
    generated_at: str | None = None,
    as_of: dt.datetime | None = None,
    cleaning_log: DataFrame | None = None,
    max_rows: dict[str, int] | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """``(section, seq, payload)`` for overview, profile, quality, cleaning, insights, relationships and score.

    Everything is reported; ``max_rows`` (by section) and ``max_chars`` (of a cell) shorten it. Call ``release`` on the
    facts passed in when the report is written.
    """
    facts = Facts.settled(table).share()
    stamp = generated_at or dt.datetime.now().strftime("%Y-%m-%d %H:%M:%S")
    score = quality_score(facts, as_of)
    overview = shape(facts).select(
        F.lit(file_name).alias("file"), F.lit(stamp).alias("generated"), "n_rows", "n_cols"
    )
    columns = ["column", "inferred_dtype", "count", "unique", "missing", "missing_pct"]
    related = strong_relationships(facts).select("x", "y", "type", rounded(F.col("metric"), 3).alias("metric"), "metric_name")
    sections = {
        "overview": overview,
        "profile": profile(facts).select(*columns),
        "missing": missing_totals(facts),
        "duplicates": duplicate_summary(facts),
        "outliers": outliers(facts).orderBy("column", "method"),
        "type_issues": type_issues(facts),
        "validation": validate(facts, as_of).drop("detail"),
        "insights": insights(facts, as_of, cleaning_log),
        "relationships": related,
        "score": score,
    }
    if cleaning_log is not None:
        sections["cleaning_log"] = cleaning_log
    return union_all([_section(name, frame, (max_rows or {}).get(name), max_chars) for name, frame in sections.items()])
