"""Interquartile and z-score outliers of numerical columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayframe.functions.coerce import percent, rounded
from assayframe.plans.facts import Facts
from assayframe.plans.wide import long_aggregate, small_frame

# A column is tested from this many cells on; default sensitivities.
MIN_CELLS = 6
IQR_FACTOR = 1.5
Z_THRESHOLD = 3.0

OUTLIER_SCHEMA = "column string, method string, lower_bound double, upper_bound double, outliers bigint, share_pct double"


def outlier_tests(facts: Facts, iqr_factor: float = IQR_FACTOR, z_threshold: float = Z_THRESHOLD) -> list[tuple]:
    """``(column, method, lower, upper, predicate)`` per test, bounds as literals.

    Bounds come from the collected facts (one number per column), so counting or
    listing outliers is one more scan with plain comparisons.
    """
    fences = facts.fences(iqr_factor, MIN_CELLS)
    tests = []
    for c in facts.numeric:
        if c not in fences:
            continue
        x = facts.number(c)
        low, high = fences[c]
        tests.append((c, "IQR", low, high, (x < F.lit(low)) | (x > F.lit(high))))
        mean, sigma = facts.summary[c]["mean"], facts.summary[c]["sigma"]
        if sigma and sigma > 0:
            far = F.abs((x - F.lit(mean)) / F.lit(sigma)) > F.lit(z_threshold)
            tests.append((c, "Z-score", mean - z_threshold * sigma, mean + z_threshold * sigma, far))
    return tests


def outliers(
    table: Facts | DataFrame,
    method: str = "Both",
    iqr_factor: float = IQR_FACTOR,
    z_threshold: float = Z_THRESHOLD,
) -> DataFrame:
    """Outlier counts per column and method (``IQR``, ``Z-score`` or ``Both``)."""
    facts = Facts.of(table)
    tests = [t for t in outlier_tests(facts, iqr_factor, z_threshold) if method in ("Both", t[1])]
    if not tests:
        return small_frame(facts.df.sparkSession, [], OUTLIER_SCHEMA)
    entries = [
        ({"column": c, "method": m, "lower": low, "upper": high, "cells": facts.summary[c]["numbers"]},
         {"outliers": F.count_if(hit)})
        for c, m, low, high, hit in tests
    ]
    return long_aggregate(facts.df, entries).select(
        "column",
        "method",
        rounded(F.col("lower"), 3).alias("lower_bound"),
        rounded(F.col("upper"), 3).alias("upper_bound"),
        "outliers",
        percent(F.col("outliers"), F.col("cells")).alias("share_pct"),
    )


def outlier_rows(
    table: Facts | DataFrame,
    method: str = "Both",
    iqr_factor: float = IQR_FACTOR,
    z_threshold: float = Z_THRESHOLD,
) -> DataFrame:
    """``(order column, column, method, value)`` for every outlying cell."""
    facts = Facts.of(table)
    if facts.order_by is None:
        raise ValueError("listing outlier rows needs a row identifier as order column")
    hits: list[Column] = [
        F.when(hit, F.struct(F.lit(c).alias("column"), F.lit(m).alias("method"), facts.number(c).alias("value")))
        for c, m, _, _, hit in outlier_tests(facts, iqr_factor, z_threshold)
        if method in ("Both", m)
    ]
    if not hits:
        return small_frame(facts.df.sparkSession, [], "row_id string, column string, method string, value double")
    found = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return facts.df.select(F.col(facts.order_by).alias("row_id"), F.inline(found))
