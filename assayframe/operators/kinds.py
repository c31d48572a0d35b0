"""Semantic kind of each column: numerical, categorical, datetime, text or boolean."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayframe.functions.coerce import (
    BOOL_TOKENS,
    YEAR_LAST,
    as_text,
    is_nested,
    is_temporal,
    strip,
    text_number,
    text_timestamp,
)
from assayframe.plans.duplicates import comparable
from assayframe.plans.frequency import value_counts
from assayframe.plans.wide import long_aggregate, small_frame

# Decision thresholds.
NUMERIC_SHARE = 0.75
DATETIME_SHARE = 0.8
FEW_VALUES = 15
FEW_SHARE = 0.05
MANY_VALUES = 100

# Columns whose distinct estimate is below this are counted exactly in memory.
EXACT_DISTINCT_BELOW = 1000

# Spark type to parse a column with once its kind is known.
KIND_TYPES = {
    "numerical": T.DoubleType(),
    "categorical": T.StringType(),
    "datetime": T.TimestampNTZType(),
    "text": T.StringType(),
    "boolean": T.BooleanType(),
}

KIND_SCHEMA = "pos int, column string, kind string, confidence double, reason string, inferred_dtype string"


# Facts gathered per column before deciding.
EVIDENCE = {"n": "bigint", "tokens": "int", "numbers": "bigint", "dates": "bigint", "by_month": "bigint", "by_day": "bigint"}


@dataclass(frozen=True)
class Kind:
    column: str
    kind: str
    confidence: float
    reason: str
    dtype: str
    day_first: bool = False  # how slashed dates of a text column are read


def kinds_frame(df: DataFrame, kinds: dict[str, Kind]) -> DataFrame:
    rows = [(i, k.column, k.kind, k.confidence, k.reason, k.dtype) for i, k in enumerate(kinds.values())]
    return small_frame(df.sparkSession, rows, KIND_SCHEMA)


def hash_sample(df: DataFrame, key: str, keep_in: int) -> DataFrame:
    """A repeatable sample: about one row in ``keep_in``, chosen by the MD5 of ``key``, the same on every engine."""
    place = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    return df.where(place % keep_in == 0)


def detect_kinds(df: DataFrame, exact_unique: bool = False) -> dict[str, Kind]:
    """Decide the kind of every column.

    One wide aggregate gathers all evidence: which boolean tokens occur (a bit
    mask, so no distinct is needed) and how many cells read as numbers and dates.
    Undecided columns get a distinct estimate, and those with a low one are
    counted exactly; their value sets are bounded by that estimate. ``exact_unique`` also counts the remaining high-cardinality ones.
    """
    df = comparable(df)
    fields = df.schema.fields
    evidence = {
        r["column"]: r
        for r in long_aggregate(
            _with_stripped(df), [({"column": f.name}, _evidence(i, f)) for i, f in enumerate(fields)], EVIDENCE
        ).collect()
    }
    decided: dict[str, Kind] = {}
    open_fields = []
    for f in fields:
        kind = _from_evidence(f, evidence[f.name])
        if kind is None:
            open_fields.append(f)
        else:
            decided[f.name] = kind
    for name, unique, exact in _distinct_counts(df, open_fields, exact_unique):
        decided[name] = _by_cardinality(name, unique, exact, evidence[name]["n"], df.schema[name].dataType)
    return {f.name: decided[f.name] for f in fields}


def detect_types(df: DataFrame) -> DataFrame:
    """The kinds as a table, with exact distinct counts in the reasons."""
    return kinds_frame(df, detect_kinds(df, exact_unique=True)).orderBy("pos")


def _is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType) or is_nested(dtype)


def _with_stripped(df: DataFrame) -> DataFrame:
    """Text columns stripped once, for all the tests on them."""
    texts = [(i, f) for i, f in enumerate(df.schema.fields) if _is_text(f.dataType)]
    return df.withColumns({f"_stripped{i}": strip(as_text(F.col(f"`{f.name}`"), f.dataType)) for i, f in texts}) if texts else df


def _evidence(place: int, field: T.StructField) -> dict[str, Column]:
    col = F.col(f"`{field.name}`")
    dtype = field.dataType
    text = _is_text(dtype)
    stripped = F.col(f"_stripped{place}")
    evidence = {"n": F.count(col)}
    # Bit 0 stands for any other value, the rest for one boolean token each.
    if text:
        tokens = F.split(F.lit(" ".join(BOOL_TOKENS)), " ")
        short = F.length(stripped) <= max(map(len, BOOL_TOKENS))
        found = F.when(short, F.array_position(tokens, F.lower(stripped)).cast("int")).when(col.isNotNull(), 0)
        evidence["tokens"] = F.bit_or(F.call_function("shiftleft", F.lit(1), found))
    elif isinstance(dtype, T.IntegralType):
        bits = {value: 1 << (BOOL_TOKENS.index(str(value)) + 1) for value in (0, 1)}
        evidence["tokens"] = F.bit_or(F.when(col == 0, bits[0]).when(col == 1, bits[1]).when(col.isNotNull(), 1))
    if isinstance(dtype, T.StringType):
        evidence["numbers"] = F.count(text_number(stripped))
        evidence["dates"] = F.count(text_timestamp(stripped))
        # dates with the year last that only one order can read
        parts = F.split(F.when(stripped.rlike(YEAR_LAST), stripped), "[/-]")
        first, second = F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")
        evidence["by_month"] = F.count_if((first <= 12) & (second > 12) & (second <= 31))
        evidence["by_day"] = F.count_if((second <= 12) & (first > 12) & (first <= 31))
    return evidence


def _from_evidence(field: T.StructField, seen) -> Kind | None:
    name, dtype, n = field.name, field.dataType, seen["n"]
    shown = dtype.simpleString()
    if n and (
        isinstance(dtype, T.BooleanType)
        or (seen["tokens"] is not None and seen["tokens"] % 2 == 0 and bin(seen["tokens"]).count("1") <= 2)
    ):
        return Kind(name, "boolean", 0.95, "Low cardinality and values map to true/false", shown)
    if is_temporal(dtype):
        return Kind(name, "datetime", 1.0, "Parsed as datetime dtype", shown)
    if isinstance(dtype, T.NumericType):
        return Kind(name, "numerical", 0.95, "Numeric dtype", shown)
    if n == 0:
        return Kind(name, "text", 0.4, "Column is entirely empty", "empty")
    if (seen["numbers"] or 0) / n > NUMERIC_SHARE:
        return Kind(name, "numerical", 0.75, "Values look numeric but stored as text", f"{shown} (numeric-like)")
    # the order of day and month that more cells ask for; the others of the column then do not parse
    day_first = (seen["by_day"] or 0) > (seen["by_month"] or 0)
    dates = (seen["dates"] or 0) + (seen["by_day"] - seen["by_month"] if day_first else 0)
    if dates / n > DATETIME_SHARE:
        return Kind(name, "datetime", 0.9, f"{100 * dates // n}% values parse as dates", shown, day_first)
    return None


def _distinct_counts(df: DataFrame, fields: list[T.StructField], exact_unique: bool):
    """``(column, distinct values, exactly counted)`` of undecided columns."""
    if not fields:
        return
    # Sketches in an aggregate of their own: mixed with others they make it too large to compile.
    sketches = [F.approx_count_distinct(as_text(F.col(f"`{f.name}`"), f.dataType)).alias(f"u{i}") for i, f in enumerate(fields)]
    estimates = df.agg(*sketches).first()
    few = [f for i, f in enumerate(fields) if estimates[i] <= EXACT_DISTINCT_BELOW]
    many = [f for f in fields if f not in few]
    if few:
        row = df.agg(
            *[F.size(F.collect_set(as_text(F.col(f"`{f.name}`"), f.dataType))).alias(f"u{i}") for i, f in enumerate(few)]
        ).first()
        yield from ((f.name, row[f"u{i}"], True) for i, f in enumerate(few))
    if many and exact_unique:
        counts = value_counts(df, {f.name: as_text(F.col(f"`{f.name}`"), f.dataType) for f in many})
        rows = counts.groupBy("column").agg(F.count(F.lit(1)).alias("u")).collect()
        yield from ((r["column"], r["u"], True) for r in rows)
    elif many:
        yield from ((f.name, estimates[i], False) for i, f in enumerate(fields) if f in many)


def _by_cardinality(name: str, unique: int, exact: bool, n: int, dtype: T.DataType) -> Kind:
    shown = dtype.simpleString()
    if unique <= FEW_VALUES and unique <= max(2, n * FEW_SHARE):
        return Kind(name, "categorical", 0.85, f"Only {unique} unique values", shown)
    if unique > MANY_VALUES:
        count = f"{unique}" if exact else f"about {unique}"
        return Kind(name, "text", 0.7, f"High cardinality ({count} unique)", shown)
    return Kind(name, "categorical", 0.8, f"{unique} unique values", shown)
