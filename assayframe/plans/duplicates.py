"""Groups of identical rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayframe.functions.coerce import as_text, is_float, is_nested, present


def fresh(prefix: str, df: DataFrame) -> str:
    """``prefix`` with as many underscores before it as keep it off the table's own column names."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def without_nan(df: DataFrame) -> DataFrame:
    """The table with NaN as NULL; every column keeps its type."""
    changed = {f.name: present(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields if is_float(f.dataType)}
    return df.withColumns(changed) if changed else df


def comparable(df: DataFrame) -> DataFrame:
    """The table with NaN as NULL and nested cells as canonical text."""
    changed = {
        f.name: as_text(F.col(f"`{f.name}`"), f.dataType) if is_nested(f.dataType) else present(F.col(f"`{f.name}`"), f.dataType)
        for f in df.schema.fields
        if is_nested(f.dataType) or is_float(f.dataType)
    }
    return df.withColumns(changed) if changed else df


def _hashed_cells(df: DataFrame, columns: list[str]) -> list[Column]:
    """What a row's hash is made of: which cells are null, and the cells, -0.0 as 0.0."""
    cells = [F.col(f"`{c}`") for c in columns]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cells])
    cells = [
        c + F.lit(0.0).cast(df.schema[name].dataType) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else c
        for c, name in zip(cells, columns)
    ]
    return [nulls, *cells]


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """64-bit hash of the given cells; null positions are hashed too."""
    return F.xxhash64(*_hashed_cells(df, columns))


def row_fingerprint(df: DataFrame, columns: list[str]) -> list[Column]:
    """Two independent 64-bit hashes ``h1`` and ``h2`` of the given cells."""
    cells = _hashed_cells(df, columns)
    return [F.xxhash64(*cells).alias("h1"), F.xxhash64(F.lit("second"), *reversed(cells)).alias("h2")]


def repeated_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose hash occurs more than once: a superset of all duplicated rows.

    Eight bytes per row are shuffled to find the repeated hashes; the join with
    them shuffles full rows unless the repeated hashes are few enough to broadcast.
    """
    hashed = df.withColumn("_hash", row_hash(df, columns))
    repeated = (
        hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_hash")
    )
    return hashed.join(repeated, "_hash", "left_semi")


def duplicate_groups(df: DataFrame, columns: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """``columns..., n`` for every row value that occurs more than once (null equals null)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [expr.alias(name) for name, expr in (extra or {}).items()]
    groups = repeated_rows(df, columns).groupBy("_hash", *[f"`{c}`" for c in columns]).agg(*aggs)
    return groups.where(F.col("n") > 1)
