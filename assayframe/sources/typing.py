"""Physical types for columns that were read as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayframe.functions.coerce import NA_TOKENS, NUMBER_PATTERN
from assayframe.plans.wide import long_aggregate

INTEGER_PATTERN = r"^[-+]?\d+$"


def blank_tokens(df: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """Turn missing-value tokens into NULL."""
    tokens = NA_TOKENS if tokens is None else tokens
    return df.withColumns({
        f.name: F.when(~F.col(f"`{f.name}`").isin(tokens), F.col(f"`{f.name}`"))
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType)
    })


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns whose every non-null cell is a whole number, a number or True/False.

    One aggregate decides for all columns, after the missing tokens are gone;
    the reader's own inference would see those tokens as text.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    entries = []
    for name in names:
        cell = F.trim(F.col(f"`{name}`"))
        whole = cell.rlike(INTEGER_PATTERN)
        entries.append((
            {"column": name},
            {"n": F.count(cell), "wholes": F.count_if(whole), "numbers": F.count_if(cell.rlike(NUMBER_PATTERN)),
             "longs": F.count_if(whole & cell.try_cast("bigint").isNotNull()), "decimals": F.count_if(whole & cell.try_cast("decimal(38,0)").isNotNull()),
             "flags": F.count_if(cell.isin("True", "False", "TRUE", "FALSE", "true", "false"))},
        ))
    seen = {r["column"]: r for r in long_aggregate(df, entries).collect()}
    views: dict[str, Column] = {}
    for name in names:
        dtype = _type_of(seen[name])
        if dtype:
            views[name] = F.trim(F.col(f"`{name}`")).try_cast(dtype)
    return df.withColumns(views) if views else df


def _type_of(seen) -> str | None:
    """The narrowest type that keeps every cell: whole numbers are never rounded, and stay text beyond 38 digits."""
    n = seen["n"]
    if not n:
        return None
    if seen["wholes"] == n:
        return "bigint" if seen["longs"] == n else "decimal(38,0)" if seen["decimals"] == n else None
    return "double" if seen["numbers"] == n else "boolean" if seen["flags"] == n else None
