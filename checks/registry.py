"""Registry of checks and small SQL helpers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayframe.functions.coerce import rounded
from checks.inputs import DIRTY_CTES


@dataclass
class Check:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CHECKS: dict[str, Check] = {}

# Dates are compared with this moment, so that results do not change with time.
AS_OF = dt.datetime(2000, 1, 1)
AS_OF_SQL = "TIMESTAMP '2000-01-01 00:00:00'"


def check(name: str, sql: str | None = None):
    def register(run):
        CHECKS[name] = Check(run, sql)
        return run

    return register


def round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column, so that summation order does not show."""
    return df.withColumns({c: rounded(F.col(c), digits) for c, t in df.dtypes if t == "double"})


# -- SQL helpers ------------------------------------------------------------------


def r(expr: str, digits: int = 6) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def pct(part: str, whole: str, digits: int = 2) -> str:
    return r(f"100.0 * ({part}) / CAST({whole} AS DOUBLE)", digits)


def num(text: str) -> str:
    bare = f"regexp_replace(trim({text}), '[,$%]', '', 'g')"
    return rf"CASE WHEN regexp_matches({bare}, '^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$') THEN TRY_CAST({bare} AS DOUBLE) END"


def ts(text: str) -> str:
    return rf"CASE WHEN regexp_matches({text}, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}$') THEN TRY_CAST({text} AS TIMESTAMP) END"


def plain(number: str) -> str:
    return rf"regexp_replace(CAST(CAST({number} AS DECIMAL(18,4)) AS VARCHAR), '\.?0+$', '')"


def norm(text: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({text}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))"


def stripped(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def long(table: str, views: dict[str, str], value: str = "v", extra: str = "") -> str:
    """``(pos, col, value)`` over the given expressions of a table."""
    return " UNION ALL ".join(
        f"SELECT {i} AS pos, '{c}' AS col, {e} AS {value}{extra} FROM {table}" for i, (c, e) in enumerate(views.items())
    )


def dirty(body: str, *ctes: str) -> str:
    """A statement over the dirty table ``d`` (``keyed`` with row ids, ``base`` without copies)."""
    return "WITH " + ",\n".join([DIRTY_CTES, *ctes]) + "\n" + body


TEXT_COLUMNS = ["order_id", "qty_txt", "date_txt", "priority_txt", "email", "phone", "active", "status"]
ALL_TEXT = {
    "order_id": "order_id", "total": plain("total"), "qty_txt": "qty_txt", "date_txt": "date_txt", "priority_txt": "priority_txt",
    "email": "email", "phone": "phone", "active": "active", "start_date": "CAST(start_date AS VARCHAR)",
    "end_date": "CAST(end_date AS VARCHAR)", "status": "status",
}
DIRTY_NUMBERS = {"total": "total", "qty_txt": num("qty_txt")}
DIRTY_DATES = {"date_txt": ts("date_txt"), "start_date": "start_date", "end_date": "end_date"}
LABEL_TEXT = {c: c for c in ("order_id", "priority_txt", "email", "phone", "status")}  # categorical and text kinds
LABELLED = {c: c for c in ("priority_txt", "active", "status")}  # categorical and boolean kinds
LINE_NUMBERS = {
    c: f"CAST({c} AS DOUBLE)"
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
}
