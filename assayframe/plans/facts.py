"""Shared facts of one table, computed in as few scans as possible.

Every operator reads these instead of scanning on its own. What is collected to
the driver is one small row per column; anything that grows with the data stays
a DataFrame.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayframe.functions.coerce import as_boolean, as_number, as_text, as_timestamp
from assayframe.operators.kinds import Kind, detect_kinds
from assayframe.plans.duplicates import comparable, fresh, without_nan
from assayframe.plans.durable import written
from assayframe.plans.frequency import value_counts
from assayframe.plans.quantiles import exact_quantiles
from assayframe.plans.wide import long_aggregate, small_frame


# Shared aggregates per column; number facts are NULL for other kinds, and so are date facts.
SUMMARY = {
    "rows": "bigint", "n": "bigint", "numbers": "bigint", "finite": "bigint", "mean": "double", "sigma": "double",
    "low": "double", "high": "double", "stamps": "bigint",
    "first_ts": "timestamp_ntz", "last_ts": "timestamp_ntz",
}


class Facts:
    """A table together with its column kinds and shared aggregates.

    ``order_by`` names a column that gives the rows their order; it is only
    needed by operators that speak of first, last, previous or next rows.
    """

    def __init__(
        self,
        df: DataFrame,
        kinds: dict[str, Kind] | None = None,
        order_by: str | None = None,
    ):
        self.native = without_nan(df)  # what cleaning returns: every column as it came
        self.table = comparable(df)
        self.order_by = order_by
        self.columns = [c for c in df.columns if c != order_by]
        self._kinds = kinds
        self._quantiles: dict[str, dict[float, float]] = {}
        self._shared: DataFrame | None = None
        self._orders: dict[str, bool] = {}

    @classmethod
    def of(cls, table: "Facts | DataFrame") -> "Facts":
        return table if isinstance(table, Facts) else cls(table)

    @classmethod
    def settled(cls, table: "Facts | DataFrame") -> "Facts":
        """Facts for an operator that goes over the table many times: text columns of numbers or dates are parsed once.

        The table is written with its parsed columns and read from there; facts that come in, and tables without such
        columns, stay as they are.
        """
        if isinstance(table, Facts):
            return table
        facts = cls(table)
        if facts._parsed:
            facts.df = written(facts.df, "facts")
            facts.table = facts.visible(facts.df)
        return facts

    # -- kinds ---------------------------------------------------------------

    @property
    def kinds(self) -> dict[str, Kind]:
        if self._kinds is None:
            self._kinds = detect_kinds(self.table.select(*[f"`{c}`" for c in self.columns]))
        return self._kinds

    def of_kind(self, *kinds: str) -> list[str]:
        return [c for c in self.columns if self.kinds[c].kind in kinds]

    @property
    def numeric(self) -> list[str]:
        return self.of_kind("numerical")

    @property
    def labelled(self) -> list[str]:
        """Categorical and boolean columns."""
        return self.of_kind("categorical", "boolean")

    # -- views ---------------------------------------------------------------

    @cached_property
    def _parsed(self) -> dict[str, str]:
        """Hidden column with the parsed cells of each numerical or datetime text column."""
        texts = [c for c in self.of_kind("numerical", "datetime") if isinstance(self.dtype(c), T.StringType)]
        prefix = fresh("_parsed", self.table)
        return {c: f"{prefix}{i}" for i, c in enumerate(texts)}

    @cached_property
    def df(self) -> DataFrame:
        """The table with the hidden parsed columns, so that no operator parses a cell twice."""
        return self.with_parsed(self.table)

    @property
    def cells(self) -> DataFrame:
        """The table for operators on named columns, which need no kinds: parsed columns only if there already."""
        return self.table if self._kinds is None else self.df

    def with_parsed(self, df: DataFrame) -> DataFrame:
        """``df`` with the hidden parsed columns."""
        views = {}
        for c, name in self._parsed.items():
            kind, col, dtype = self.kinds[c], self.col(c), self.dtype(c)
            views[name] = as_number(col, dtype) if kind.kind == "numerical" else as_timestamp(col, dtype, kind.day_first)
        return df.withColumns(views) if views else df

    def visible(self, df: DataFrame) -> DataFrame:
        """``df`` without the hidden columns."""
        return df.drop(*self._parsed.values())

    def dtype(self, column: str) -> T.DataType:
        return self.table.schema[column].dataType

    def col(self, column: str) -> Column:
        return F.col(f"`{column}`")

    def number(self, column: str) -> Column:
        if self._kinds is not None and self.kinds[column].kind == "numerical" and column in self._parsed:
            return F.col(self._parsed[column])
        return as_number(self.col(column), self.dtype(column))

    def timestamp(self, column: str) -> Column:
        if self._kinds is not None and self.kinds[column].kind == "datetime" and column in self._parsed:
            return F.col(self._parsed[column])
        return as_timestamp(self.col(column), self.dtype(column), self._day_first(column))

    def _day_first(self, column: str) -> bool:
        """How slashed dates of a text column are read; looked up for the one column if the kinds are not known."""
        if self._kinds is not None:
            return self.kinds[column].day_first
        if not isinstance(self.dtype(column), T.StringType):
            return False
        if column not in self._orders:
            self._orders[column] = detect_kinds(self.table.select(self.col(column)))[column].day_first
        return self._orders[column]

    def boolean(self, column: str) -> Column:
        return as_boolean(self.col(column), self.dtype(column))

    def text(self, column: str) -> Column:
        return as_text(self.col(column), self.dtype(column))

    # -- facts ---------------------------------------------------------------

    @cached_property
    def summary(self) -> dict[str, dict]:
        """Counts, moments and extremes per column: one scan, one row per column."""
        entries = [({"column": c}, self._summary_aggregates(c)) for c in self.columns]
        found = {r["column"]: r.asDict() for r in long_aggregate(self.df, entries, SUMMARY).collect()}
        for seen in found.values():
            if seen["low"] is not None and seen["low"] == seen["high"]:
                # A constant column: merging partial moments may leave rounding noise.
                seen.update(mean=seen["low"], sigma=0.0)
        return found

    def _summary_aggregates(self, c: str) -> dict[str, Column]:
        kind = self.kinds[c].kind
        out = {"rows": F.count(F.lit(1)), "n": F.count(self.col(c))}
        if kind == "numerical":
            x = self.number(c)
            out.update({
                "numbers": F.count(x), "finite": F.count_if(F.abs(x) < float("inf")), "mean": F.avg(x),
                "sigma": F.stddev_pop(x), "low": F.min(x), "high": F.max(x),
            })
        elif kind == "datetime":
            ts = self.timestamp(c)
            out.update({"stamps": F.count(ts), "first_ts": F.min(ts), "last_ts": F.max(ts)})
        return out

    @cached_property
    def summary_frame(self) -> DataFrame:
        """The summary as a table ``(pos, column, kind, rows, n, ...)``."""
        schema = "pos int, column string, kind string, " + ", ".join(f"{k} {t}" for k, t in SUMMARY.items())
        rows = [
            (i, c, self.kinds[c].kind, *[self.summary[c][k] for k in SUMMARY]) for i, c in enumerate(self.columns)
        ]
        return small_frame(self.table.sparkSession, rows, schema)

    @cached_property
    def moments(self) -> dict[str, tuple]:
        """Population skewness and kurtosis of the numerical columns that vary."""
        varied = [c for c in self.numeric if self.summary[c]["sigma"]]
        entries = [({"column": c}, {"g1": F.skewness(self.number(c)), "g2": F.kurtosis(self.number(c))}) for c in varied]
        found = long_aggregate(self.df, entries).collect() if entries else []
        return {r["column"]: (r["g1"], r["g2"]) for r in found}

    @property
    def rows(self) -> int:
        return next(iter(self.summary.values()))["rows"] if self.columns else 0

    def quantiles(self, probabilities: list[float], columns: list[str] | None = None) -> dict[str, dict[float, float]]:
        """Exact quantiles of numerical columns, remembered between operators."""
        columns = self.numeric if columns is None else columns
        need = [c for c in columns if any(p not in self._quantiles.get(c, {}) for p in probabilities)]
        if need:
            counts = {c: (self.summary[c]["numbers"], self.summary[c]["low"], self.summary[c]["high"]) for c in need}
            views = {c: self.number(c) for c in need}
            fresh = exact_quantiles(self.df, views, probabilities, counts)
            for c in need:
                self._quantiles.setdefault(c, {}).update(fresh[c])
        return {c: self._quantiles.get(c, {}) for c in columns}

    def fences(self, factor: float = 1.5, min_cells: int = 1) -> dict[str, tuple[float, float]]:
        """Interquartile fences of the numerical columns with enough cells."""
        columns = [c for c in self.numeric if self.summary[c]["numbers"] >= min_cells]
        found = self.quantiles([0.25, 0.75], columns)
        return {
            c: (q[0.25] - factor * (q[0.75] - q[0.25]), q[0.75] + factor * (q[0.75] - q[0.25]))
            for c, q in found.items()
        }

    def counts(self, columns: list[str]) -> DataFrame:
        """``(column, value, n)`` over the non-null cells of the given columns."""
        if not columns:
            return small_frame(self.table.sparkSession, [], "column string, value string, n bigint")
        if self._shared is not None and set(columns) <= set(self.of_kind("categorical", "text", "boolean")):
            return self._shared.where(F.col("column").isin(columns))
        return value_counts(self.table, {c: self.text(c) for c in columns})

    def share(self) -> "Facts":
        """Keep the label counts for several operators; :meth:`release` frees them."""
        columns = self.of_kind("categorical", "text", "boolean")
        if self._shared is None and columns:
            self._shared = value_counts(self.table, {c: self.text(c) for c in columns}).persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def release(self) -> None:
        if self._shared is not None:
            self._shared.unpersist()
            self._shared = None
