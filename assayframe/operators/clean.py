"""Cleaning steps and the logged cleaning run.

Steps are expressions on the table; numbers they need (means, fences, label
maps) come from earlier passes. A run does not filter or count as it goes: each
step adds a marker saying whether it touched the row, and rows to be dropped are
only marked as gone. The cleaned table is the rows that remain, and the whole
log is one aggregate over the markers.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayframe.functions.coerce import as_boolean, as_number, as_timestamp, plain_number, present, strip
from assayframe.operators.duplicates import drop_duplicates
from assayframe.operators.fuzzy import THRESHOLD, label_map
from assayframe.operators.kinds import Kind, detect_kinds
from assayframe.operators.outliers import IQR_FACTOR, MIN_CELLS, Z_THRESHOLD, outlier_tests
from assayframe.plans.carry import directional_fill
from assayframe.plans.durable import written
from assayframe.plans.duplicates import comparable, fresh, without_nan
from assayframe.plans.durable import durable
from assayframe.plans.facts import Facts
from assayframe.plans.quantiles import exact_quantiles
from assayframe.plans.wide import long_aggregate

# Method and action vocabularies.
IMPUTE_METHODS = ("drop", "mean", "median", "mode", "ffill", "bfill", "constant")
OUTLIER_ACTIONS = ("flag", "cap", "remove")

# A label map up to this size is sent to every task.
BROADCAST_BYTES = 32_000_000


# -- single steps -------------------------------------------------------------


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _fill_values(df: DataFrame, methods: dict[str, str]) -> dict[str, object]:
    """Fill value per column: one scan for all means, one for all medians, top-1 for modes."""
    views = {c: as_number(_col(c), df.schema[c].dataType) for c in methods}
    values: dict[str, object] = {}
    centred = [c for c, m in methods.items() if m in ("mean", "median")]
    if centred:
        entries = [
            ({"column": c}, {"n": F.count(views[c]), "mean": F.avg(views[c]), "low": F.min(views[c]), "high": F.max(views[c])})
            for c in centred
        ]
        seen = {r["column"]: r for r in long_aggregate(df, entries).collect()}
        values.update({c: seen[c]["mean"] for c in centred if methods[c] == "mean"})
        medians = [c for c in centred if methods[c] == "median"]
        if medians:
            counts = {c: (seen[c]["n"], seen[c]["low"], seen[c]["high"]) for c in medians}
            found = exact_quantiles(df, {c: views[c] for c in medians}, [0.5], counts)
            values.update({c: found[c].get(0.5) for c in medians})
    for c in (c for c, m in methods.items() if m == "mode"):
        top = (
            df.where(_col(c).isNotNull()).groupBy(_col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("v")).limit(1).select(F.col("v").cast("string").alias("v")).first()
        )
        values[c] = top["v"] if top else None
    return values


def _filled(df: DataFrame, column: str, method: str, value) -> Column:
    """The column with its gaps filled by a mean, median, mode or constant."""
    col, dtype = _col(column), df.schema[column].dataType
    if value is None:
        return col
    if method in ("mode", "constant"):
        return F.coalesce(col, F.lit(str(value)).try_cast(dtype))
    if isinstance(dtype, T.StringType):
        return F.coalesce(col, plain_number(F.lit(float(value))))
    if isinstance(dtype, (T.IntegralType, T.DecimalType)):
        # the other cells keep their type and every digit; a whole-number column gets the nearest whole number
        return F.coalesce(col, F.round(F.lit(float(value)), getattr(dtype, "scale", 0)).try_cast(dtype))
    return F.coalesce(col.cast("double"), F.lit(float(value)))


def impute(
    df: DataFrame,
    column: str,
    method: str,
    constant: str | None = None,
    order_by: str | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Fill the gaps of one column, or drop the rows that have one.

    Means and medians written into a text column keep its other cells as text.
    ``ffill`` and ``bfill`` need ``order_by`` and may be confined to ``keys``.
    """
    df = without_nan(df)
    if method in ("drop", ""):
        return df.where(_col(column).isNotNull())
    if method not in IMPUTE_METHODS:
        raise ValueError(f"Unknown method: {method}")
    if method in ("ffill", "bfill"):
        if order_by is None:
            raise ValueError(f"{method} needs an order column")
        return directional_fill(df, [column], order_by, keys, backward=method == "bfill")
    value = constant if method == "constant" else _fill_values(df, {column: method})[column]
    return df.withColumn(column, _filled(df, column, method, value))


def _typed(df: DataFrame, column: str, kind: str, day_first: bool = False) -> Column | None:
    dtype = df.schema[column].dataType
    if kind == "numerical":
        return present(_col(column), dtype) if isinstance(dtype, T.NumericType) else as_number(_col(column), dtype)
    if kind == "datetime":
        return as_timestamp(_col(column), dtype, day_first)
    if kind == "boolean":
        return as_boolean(_col(column), dtype)
    return None


def correct_types(df: DataFrame, kinds: dict[str, Kind] | None = None) -> DataFrame:
    """Cast every column to the type of its kind; cells that do not fit become NULL."""
    kinds = kinds or detect_kinds(df)
    views = {c: _typed(df, c, k.kind, k.day_first) for c, k in kinds.items() if c in df.columns}
    return df.withColumns({c: v for c, v in views.items() if v is not None})


def coerce_booleans(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: as_boolean(_col(c), df.schema[c].dataType) for c in columns})


def _plain_label(column: str, strip_space: bool, lower: bool) -> Column:
    label = _col(column)
    label = strip(label) if strip_space else label
    return F.lower(label) if lower else label


def standardise_labels(
    df: DataFrame,
    columns: list[str],
    strip_space: bool = True,
    lower: bool = True,
    merge_fuzzy: bool = True,
    threshold: int = THRESHOLD,
) -> DataFrame:
    """Trim and lower-case labels, then merge near-duplicates onto the shortest one."""
    out = df.withColumns({c: _plain_label(c, strip_space, lower) for c in columns})
    if not merge_fuzzy or not columns:
        return out
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lower(strip(_col(c))).alias("label")) for c in columns
    ])
    labels = out.select(F.inline(cells)).where(F.col("label").isNotNull()).distinct()
    mapping = durable(label_map(labels, threshold))
    size = mapping.agg(F.sum(F.octet_length("label") + F.octet_length("canonical"))).first()[0] or 0
    for c in columns:
        one = mapping.where(F.col("column") == c).select(F.col("label").alias("_from"), F.col("canonical").alias("_to"))
        # A small map goes to every task; a large one is joined by key, with AQE splitting hot labels.
        one = F.broadcast(one) if size <= BROADCAST_BYTES else one
        out = (
            out.join(one, _col(c) == F.col("_from"), "left")
            .withColumn(c, F.coalesce(F.col("_to"), _col(c)))
            .drop("_from", "_to")
        )
    return out


def flag_outliers(table: Facts | DataFrame, iqr_factor: float = IQR_FACTOR, z_threshold: float = Z_THRESHOLD) -> DataFrame:
    """Add ``<column>_is_outlier`` for every column that has outliers."""
    facts = Facts.of(table)
    return facts.visible(facts.with_parsed(facts.native).withColumns(_outlier_flags(facts, iqr_factor, z_threshold)))


def _outlier_flags(facts: Facts, iqr_factor: float, z_threshold: float) -> dict[str, Column]:
    """Interquartile hits if the column has any, else z-score hits."""
    tests = outlier_tests(facts, iqr_factor, z_threshold)
    if not tests:
        return {}
    seen = facts.df.agg(*[F.count_if(hit).alias(f"t{i}") for i, (*_, hit) in enumerate(tests)]).first()
    flags: dict[str, Column] = {}
    for i, (c, _, _, _, hit) in enumerate(tests):
        name = f"{c}_is_outlier"
        if seen[f"t{i}"] and name not in flags and name not in facts.df.columns:
            flags[name] = F.coalesce(hit, F.lit(False))
    return flags


def _capped(facts: Facts, column: str, low: float, high: float) -> Column:
    """Out-of-fence cells moved to the fence; cells that are no numbers stay."""
    x, dtype = facts.number(column), facts.dtype(column)
    if isinstance(dtype, T.StringType):
        return (
            F.when(x < F.lit(low), plain_number(F.lit(low))).when(x > F.lit(high), plain_number(F.lit(high)))
            .otherwise(facts.col(column))
        )
    inside = present(facts.col(column), dtype)
    if isinstance(dtype, (T.IntegralType, T.DecimalType)):
        # fences are moved inwards to the next value of the type, so that a capped cell lies within them
        scale = 10 ** getattr(dtype, "scale", 0)
        low_cell = (F.ceil(F.lit(low * scale)) / scale).try_cast(dtype)
        high_cell = (F.floor(F.lit(high * scale)) / scale).try_cast(dtype)
        return F.when(x < F.lit(low), F.coalesce(low_cell, inside)).when(x > F.lit(high), F.coalesce(high_cell, inside)).otherwise(inside)
    return F.when(x < F.lit(low), F.lit(low).cast(dtype)).when(x > F.lit(high), F.lit(high).cast(dtype)).otherwise(inside)


def cap_outliers(table: Facts | DataFrame, iqr_factor: float = IQR_FACTOR) -> DataFrame:
    """Winsorise numerical columns to their interquartile fences."""
    facts = Facts.of(table)
    fences = facts.fences(iqr_factor, MIN_CELLS)
    return facts.visible(facts.with_parsed(facts.native).withColumns({c: _capped(facts, c, *fences[c]) for c in fences}))


def remove_outliers(table: Facts | DataFrame, iqr_factor: float = IQR_FACTOR) -> DataFrame:
    """Drop rows that are interquartile outliers in any numerical column."""
    facts = Facts.of(table)
    return facts.visible(facts.with_parsed(facts.native).where(~_any_outlier(facts, iqr_factor)))


def _any_outlier(facts: Facts, iqr_factor: float) -> Column:
    hit = F.lit(False)
    for c, (low, high) in facts.fences(iqr_factor, MIN_CELLS).items():
        x = facts.number(c)
        hit = hit | F.coalesce((x < F.lit(low)) | (x > F.lit(high)), F.lit(False))
    return hit


# -- the logged run -----------------------------------------------------------


@dataclass
class CleaningOptions:
    imputation: dict[str, str] = field(default_factory=dict)
    constants: dict[str, str] = field(default_factory=dict)
    drop_duplicates: bool = False
    dedup_subset: list[str] | None = None
    correct_types: bool = True
    standardise: bool = False
    merge_fuzzy: bool = True
    fuzzy_threshold: int = THRESHOLD
    outlier_action: str | None = None
    iqr_factor: float = IQR_FACTOR
    z_threshold: float = Z_THRESHOLD
    fill_keys: list[str] | None = None


@dataclass
class _LogLine:
    operation: str
    columns: str
    detail: str  # may hold one %d for the affected rows
    marker: str | None
    only_if_hit: bool = False


class CleaningRun:
    """Apply dedup, imputation, type correction, label and outlier steps in that order."""

    def __init__(self, df: DataFrame, kinds: dict[str, Kind] | None = None, options: CleaningOptions | None = None, order_by: str | None = None):
        self.options = options or CleaningOptions()
        self.order_by = order_by
        self.source = without_nan(df)
        own = fresh("_clean", df)
        self._gone, self._hit, self._was = f"{own}_gone", f"{own}_hit", f"{own}_was"
        self.columns = [c for c in df.columns if c != order_by]
        self.kinds = kinds or detect_kinds(comparable(self.source.select(*[f"`{c}`" for c in self.columns])))
        self._lines: list[_LogLine] = []
        self._marked = self.source.withColumn(self._gone, F.lit(False))
        self._deduplicate()
        self._impute()
        if self.options.correct_types:
            self._correct_types()
        if self.options.standardise:
            self._standardise()
        if self.options.outlier_action:
            self._handle_outliers()

    # Steps work on the rows that are still there.

    def _alive(self) -> DataFrame:
        return self._marked.where(~F.col(self._gone)).select(*[f"`{c}`" for c in self._marked.columns if not c.startswith((self._hit, self._gone))])

    def _mark(self, hit: Column, operation: str, columns: str, detail: str, only_if_hit: bool = False) -> None:
        marker = f"{self._hit}{len(self._lines)}"
        self._marked = self._marked.withColumn(marker, F.coalesce(~F.col(self._gone) & hit, F.lit(False)))
        self._lines.append(_LogLine(operation, columns, detail, marker, only_if_hit))

    def _deduplicate(self) -> None:
        o = self.options
        if not o.drop_duplicates:
            return
        # written once, so that the steps that look at the kept rows do not remove duplicates again
        kept = written(drop_duplicates(self.source, o.dedup_subset or self.columns, self.order_by), "cleaning")
        self._marked = kept.withColumn(self._gone, F.lit(False))
        self._lines.append(_LogLine("duplicate-removal", ", ".join(o.dedup_subset or ["all"]), "Removed %d duplicate rows", "dedup"))

    def _impute(self) -> None:
        plan = [(c, m.lower()) for c, m in self.options.imputation.items() if c in self.columns]
        pending: dict[str, str] = {}
        for c, m in plan:
            if m in ("drop", ""):
                self._fill_pending(pending)
                pending = {}
                self._mark(_col(c).isNull(), "missing-drop", c, f"Dropped %d rows with missing {c.replace('%', '%%')}")
                self._marked = self._marked.withColumn(self._gone, F.col(self._gone) | _col(c).isNull())
            else:
                pending[c] = m
        self._fill_pending(pending)

    def _fill_pending(self, methods: dict[str, str]) -> None:
        if not methods:
            return
        values = _fill_values(self._alive(), {c: m for c, m in methods.items() if m in ("mean", "median", "mode")})
        values.update({c: self.options.constants.get(c) for c, m in methods.items() if m == "constant"})
        carried: dict[str, list[str]] = {}
        for c, m in methods.items():
            if m not in IMPUTE_METHODS:
                self._lines.append(_LogLine("missing-impute", c, f"Could not impute using '{m}': Unknown method: {m}", None))
                continue
            if m in ("ffill", "bfill") and self.order_by is None:
                self._lines.append(_LogLine("missing-impute", c, f"Could not impute using '{m}': no order column", None))
                continue
            self._mark(_col(c).isNull(), "missing-impute", c, f"Imputed %d missing values using '{m}'")
            if m in ("ffill", "bfill"):
                carried.setdefault(m, []).append(c)
            else:
                self._marked = self._marked.withColumn(c, _filled(self._marked, c, m, values[c]))
        for m, columns in carried.items():  # one pass for all columns of a direction
            alive = self._marked.where(~F.col(self._gone))
            filled = directional_fill(alive, columns, self.order_by, self.options.fill_keys, backward=m == "bfill")
            self._marked = filled.unionByName(self._marked.where(F.col(self._gone)))

    def _correct_types(self) -> None:
        wording = {"numerical": "numeric", "datetime": "datetime"}
        for c in self.columns:
            kind = self.kinds[c].kind
            view = _typed(self._marked, c, kind, self.kinds[c].day_first)
            if view is None:
                continue
            if kind == "boolean":
                self._lines.append(_LogLine("dtype-correction", c, "Coerced to boolean", None))
            else:
                self._mark(
                    _col(c).isNotNull() & view.isNull(), "dtype-correction", c,
                    f"Coerced to {wording[kind]}; %d unparseable values became NaN", only_if_hit=True,
                )
            self._marked = self._marked.withColumn(c, view)

    def _standardise(self) -> None:
        o = self.options
        columns = [c for c in self.columns if self.kinds[c].kind == "categorical" and isinstance(self._marked.schema[c].dataType, T.StringType)]
        if not columns:
            return
        before = {c: f"{self._was}{i}" for i, c in enumerate(columns)}
        kept = self._marked.withColumns({name: _col(c) for c, name in before.items()})
        self._marked = standardise_labels(kept, columns, merge_fuzzy=o.merge_fuzzy, threshold=o.fuzzy_threshold)
        extra = " + fuzzy merge" if o.merge_fuzzy else ""
        for c, name in before.items():
            self._mark(
                ~_col(c).eqNullSafe(F.col(name)), "categorical-standardisation", c,
                f"Normalised %d labels (strip/case{extra})", only_if_hit=True,
            )
        self._marked = self._marked.drop(*before.values())

    def _handle_outliers(self) -> None:
        o = self.options
        if o.outlier_action not in OUTLIER_ACTIONS:
            raise ValueError(f"Unknown outlier action: {o.outlier_action}")
        facts = Facts(self._alive(), kinds=self.kinds, order_by=self.order_by)
        self._marked = facts.with_parsed(self._marked)
        if o.outlier_action == "flag":
            flags = _outlier_flags(facts, o.iqr_factor, o.z_threshold)
            for name, hit in flags.items():
                column = name.removesuffix("_is_outlier")
                self._mark(hit, "outlier-flag", column, f"Added {name.replace('%', '%%')} flagging %d detected outliers")
            self._marked = self._marked.withColumns(flags)
        elif o.outlier_action == "cap":
            fences = facts.fences(o.iqr_factor, MIN_CELLS)
            for c, (low, high) in fences.items():
                x = facts.number(c)
                self._mark(
                    (x < F.lit(low)) | (x > F.lit(high)), "outlier-cap", c,
                    "Winsorized %d values outside IQR bounds to nearest fence",
                )
            self._marked = self._marked.withColumns({c: _capped(facts, c, *fences[c]) for c in fences})
        else:
            hit = _any_outlier(facts, o.iqr_factor)
            self._mark(hit, "outlier-remove", "all", "Removed %d rows flagged as IQR outliers")
            self._marked = self._marked.withColumn(self._gone, F.col(self._gone) | hit)
        self._marked = facts.visible(self._marked)

    # Results.

    @property
    def cleaned(self) -> DataFrame:
        """The cleaned table."""
        return self._alive()

    def log(self, at: dt.datetime | None = None) -> DataFrame:
        """``(seq, timestamp, operation, columns, detail, rows_affected, status)``."""
        stamp = F.lit((at or dt.datetime.now()).strftime("%Y-%m-%d %H:%M:%S"))
        markers = [line.marker for line in self._lines if line.marker and line.marker != "dedup"]
        counts = self._marked.agg(
            F.count(F.lit(1)).alias("kept"),
            F.count_if(~F.col(self._gone)).alias("final"),
            *[F.count_if(F.col(m)).alias(m) for m in markers],
        )
        rows_before = self.source.agg(F.count(F.lit(1)).alias("n")).scalar()
        counts = counts.withColumn("before", rows_before).withColumn("dedup", F.col("before") - F.col("kept"))
        width, final_width = len(self.columns), len([c for c in self.cleaned.columns if c != self.order_by])
        zero = F.lit(0).cast("bigint")
        entries = [("start", "", F.format_string(f"Began cleaning on %d rows x {width} columns", "before"), zero, F.lit(True))]
        for line in self._lines:
            hit = F.col(line.marker).cast("bigint") if line.marker else zero
            literal = line.detail if line.marker is None else None
            detail = F.lit(literal) if literal is not None else F.format_string(line.detail, hit)
            entries.append((line.operation, line.columns, detail, hit, hit > 0 if line.only_if_hit else F.lit(True)))
        entries.append(("end", "", F.format_string(f"Cleaning complete: %d rows x {final_width} columns", "final"), zero, F.lit(True)))
        rows = [
            F.struct(
                F.lit(i).alias("place"), stamp.alias("timestamp"), F.lit(op).alias("operation"), F.lit(cols).alias("columns"),
                detail.alias("detail"), hit.alias("rows_affected"), F.lit("applied").alias("status"), keep.alias("keep"),
            )
            for i, (op, cols, detail, hit, keep) in enumerate(entries)
        ]
        lines = counts.select(F.inline(F.array(*rows))).where("keep")
        return lines.select("place", "timestamp", "operation", "columns", "detail", "rows_affected", "status").orderBy("place")


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows, columns and missing cells of a table before and after cleaning."""

    def line(stage: str, df: DataFrame) -> DataFrame:
        df = comparable(df)
        gaps = sum((F.when(_col(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
        return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(gaps), F.lit(0)).alias("missing_cells")).select(
            F.lit(stage).alias("stage"), "rows", F.lit(len(df.columns)).alias("columns"), "missing_cells"
        )

    return line("before", before).unionByName(line("after", after))
