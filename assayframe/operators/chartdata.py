"""The aggregate tables behind each chart, and the choice of charts. Nothing is drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayframe.functions.coerce import rounded
from assayframe.functions.stats import histogram_bins
from assayframe.operators.eda import category_labels, correlation_matrix, numeric_shape, strong_relationships
from assayframe.operators.kinds import Kind
from assayframe.operators.outliers import IQR_FACTOR
from assayframe.plans.facts import Facts
from assayframe.plans.frequency import top_per_group
from assayframe.plans.quantiles import exact_quantiles, grouped_medians
from assayframe.plans.wide import long_aggregate, small_frame

# Chart sizes.
DEFAULT_BINS = 20
BAR_LABELS = 15
PIE_LABELS = 10
BOX_GROUPS = 10
STACK_X = 8
STACK_Y = 6
MATRIX_COLUMNS = 6
DAILY_ABOVE = 40
SCATTER_ROWS = 8_000
PIE_CARDINALITY = 20


# -- single columns -------------------------------------------------------------


def _only(table: Facts | DataFrame, column: str) -> Facts:
    """Facts of one named numerical column, which needs neither the kinds nor the summary of the others."""
    if isinstance(table, Facts):
        return table
    return Facts(table.select(F.col(f"`{column}`")), kinds={column: Kind(column, "numerical", 1.0, "named by the caller", "")})


def suggested_bins(table: Facts | DataFrame, column: str) -> int:
    """Freedman-Diaconis bin count of one column."""
    facts = _only(table, column)
    quartiles, seen = facts.quantiles([0.25, 0.75], [column])[column], facts.summary[column]
    if not quartiles:
        return DEFAULT_BINS
    row = small_frame(
        facts.table.sparkSession, [(seen["numbers"], seen["high"] - seen["low"], quartiles[0.75] - quartiles[0.25])],
        "n bigint, spread double, iqr double",
    )
    return row.select(histogram_bins(F.col("n"), F.col("spread"), F.col("iqr"))).first()[0]


def histogram(table: Facts | DataFrame, column: str, bins: int | None = DEFAULT_BINS) -> DataFrame:
    """``(bin, lower, upper, n)`` with equal widths; the last bin is closed, empty bins are 0.

    ``bins=None`` uses the suggested count.
    """
    facts = _only(table, column)
    bins = bins or suggested_bins(facts, column)
    low, high = facts.summary[column]["low"], facts.summary[column]["high"]
    spark = facts.df.sparkSession
    if low is None:
        return small_frame(spark, [], "bin bigint, lower double, upper double, n bigint")
    width = (high - low) / bins if high > low else 1.0
    x = facts.number(column)
    place = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1).cast("bigint"))
    counts = facts.df.where(x.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("found"))
    return (
        spark.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left")
        .select("bin", (F.lit(low) + F.col("bin") * width).alias("lower"), (F.lit(low) + (F.col("bin") + 1) * width).alias("upper"),
                F.coalesce("found", F.lit(0)).alias("n"))
    )


def _box_rows(df: DataFrame, boxes: list[tuple[dict, Column, float, float, float]]) -> DataFrame:
    """Whiskers, moments and points outside for views with known quartiles."""
    entries = []
    for labels, x, q1, median, q3 in boxes:
        low, high = q1 - IQR_FACTOR * (q3 - q1), q3 + IQR_FACTOR * (q3 - q1)
        within = F.when((x >= F.lit(low)) & (x <= F.lit(high)), x)
        entries.append((
            {**labels, "q1": q1, "median": median, "q3": q3},
            {"n": F.count(x), "mean": F.avg(x), "sd": F.stddev_samp(x), "lower_whisker": F.min(within),
             "upper_whisker": F.max(within), "outside": F.count_if((x < F.lit(low)) | (x > F.lit(high)))},
        ))
    return long_aggregate(df, entries)


BOX_SCHEMA = "q1 double, median double, q3 double, n bigint, mean double, sd double, lower_whisker double, upper_whisker double, outside bigint"


def box_summary(table: Facts | DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Quartiles, whiskers and points outside for each numerical column."""
    facts = Facts.of(table)
    columns = [c for c in (columns or facts.numeric) if facts.summary[c]["numbers"]]
    found = facts.quantiles([0.25, 0.5, 0.75], columns)
    boxes = [({"column": c}, facts.number(c), found[c][0.25], found[c][0.5], found[c][0.75]) for c in columns]
    if not boxes:
        return small_frame(facts.df.sparkSession, [], f"column string, {BOX_SCHEMA}")
    return _box_rows(facts.df, boxes)


def _top_labels(facts: Facts, column: str, top: int) -> list[str]:
    """The most frequent labels: at most ``top`` values, so they may be literals."""
    ranked = facts.counts([column]).orderBy(F.desc("n"), F.asc("value")).limit(top)
    return [r["value"] for r in ranked.collect()]


def grouped_box(table: Facts | DataFrame, number: str, label: str, top: int = BOX_GROUPS) -> DataFrame:
    """Box summary of a number within each of the most frequent labels.

    Each label becomes a view of the number, so a label that fills a third of
    the table gets its quantiles the same distributed way as a whole column.
    """
    facts = Facts.of(table)
    x, text = facts.number(number), facts.text(label)
    views = {v: F.when(text == v, x) for v in _top_labels(facts, label, top)}
    empty = small_frame(facts.table.sparkSession, [], f"label string, {BOX_SCHEMA}")
    if not views:
        return empty
    entries = [({"label": v}, {"n": F.count(view), "low": F.min(view), "high": F.max(view)}) for v, view in views.items()]
    counts = {r["label"]: (r["n"], r["low"], r["high"]) for r in long_aggregate(facts.cells, entries).collect()}
    found = exact_quantiles(facts.cells, views, [0.25, 0.5, 0.75], counts)
    boxes = [({"label": v}, views[v], q[0.25], q[0.5], q[0.75]) for v, q in found.items() if q]
    return _box_rows(facts.cells, boxes) if boxes else empty


def bar(table: Facts | DataFrame, column: str, top: int = BAR_LABELS) -> DataFrame:
    """``(value, n)`` of the most frequent labels."""
    facts = Facts.of(table)
    return facts.counts([column]).orderBy(F.desc("n"), F.asc("value")).limit(top).select("value", "n")


def pie_other(table: Facts | DataFrame, column: str, top: int = PIE_LABELS) -> DataFrame:
    """``(value, n)`` of the most frequent labels, everything else as ``Other``."""
    facts = Facts.of(table)
    names = _top_labels(facts, column, top)
    counts = facts.counts([column])
    slices = counts.where(F.col("value").isin(names)).select("value", "n")
    rest = counts.where(~F.col("value").isin(names)).agg(F.sum("n").alias("n")).where(F.col("n") > 0)
    return slices.unionByName(rest.select(F.lit("Other").alias("value"), "n"))


def bool_breakdown(table: Facts | DataFrame, column: str) -> DataFrame:
    """``(value, n)`` of a boolean column's spellings."""
    return Facts.of(table).counts([column]).select("value", "n")


def kind_bar(table: Facts | DataFrame) -> DataFrame:
    """Columns per kind."""
    from assayframe.operators.profile import kind_counts

    return kind_counts(table)


# -- over time --------------------------------------------------------------------


def _spine(periods: DataFrame, step: str) -> DataFrame:
    """Every period between the first and the last one."""
    ends = periods.agg(F.min("period").alias("first"), F.max("period").alias("last"))
    return ends.where(F.col("first").isNotNull()).select(F.explode(F.sequence("first", "last", F.expr(step))).alias("period"))


def daily_counts(table: Facts | DataFrame, date: str) -> DataFrame:
    """``(day, n)`` rows per calendar day, days without rows as 0."""
    facts = Facts.of(table)
    day = F.to_date(facts.timestamp(date))
    counts = facts.cells.where(day.isNotNull()).groupBy(day.alias("period")).agg(F.count(F.lit(1)).alias("n"))
    return _spine(counts, "interval 1 day").join(counts, "period", "left").select(
        F.col("period").alias("day"), F.coalesce("n", F.lit(0)).alias("n")
    )


def value_over_time(table: Facts | DataFrame, date: str, value: str, how: str = "mean", daily_above: int = DAILY_ABOVE) -> DataFrame:
    """``(period, value)`` per day, or per year for tables of at most ``daily_above`` rows; empty periods are NULL.

    ``how`` is one of mean, sum, min, max, count and median.
    """
    facts = Facts.of(table)
    stamp, x = facts.timestamp(date), facts.number(value)
    rows = facts.cells.select(stamp.alias("t"), x.alias("x")).where(F.col("t").isNotNull() & F.col("x").isNotNull())
    daily = rows.limit(daily_above + 1).count() > daily_above
    period = (F.to_date("t") if daily else F.to_date(F.date_trunc("year", "t"))).alias("period")
    if how == "median":
        grouped = grouped_medians(rows.select(period, F.col("x").alias("value")), "period", "value")
    else:
        aggregate = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[how]("x")
        grouped = rows.groupBy(period).agg(aggregate.alias("value"))
    return _spine(grouped, "interval 1 day" if daily else "interval 1 year").join(grouped, "period", "left").select("period", "value")


# -- pairs ----------------------------------------------------------------------------


def ols_trend(table: Facts | DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """``(color, n, slope, intercept, r2)`` of the least-squares line per colour."""
    facts = Facts.of(table)
    a, b = facts.number(x), facts.number(y)
    shade = facts.text(color) if color else F.lit("all")
    rows = facts.cells.select(shade.alias("color"), a.alias("a"), b.alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    sums = rows.groupBy("color").agg(
        F.count(F.lit(1)).alias("n"), F.avg("a").alias("ma"), F.avg("b").alias("mb"),
        F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"), F.covar_pop("a", "b").alias("cab"),
    )
    slope = F.when(F.col("va") > 0, F.col("cab") / F.col("va"))
    return sums.select(
        "color", "n", slope.alias("slope"), (F.col("mb") - slope * F.col("ma")).alias("intercept"),
        F.when((F.col("va") > 0) & (F.col("vb") > 0), F.col("cab") * F.col("cab") / (F.col("va") * F.col("vb"))).alias("r2"),
    )


def scatter_sample(table: Facts | DataFrame, x: str, y: str, key: str, color: str | None = None, rows: int = SCATTER_ROWS) -> DataFrame:
    """A repeatable sample of plottable points: those with the smallest key hashes."""
    facts = Facts.of(table)
    shade = [facts.text(color).alias("color")] if color else []
    points = facts.cells.select(F.col(key).alias("key"), facts.number(x).alias("x"), facts.number(y).alias("y"), *shade)
    return points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).orderBy(F.md5(F.col("key").cast("string")), "key").limit(rows)


def correlation_heatmap(table: Facts | DataFrame) -> DataFrame:
    """The correlation matrix rounded for display."""
    return correlation_matrix(table).select("x", "y", rounded(F.col("r"), 3).alias("r"))


def scatter_matrix_columns(table: Facts | DataFrame, top: int = MATRIX_COLUMNS) -> DataFrame:
    """The numerical columns that vary most."""
    facts = Facts.of(table)
    n = F.col("numbers")
    variance = F.when(n > 1, F.col("sigma") * F.col("sigma") * n / (n - 1))
    ranked = facts.summary_frame.where(F.col("kind") == "numerical").select("column", "pos", variance.alias("variance"))
    return ranked.orderBy(F.desc_nulls_last("variance"), "pos").limit(top).select("column", "variance")


def composition(table: Facts | DataFrame, x: str, y: str, top_x: int = STACK_X, top_y: int = STACK_Y) -> DataFrame:
    """``(x, y, n)`` over the most frequent labels of x and, within those, of y."""
    facts = Facts.of(table)
    a, b = facts.text(x), facts.text(y)
    counts = (
        facts.cells.where(a.isin(_top_labels(facts, x, top_x)) & b.isNotNull())
        .groupBy(a.alias("x"), b.alias("y")).agg(F.count(F.lit(1)).alias("n"))
    )
    keep = counts.groupBy("y").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), F.asc("y")).limit(top_y).select("y")
    return counts.join(keep, "y", "left_semi").select("x", "y", "n")


# -- choosing ---------------------------------------------------------------------------


def interesting_categories(table: Facts | DataFrame) -> DataFrame:
    """``(seq, column, n_unique, score)``: label columns, the most chart-worthy first."""
    facts = Facts.of(table)
    n = F.col("n_unique")
    score = F.when(n < 2, 0).when(n <= 12, 100).when(n <= 50, 50).otherwise(20)
    places = small_frame(facts.df.sparkSession, [(i, c) for i, c in enumerate(facts.labelled)], "seq int, column string")
    return (
        places.join(category_labels(facts).select("column", "n_unique"), "column")
        .select("seq", "column", "n_unique", score.alias("score")).orderBy(F.desc("score"), "seq")
    )


# The charts in their order, each with its condition, the columns it shows and its reason, over the fields of ``_choice``.
CHART_RULES = [
    ("'histogram'", "steepest IS NOT NULL", "steepest.column", "concat('Numeric column; distribution classified as \\'', steepest.label, '\\'')"),
    ("'scatter matrix'", "size(shapes) > 1", "array_join(numeric, ', ')", "'Multiple numeric columns — multivariate view'"),
    ("'box plots'", "size(numeric) > 1", "array_join(numeric, ', ')", "'Compare scale/outliers across numeric columns'"),
    ("'bar'", "best IS NOT NULL", "best.column", "'Categorical column — ranks the most frequent values'"),
    ("'pie'", f"other.n_unique <= {PIE_CARDINALITY}", "other.column", "'Categorical column with modest cardinality — share view'"),
    ("'donut'", "size(booleans) > 0", "booleans[0]", "'Boolean distribution'"),
    ("'time series'", "size(dates) > 0", "concat_ws(', ', dates[0], get(numeric, 0))", "'Datetime column detected — trend over time'"),
    ("'correlation heatmap'", "size(numeric) > 0", "array_join(numeric, ', ')", "'Pairwise linear relationships between numeric columns'"),
    ("CASE strongest.type WHEN 'num-num' THEN 'scatter' WHEN 'num-cat' THEN 'grouped box' ELSE 'stacked bar' END", "strongest IS NOT NULL",
     "concat_ws(', ', strongest.x, strongest.y)", "format_string('%s = %.2f (%s)', strongest.metric_name, strongest.metric, strongest.detail)"),
]


def _choice(facts: Facts) -> DataFrame:
    """One row with what the rules ask for: names by kind, the steepest distribution, the best labels, the strongest association."""
    def names(*kinds: str) -> Column:
        return F.array(*[F.lit(c) for c in facts.of_kind(*kinds)]).cast("array<string>")

    steep = F.when(F.abs("skew") < float("inf"), F.abs("skew")).otherwise(0.0)
    shapes = numeric_shape(facts).agg(F.collect_list(F.struct(steep.alias("steep"), (-F.col("seq")).alias("place"), "column", F.col("distribution_label").alias("label"))).alias("shapes"))
    if facts.labelled:
        labels = interesting_categories(facts).agg(F.collect_list(F.struct((-F.col("score")).alias("rank"), "seq", "column", "n_unique")).alias("labels"))
    else:
        labels = small_frame(facts.df.sparkSession, [(1,)], "one int").select(F.array().cast("array<struct<rank:int,seq:int,column:string,n_unique:bigint>>").alias("labels"))
    strong = strong_relationships(facts).withColumn("order", -F.abs("metric"))
    strongest = strong.agg(F.min(F.struct("order", "type", "x", "y", "metric", "metric_name", "detail")).alias("strongest"))
    # three rows of one line each
    return (
        shapes.join(F.broadcast(labels), F.lit(True)).join(F.broadcast(strongest), F.lit(True))
        .withColumns({"numeric": names("numerical"), "booleans": names("boolean"), "dates": names("datetime")})
        .withColumns({"steepest": F.array_max("shapes"), "best": F.array_min("labels")})
        .withColumn("other", F.expr("array_min(transform(filter(labels, l -> l.column <> best.column), l -> struct(l.seq, l.column, l.n_unique)))"))
    )


def chart_plan(table: Facts | DataFrame, max_charts: int | None = None) -> DataFrame:
    """``(seq, chart, columns, reason)``: the charts worth drawing, in fixed order; all unless ``max_charts`` is given."""
    rules = ", ".join(f"IF({when}, struct({chart} AS chart, {columns} AS columns, {reason} AS reason), NULL)" for chart, when, columns, reason in CHART_RULES)
    chosen = _choice(Facts.of(table)).select(F.posexplode(F.expr(f"filter(array({rules}), r -> r IS NOT NULL)")).alias("seq", "r")).select("seq", "r.*")
    return chosen if max_charts is None else chosen.where(F.col("seq") < max_charts)
