"""Chart tables and the chart plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayframe.functions.coerce import rounded
from assayframe.operators import chartdata
from assayframe.plans.facts import Facts
from checks.eda_checks import BINS, KNOWN, LINE_PAIRS, PRICED, STATS, _label_ctes, _matrix, priced_lines
from checks.inputs import dirty_orders, read
from checks.profile_checks import KIND_COUNT_SQL
from checks.registry import DIRTY_NUMBERS, LABELLED, LINE_NUMBERS, check, dirty, long, r, round_all, ts


def _histogram(bins: str) -> str:
    ends = f"(SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, {bins} AS bins FROM lineitem)"
    return f"""ends AS {ends},
      placed AS (SELECT least(CAST(floor((l_extendedprice - lo) / ((hi - lo) / bins)) AS BIGINT), bins - 1) AS bin, count(*) AS n FROM lineitem CROSS JOIN ends GROUP BY 1),
      spine AS (SELECT unnest(range(0, bins)) AS bin, lo, hi, bins FROM ends)
    SELECT s.bin, {r('lo + s.bin * ((hi - lo) / bins)', 4)} AS lower, {r('lo + (s.bin + 1) * ((hi - lo) / bins)', 4)} AS upper, coalesce(n, 0) AS n
    FROM spine s LEFT JOIN placed p ON p.bin = s.bin"""


@check("hist_default", f"WITH {_histogram('CAST(20 AS BIGINT)')}")
def _(spark, sf):
    return round_all(chartdata.histogram(read(spark, sf, "lineitem"), "l_extendedprice"), 4)


PRICE_BINS = f"""numbers AS ({long('lineitem', {'l_extendedprice': 'l_extendedprice'}, 'x')}), {KNOWN}, {STATS}, best AS (SELECT {BINS} AS bins FROM stats),"""


@check("hist_bins", f"WITH {PRICE_BINS} {_histogram('(SELECT bins FROM best)')}")
def _(spark, sf):
    return round_all(chartdata.histogram(read(spark, sf, "lineitem"), "l_extendedprice", None), 4)


def _boxes(numbers: str, label: str) -> str:
    return f"""WITH numbers AS ({numbers}), known AS (SELECT * FROM numbers WHERE x IS NOT NULL),
      q AS (SELECT col, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM known GROUP BY col)
    SELECT k.col AS "{label}", {r('any_value(q1)', 4)} AS q1, {r('any_value(q2)', 4)} AS median, {r('any_value(q3)', 4)} AS q3, count(*) AS n, {r('avg(x)', 4)} AS mean, {r('stddev_samp(x)', 4)} AS sd,
      {r('min(x) FILTER (x >= q1 - 1.5 * (q3 - q1))', 4)} AS lower_whisker, {r('max(x) FILTER (x <= q3 + 1.5 * (q3 - q1))', 4)} AS upper_whisker,
      CAST(count_if(x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outside FROM known k JOIN q ON q.col = k.col GROUP BY k.col"""


@check("box_summary", _boxes(long("lineitem", LINE_NUMBERS, "x"), "column"))
def _(spark, sf):
    return round_all(chartdata.box_summary(read(spark, sf, "lineitem")), 4)


@check("grouped_box", _boxes("SELECT event_type AS col, value AS x FROM events", "label"))
def _(spark, sf):
    return round_all(chartdata.grouped_box(read(spark, sf, "events"), "value", "event_type"), 4)


@check("bar", dirty('SELECT priority_txt AS "value", count(*) AS n FROM d GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15'))
def _(spark, sf):
    return chartdata.bar(dirty_orders(spark, sf), "priority_txt")


@check("pie_other", dirty("""SELECT CASE WHEN place <= 10 THEN v ELSE 'Other' END AS "value", CAST(sum(n) AS BIGINT) AS n FROM
  (SELECT priority_txt AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, priority_txt) AS place FROM d GROUP BY 1) GROUP BY 1"""))
def _(spark, sf):
    return chartdata.pie_other(dirty_orders(spark, sf), "priority_txt")


@check("bool_breakdown", dirty('SELECT active AS "value", count(*) AS n FROM d GROUP BY 1'))
def _(spark, sf):
    return chartdata.bool_breakdown(dirty_orders(spark, sf), "active")


@check("kind_bar", KIND_COUNT_SQL)
def _(spark, sf):
    return chartdata.kind_bar(dirty_orders(spark, sf))


DAYS = f"""rows AS (SELECT CAST({ts('date_txt')} AS DATE) AS day, total AS x FROM d),"""


def _spine(table: str) -> str:
    return f"spine AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM {table}), (SELECT max(day) FROM {table}), INTERVAL 1 DAY)) AS DATE) AS day)"


@check("daily_counts", dirty(
    "SELECT s.day, coalesce(n, 0) AS n FROM spine s LEFT JOIN counted c ON c.day = s.day",
    DAYS + "counted AS (SELECT day, count(*) AS n FROM rows WHERE day IS NOT NULL GROUP BY 1)", _spine("counted")))
def _(spark, sf):
    return chartdata.daily_counts(dirty_orders(spark, sf), "date_txt")


@check("value_over_time", dirty(
    f'SELECT s.day AS period, {r("m")} AS "value" FROM spine s LEFT JOIN meaned c ON c.day = s.day',
    DAYS + "meaned AS (SELECT day, avg(x) AS m FROM rows WHERE day IS NOT NULL AND x IS NOT NULL GROUP BY 1)", _spine("meaned")))
def _(spark, sf):
    return round_all(chartdata.value_over_time(dirty_orders(spark, sf), "date_txt", "total"))


HOT_DAY = "CASE WHEN o_orderkey % 3 = 0 THEN DATE '1996-02-29' ELSE CAST(o_orderdate AS DATE) END"


@check("value_median_hot_day", f"""WITH t AS (SELECT {HOT_DAY} AS day, o_totalprice AS x FROM orders),
spine AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM t),
m AS (SELECT day, quantile_cont(x, 0.5) AS m FROM t GROUP BY 1)
SELECT s.day AS period, {r("m")} AS "value" FROM spine s LEFT JOIN m ON m.day = s.day""")
def _(spark, sf):
    orders = read(spark, sf, "orders").selectExpr(f"{HOT_DAY} AS day", "o_totalprice AS price")
    return round_all(chartdata.value_over_time(orders, "day", "price", how="median"))


@check("ols_trend", f"""WITH {PRICED} SELECT l_returnflag AS color, count(*) AS n, {r('regr_slope(net, gross)')} AS slope, {r('regr_intercept(net, gross)', 4)} AS intercept,
  {r('regr_r2(net, gross)')} AS r2 FROM priced WHERE net IS NOT NULL AND gross IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    found = chartdata.ols_trend(priced_lines(spark, sf), "gross", "net", "l_returnflag")
    return round_all(found.withColumn("intercept", rounded(F.col("intercept"), 4)))


@check("scatter_sample", """SELECT o_orderkey AS key, CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y, o_orderstatus AS color FROM orders
  WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 8000""")
def _(spark, sf):
    return chartdata.scatter_sample(read(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderkey", "o_orderstatus")


@check("correlation_heatmap", f"WITH {LINE_PAIRS} SELECT x, y, {r('r', 3)} AS r FROM ({_matrix(LINE_NUMBERS)})")
def _(spark, sf):
    return chartdata.correlation_heatmap(read(spark, sf, "lineitem"))


@check("scatter_matrix_cols", f"""WITH numbers AS ({long('lineitem', LINE_NUMBERS, 'x')})
  SELECT col AS "column", {r('var_samp(x)', 2)} AS variance FROM numbers GROUP BY col ORDER BY var_samp(x) DESC LIMIT 6""")
def _(spark, sf):
    return round_all(chartdata.scatter_matrix_columns(read(spark, sf, "lineitem")), 2)


@check("composition", dirty("""SELECT x, y, n FROM crossed WHERE y IN (SELECT y FROM crossed GROUP BY y ORDER BY sum(n) DESC, y LIMIT 6)""",
    "top AS (SELECT status AS v FROM d GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8)",
    "crossed AS (SELECT status AS x, priority_txt AS y, count(*) AS n FROM d WHERE status IN (SELECT v FROM top) AND priority_txt IS NOT NULL GROUP BY 1, 2)"))
def _(spark, sf):
    return chartdata.composition(dirty_orders(spark, sf), "status", "priority_txt")


@check("interesting_cat", dirty("""SELECT CAST(pos AS INTEGER) AS seq, "column", n_unique,
  CAST(CASE WHEN n_unique < 2 THEN 0 WHEN n_unique <= 12 THEN 100 WHEN n_unique <= 50 THEN 50 ELSE 20 END AS INTEGER) AS score FROM judged""",
    *_label_ctes("d", LABELLED)))
def _(spark, sf):
    return chartdata.interesting_categories(dirty_orders(spark, sf))


@check("chart_plan", dirty(f"""SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS INTEGER) AS seq, chart, columns, reason FROM (
  SELECT 0 AS place, 'histogram' AS chart, arg_max(col, (abs(sk), -pos)) AS columns,
    'Numeric column; distribution classified as ''' || arg_max(label, (abs(sk), -pos)) || '''' AS reason FROM shapes
  UNION ALL SELECT 1, 'scatter matrix', string_agg(col, ', ' ORDER BY pos), 'Multiple numeric columns — multivariate view' FROM shapes HAVING count(*) >= 2
  UNION ALL SELECT 2, 'box plots', string_agg(col, ', ' ORDER BY pos), 'Compare scale/outliers across numeric columns' FROM shapes HAVING count(*) >= 2
  UNION ALL SELECT 3, 'bar', "column", 'Categorical column — ranks the most frequent values' FROM best
  UNION ALL SELECT 4, 'pie', arg_min("column", pos), 'Categorical column with modest cardinality — share view' FROM judged WHERE "column" NOT IN (SELECT "column" FROM best)
  UNION ALL SELECT 5, 'donut', 'active', 'Boolean distribution'
  UNION ALL SELECT 6, 'time series', 'date_txt, ' || arg_min(col, pos), 'Datetime column detected — trend over time' FROM shapes
  UNION ALL SELECT 7, 'correlation heatmap', string_agg(col, ', ' ORDER BY pos), 'Pairwise linear relationships between numeric columns' FROM shapes)""",
    f"numbers AS ({long('d', DIRTY_NUMBERS, 'x')})", KNOWN, STATS,
    """shapes AS (SELECT pos, col, sk, CASE WHEN abs(sk) < 0.3 AND abs(ku) < 0.5 THEN 'roughly normal / symmetric' WHEN abs(sk) < 0.3 THEN 'symmetric'
      WHEN sk > 1 THEN 'strongly skewed right (right tail)' WHEN sk < -1 THEN 'strongly skewed left (left tail)' ELSE 'mildly skewed' END AS label FROM stats)""",
    *_label_ctes("d", LABELLED),
    """best AS (SELECT "column" FROM judged ORDER BY CASE WHEN n_unique < 2 THEN 0 WHEN n_unique <= 12 THEN 100 WHEN n_unique <= 50 THEN 50 ELSE 20 END DESC, pos LIMIT 1)"""))
def _(spark, sf):
    return chartdata.chart_plan(Facts(dirty_orders(spark, sf)))
