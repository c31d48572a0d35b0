"""Distribution statistics and associations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from assayframe.operators import eda
from checks.inputs import dirty_orders, read
from checks.registry import DIRTY_NUMBERS, LABELLED, LINE_NUMBERS, check, dirty, long, pct, r, round_all


def priced_lines(spark, sf):
    """Line items with derived columns that are strongly related to the given ones."""
    return read(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice",
        (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("gross"),
        F.when(F.col("l_orderkey") % 13 != 0, F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        F.when(F.col("l_quantity") <= 15, "small").when(F.col("l_quantity") <= 35, "medium").otherwise("large").alias("size"),
        "l_returnflag", F.concat(F.lit("flag "), F.lower("l_returnflag")).alias("flag_text"), "l_linestatus",
    )


PRICED = """priced AS (SELECT l_quantity, l_extendedprice, l_extendedprice * (1 + l_tax) AS gross,
  CASE WHEN l_orderkey % 13 <> 0 THEN l_extendedprice * (1 - l_discount) END AS net,
  CASE WHEN l_quantity <= 15 THEN 'small' WHEN l_quantity <= 35 THEN 'medium' ELSE 'large' END AS size,
  l_returnflag, 'flag ' || lower(l_returnflag) AS flag_text, l_linestatus FROM lineitem)"""
PRICED_NUMBERS = {c: c for c in ("l_quantity", "l_extendedprice", "gross", "net")}
PRICED_LABELS = {c: c for c in ("size", "l_returnflag", "flag_text", "l_linestatus")}

# -- single columns ---------------------------------------------------------------------

KNOWN = "known AS (SELECT pos, col, x FROM numbers WHERE x IS NOT NULL)"
STATS = """stats AS (SELECT any_value(pos) AS pos, col, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi,
  quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3,
  CASE WHEN count(*) > 2 THEN coalesce(skewness(x), 0) END AS sk, CASE WHEN count(*) > 3 THEN coalesce(kurtosis(x), 0) END AS ku FROM known GROUP BY col),
modes AS (SELECT col, arg_min(x, (-n, x)) AS mode FROM (SELECT col, x, count(*) AS n FROM known GROUP BY col, x) GROUP BY col)"""
SHAPE = """CASE WHEN sk IS NULL THEN 'unknown' WHEN abs(sk) < 0.3 AND abs(ku) < 0.5 THEN 'roughly normal / symmetric'
  WHEN abs(sk) < 0.3 THEN CASE WHEN ku > 1 THEN 'symmetric with heavy tails' ELSE 'symmetric' END
  WHEN sk > 1 THEN 'strongly skewed right (right tail)' WHEN sk < -1 THEN 'strongly skewed left (left tail)'
  WHEN sk > 0 THEN 'mildly skewed right' ELSE 'mildly skewed left' END"""
BINS = """CAST(CASE WHEN n < 30 THEN greatest(5, n // 5)
  ELSE greatest(5, least(50, ceil((hi - lo) / (2.0 * greatest(q3 - q1, 1e-9) / pow(n, 1.0 / 3.0))))) END AS BIGINT)"""
DESCRIBE_BODY = f"""SELECT s.col AS "column", n AS "count", {r('mean')} AS mean, {r('sd')} AS std, lo AS "min", {r('q1')} AS q25, {r('q2')} AS q50, {r('q3')} AS q75,
  hi AS "max", {r('sd * sd', 2)} AS variance, {r('sk')} AS skew, {r('ku')} AS kurtosis, {r('q2')} AS median, {r('hi - lo')} AS "range",
  CASE WHEN mean <> 0 THEN {r('sd / mean')} END AS cv, {SHAPE} AS distribution_label, {BINS} AS histogram_bins, mode
  FROM stats s JOIN modes m ON m.col = s.col"""


def _describe(table):
    from assayframe.functions.coerce import rounded

    found = eda.describe(table).withColumn("variance", rounded(F.col("variance"), 2))
    return round_all(found)


@check("numeric_describe", f"WITH numbers AS ({long('lineitem', LINE_NUMBERS, 'x')}), {KNOWN}, {STATS} {DESCRIBE_BODY}")
def _(spark, sf):
    return _describe(read(spark, sf, "lineitem"))


EVENT_NUMBERS = {c: f"CAST({c} AS DOUBLE)" for c in ("event_id", "user_id", "value")}


@check("numeric_describe_events", f"WITH numbers AS ({long('events', EVENT_NUMBERS, 'x')}), {KNOWN}, {STATS} {DESCRIBE_BODY}")
def _(spark, sf):
    return _describe(read(spark, sf, "events"))


@check("distribution_label", dirty(f"SELECT col AS \"column\", {SHAPE} AS distribution_label FROM stats", f"numbers AS ({long('d', DIRTY_NUMBERS, 'x')})", KNOWN, STATS))
def _(spark, sf):
    return eda.numeric_shape(dirty_orders(spark, sf)).select("column", "distribution_label")


@check("optimal_bins", dirty(f"SELECT col AS \"column\", {BINS} AS histogram_bins FROM stats", f"numbers AS ({long('d', DIRTY_NUMBERS, 'x')})", KNOWN, STATS))
def _(spark, sf):
    return eda.numeric_shape(dirty_orders(spark, sf)).select("column", "histogram_bins")


def _label_ctes(table: str, views: dict[str, str]) -> list[str]:
    return [
        f"labels AS ({long(table, views)})",
        f"total AS (SELECT count(*) AS rows FROM {table})",
        "counts AS (SELECT pos, col, v, count(*) AS n FROM labels WHERE v IS NOT NULL GROUP BY pos, col, v)",
        f"""judged AS (SELECT any_value(pos) AS pos, col AS "column", count(*) AS n_unique, {r('count(*) / CAST(any_value(rows) AS DOUBLE)', 3)} AS cardinality,
          {pct('max(n)', 'any_value(rows)')} AS dominant_share,
          CASE WHEN count(*) <= 1 THEN 'constant (single value)' WHEN 100.0 * max(n) / any_value(rows) > 70 THEN 'dominated by one category'
            WHEN count(*) / CAST(any_value(rows) AS DOUBLE) > 0.4 AND count(*) > 40 THEN 'high-cardinality / long-tail'
            WHEN max(n) / CAST(min(n) AS DOUBLE) < 1.5 AND count(*) > 4 THEN 'roughly balanced' ELSE 'concentrated in few categories' END AS distribution_label
          FROM counts CROSS JOIN total GROUP BY col)""",
    ]


SUMMARY_BODY = f"""SELECT j.* EXCLUDE (pos), CAST(place AS INTEGER) AS "rank", v AS "value", n AS "count", {pct('n', '(SELECT rows FROM total)')} AS percentage
  FROM judged j JOIN (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS place FROM counts) c ON c.col = j."column" WHERE place <= 15"""
EVENT_LABELS = {"event_type": "event_type", "props": "props"}


@check("category_labels", dirty("SELECT * EXCLUDE (pos) FROM judged", *_label_ctes("d", LABELLED)))
def _(spark, sf):
    return eda.category_labels(dirty_orders(spark, sf))


@check("category_summary", dirty(SUMMARY_BODY, *_label_ctes("d", LABELLED)))
def _(spark, sf):
    return eda.category_summary(dirty_orders(spark, sf))


@check("category_summary_events", "WITH " + ", ".join(_label_ctes("events", EVENT_LABELS)) + SUMMARY_BODY)
def _(spark, sf):
    return eda.category_summary(read(spark, sf, "events"))


# -- numbers with numbers ---------------------------------------------------------------


def _pairs(table: str, numbers: dict[str, str]) -> str:
    parts = []
    for (a, x), (b, y) in combinations(numbers.items(), 2):
        parts.append(
            f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, CASE WHEN stddev_pop(p) > 0 AND stddev_pop(q) > 0 THEN corr(p, q) END AS r "
            f"FROM (SELECT {x} AS p, {y} AS q FROM {table}) WHERE p IS NOT NULL AND q IS NOT NULL"
        )
    return f"pairs AS ({' UNION ALL '.join(parts)})"


LINE_PAIRS = _pairs("lineitem", LINE_NUMBERS)
PRICED_PAIRS = _pairs("priced", PRICED_NUMBERS)
STRENGTH = "CASE WHEN abs({0}) >= 0.85 THEN 'very strong' WHEN abs({0}) >= 0.65 THEN 'strong' WHEN abs({0}) >= 0.4 THEN 'moderate' WHEN abs({0}) >= 0.2 THEN 'weak' ELSE 'very weak' END"
SIGN = "CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END"
WORDS = f"{STRENGTH.format('r')} || ' ' || {SIGN} || ' linear relationship'"


@check("correlation_pairs", f"WITH {PRICED}, {PRICED_PAIRS} SELECT x, y, n, {r('r')} AS r FROM pairs")
def _(spark, sf):
    return round_all(eda.correlation_pairs(priced_lines(spark, sf)))


def _matrix(numbers: dict[str, str]) -> str:
    own = " UNION ALL ".join(f"SELECT '{c}', '{c}', 1.0" for c in numbers)
    return f"SELECT x, y, {r('r')} AS r FROM pairs UNION ALL SELECT y, x, {r('r')} FROM pairs UNION ALL {own}"


@check("correlation_matrix", f"WITH {LINE_PAIRS} {_matrix(LINE_NUMBERS)}")
def _(spark, sf):
    return round_all(eda.correlation_matrix(read(spark, sf, "lineitem")))


@check("top_correlations", f"WITH {LINE_PAIRS} SELECT x, y, {r('r')} AS r, {SIGN} AS direction, {WORDS} AS detail FROM pairs ORDER BY abs(pairs.r) DESC, x, y LIMIT 10")
def _(spark, sf):
    return round_all(eda.top_correlations(read(spark, sf, "lineitem")))


# -- labels ---------------------------------------------------------------------------------


def _eta(table: str, numbers: dict[str, str], labels: dict[str, str]) -> str:
    parts = []
    for cat, level in labels.items():
        for name, x in numbers.items():
            parts.append(f"""SELECT '{cat}' AS cat, '{name}' AS num, CAST(sum(n) AS BIGINT) AS n,
              sqrt(greatest(0, least(1, sum(n * (m - gm) * (m - gm)) / (any_value(gn) * any_value(gv))))) AS eta
              FROM (SELECT {level} AS l, count({x}) AS n, avg({x}) AS m FROM {table} WHERE {level} IS NOT NULL AND ({x}) IS NOT NULL GROUP BY 1)
              CROSS JOIN (SELECT avg({x}) AS gm, var_samp({x}) AS gv, count({x}) AS gn FROM {table} WHERE {level} IS NOT NULL AND ({x}) IS NOT NULL)""")
    return f"etas AS ({' UNION ALL '.join(parts)})"


@check("eta", f"WITH {_eta('lineitem', LINE_NUMBERS, {c: c for c in ('l_returnflag', 'l_linestatus')})} SELECT cat, num, n, {r('eta')} AS eta FROM etas")
def _(spark, sf):
    return round_all(eda.eta(read(spark, sf, "lineitem")))


@check("eta_dirty", dirty(f"SELECT cat, num, n, {r('eta')} AS eta FROM etas", _eta("d", DIRTY_NUMBERS, LABELLED)))
def _(spark, sf):
    return round_all(eda.eta(dirty_orders(spark, sf)))


def _tables(table: str, labels: dict[str, str]) -> str:
    parts = [
        f"SELECT '{x}' AS x, '{y}' AS y, {x} AS a, {y} AS b, count(*) AS n FROM {table} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY {x}, {y}"
        for x, y in combinations(labels, 2)
    ]
    return f"""crossed AS ({' UNION ALL '.join(parts)}),
margins AS (SELECT *, sum(n) OVER (PARTITION BY x, y, a) AS ra, sum(n) OVER (PARTITION BY x, y, b) AS cb, sum(n) OVER (PARTITION BY x, y) AS t FROM crossed),
full_grid AS (SELECT r.x, r.y, r.a, c.b, r.ra * c.cb / CAST(r.t AS DOUBLE) AS expected, r.t FROM
  (SELECT DISTINCT x, y, a, ra, t FROM margins) r JOIN (SELECT DISTINCT x, y, b, cb FROM margins) c ON c.x = r.x AND c.y = r.y),
vs AS (SELECT g.x, g.y, CAST(any_value(t) AS BIGINT) AS n, sqrt(sum(pow(coalesce(o.n, 0) - expected, 2) / expected) / (any_value(t) * (least(count(DISTINCT g.a), count(DISTINCT g.b)) - 1))) AS v
  FROM full_grid g LEFT JOIN crossed o ON o.x = g.x AND o.y = g.y AND o.a = g.a AND o.b = g.b GROUP BY g.x, g.y)"""


DIRTY_TABLES = _tables("d", LABELLED)


@check("contingency", dirty("SELECT * FROM crossed", DIRTY_TABLES))
def _(spark, sf):
    return eda.contingency(dirty_orders(spark, sf))


@check("cramers_v", dirty(f"SELECT x, y, n, {r('v')} AS v FROM vs", DIRTY_TABLES))
def _(spark, sf):
    return round_all(eda.cramers_v(dirty_orders(spark, sf)))


@check("cramers_v_lines", f"WITH {PRICED}, {_tables('priced', PRICED_LABELS)} SELECT x, y, n, {r('v')} AS v FROM vs")
def _(spark, sf):
    return round_all(eda.cramers_v(priced_lines(spark, sf)))


# -- all associations -------------------------------------------------------------------------

RELATED = [
    PRICED, PRICED_PAIRS, _eta("priced", PRICED_NUMBERS, PRICED_LABELS), _tables("priced", PRICED_LABELS),
    f"""related AS (SELECT * FROM (SELECT 'num-num' AS "type", x, y, r AS metric, 'Pearson corr' AS metric_name, {SIGN} AS direction, {WORDS} AS detail
      FROM pairs WHERE r IS NOT NULL)
    UNION ALL SELECT 'num-cat', cat, num, eta, 'Eta (association)', '', printf('Category of %s explains ~%.0f%% of variance in %s', cat, 100 * eta * eta, num) FROM etas WHERE eta >= 0.5
    UNION ALL SELECT 'cat-cat', x, y, v, 'Cramér''s V', '', 'Strong association between categories ' || x || ' and ' || y FROM vs WHERE v >= 0.4)""",
]


@check("relationships", f"WITH {', '.join(RELATED)} SELECT \"type\", x, y, {r('metric')} AS metric, metric_name, direction, detail FROM related")
def _(spark, sf):
    return round_all(eda.relationships(priced_lines(spark, sf)))


@check("strong_relationships", f"WITH {', '.join(RELATED)} SELECT \"type\", x, y, {r('metric')} AS metric, metric_name, direction, detail FROM related WHERE abs(related.metric) >= 0.6")
def _(spark, sf):
    return round_all(eda.strong_relationships(priced_lines(spark, sf)))


# -- many label columns: every pair counts, also the last ------------------------------------------

MANY = {f"c{i:02d}": f"'v' || CAST((o_orderkey * {i + 3} + o_custkey) % {i + 2} AS VARCHAR)" for i in range(10)}
MANY |= {"twin_a": "'t' || CAST(o_orderkey % 35 AS VARCHAR)", "twin_b": "'T' || CAST(o_orderkey % 35 AS VARCHAR)"}
MANY_SQL = f"many AS (SELECT o_totalprice, {', '.join(f'{e} AS {c}' for c, e in MANY.items())} FROM orders)"


def many_labels(spark, sf):
    """Twelve label columns, of which the last two tell the same, with more than thirty levels."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    views = [F.concat(F.lit("v"), ((key * (i + 3) + customer) % (i + 2)).cast("string")).alias(f"c{i:02d}") for i in range(10)]
    twins = [F.concat(F.lit(t), (key % 35).cast("string")).alias(c) for t, c in (("t", "twin_a"), ("T", "twin_b"))]
    return read(spark, sf, "orders").select("o_totalprice", *views, *twins)


@check("cramers_v_many", f"WITH {MANY_SQL}, {_tables('many', {c: c for c in MANY})} SELECT x, y, n, {r('v')} AS v FROM vs")
def _(spark, sf):
    return round_all(eda.cramers_v(many_labels(spark, sf)))


@check("eta_many_levels", f"WITH {MANY_SQL}, {_eta('many', {'o_totalprice': 'o_totalprice'}, {c: c for c in MANY})} SELECT cat, num, n, {r('eta')} AS eta FROM etas")
def _(spark, sf):
    return round_all(eda.eta(many_labels(spark, sf)))
