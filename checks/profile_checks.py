"""Type detection, profile, missing cells and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayframe.functions.coerce import rounded
from assayframe.operators import duplicates, kinds, missing, profile, stored
from assayframe.plans.facts import Facts
from assayframe.plans.wide import union_all
from checks.inputs import DIRTY_COLUMNS, dirty_keyed, dirty_orders, read
from checks.registry import ALL_TEXT, DIRTY_DATES, DIRTY_NUMBERS, LINE_NUMBERS, TEXT_COLUMNS, check, dirty, long, num, pct, plain, r, ts

TOKENS = "('true','false','yes','no','y','n','1','0','t','f','true.','false.')"


def _kinds_cte() -> str:
    texts = " UNION ALL ".join(f"SELECT {DIRTY_COLUMNS.index(c)} AS pos, '{c}' AS col, {c} AS v FROM d" for c in TEXT_COLUMNS)
    return f"""texts AS ({texts}),
seen AS (SELECT pos, col, count(v) AS n, coalesce(bool_and(lower(trim(v)) IN {TOKENS}), false) AS tokens,
    count(DISTINCT lower(trim(v))) AS tu, count({num('v')}) AS numbers, count({ts('v')}) AS dates, count(DISTINCT v) AS u
  FROM texts GROUP BY pos, col),
judged AS (SELECT pos, col, n, u, dates, CASE
    WHEN tokens AND tu <= 2 THEN 'boolean'
    WHEN numbers > 0.75 * n THEN 'numeric text'
    WHEN dates > 0.8 * n THEN 'dates'
    WHEN u <= 15 AND u <= greatest(2, 0.05 * n) THEN 'few'
    WHEN u > 100 THEN 'many' ELSE 'some' END AS rule FROM seen),
kinds AS (SELECT CAST(pos AS INTEGER) AS pos, col AS "column",
    CASE rule WHEN 'boolean' THEN 'boolean' WHEN 'numeric text' THEN 'numerical' WHEN 'dates' THEN 'datetime'
      WHEN 'many' THEN 'text' ELSE 'categorical' END AS kind,
    CAST(CASE rule WHEN 'boolean' THEN 0.95 WHEN 'numeric text' THEN 0.75 WHEN 'dates' THEN 0.9 WHEN 'few' THEN 0.85
      WHEN 'many' THEN 0.7 ELSE 0.8 END AS DOUBLE) AS confidence,
    CASE rule WHEN 'boolean' THEN 'Low cardinality and values map to true/false'
      WHEN 'numeric text' THEN 'Values look numeric but stored as text'
      WHEN 'dates' THEN CAST(100 * dates // n AS VARCHAR) || '% values parse as dates'
      WHEN 'few' THEN 'Only ' || CAST(u AS VARCHAR) || ' unique values'
      WHEN 'many' THEN 'High cardinality (' || CAST(u AS VARCHAR) || ' unique)'
      ELSE CAST(u AS VARCHAR) || ' unique values' END AS reason,
    CASE rule WHEN 'numeric text' THEN 'string (numeric-like)' ELSE 'string' END AS inferred_dtype
  FROM judged
  UNION ALL SELECT 1, 'total', 'numerical', 0.95, 'Numeric dtype', 'double'
  UNION ALL SELECT 8, 'start_date', 'datetime', 1.0, 'Parsed as datetime dtype', 'timestamp_ntz'
  UNION ALL SELECT 9, 'end_date', 'datetime', 1.0, 'Parsed as datetime dtype', 'timestamp_ntz')"""


KINDS = _kinds_cte()


@check("detect_types", dirty("SELECT * FROM kinds", KINDS))
def _(spark, sf):
    return kinds.detect_types(dirty_orders(spark, sf))


EVERY_KIND = "(VALUES ('numerical'), ('categorical'), ('datetime'), ('text'), ('boolean')) AS e(kind)"
KIND_COUNT_SQL = dirty(
    f"SELECT e.kind, count(k.kind) AS n_columns FROM {EVERY_KIND} LEFT JOIN kinds k ON k.kind = e.kind GROUP BY e.kind", KINDS
)


@check("kind_counts", KIND_COUNT_SQL)
def _(spark, sf):
    return profile.kind_counts(dirty_orders(spark, sf))


@check("shape", dirty(
    """SELECT (SELECT count(*) FROM d) AS n_rows, CAST(count(*) AS INTEGER) AS n_cols,
      CAST(count_if(kind = 'numerical') AS INTEGER) AS n_numerical, CAST(count_if(kind = 'categorical') AS INTEGER) AS n_categorical,
      CAST(count_if(kind = 'datetime') AS INTEGER) AS n_datetime, CAST(count_if(kind = 'text') AS INTEGER) AS n_text,
      CAST(count_if(kind = 'boolean') AS INTEGER) AS n_boolean FROM kinds""", KINDS))
def _(spark, sf):
    return profile.shape(dirty_orders(spark, sf))


@check("parse_types", dirty(
    """SELECT "column", kind, CASE kind WHEN 'numerical' THEN 'double' WHEN 'datetime' THEN 'timestamp_ntz'
      WHEN 'boolean' THEN 'boolean' ELSE 'string' END AS target_dtype FROM kinds""", KINDS))
def _(spark, sf):
    return profile.parse_types(dirty_orders(spark, sf))


@check("dtype_counts", dirty(
    "SELECT CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' ELSE 'timestamp_ntz' END AS dtype, count(*) AS n_columns FROM ("
    + " UNION ALL ".join(f"SELECT any_value(typeof({c})) AS t FROM d" for c in DIRTY_COLUMNS) + ") GROUP BY 1"))
def _(spark, sf):
    return profile.dtype_counts(dirty_orders(spark, sf))


DTYPE_SQL = "CASE col WHEN 'total' THEN 'double' WHEN 'start_date' THEN 'timestamp_ntz' WHEN 'end_date' THEN 'timestamp_ntz' ELSE 'string' END"
COUNTS_BODY = f"""SELECT CAST(pos AS INTEGER) AS pos, col AS "column", {DTYPE_SQL} AS inferred_dtype, count(v) AS "count",
  count(DISTINCT v) AS "unique", count(*) - count(v) AS missing, {pct('count(*) - count(v)', 'count(*)')} AS missing_pct
  FROM cells GROUP BY pos, col"""
CELLS = f"cells AS ({long('d', ALL_TEXT)})"


@check("profile_columns", dirty(COUNTS_BODY, CELLS))
def _(spark, sf):
    return profile.column_counts(dirty_orders(spark, sf))


MOMENTS_BODY = f"""SELECT col AS "column", {r('avg(x)', 3)} AS mean, {r('stddev_samp(x)', 4)} AS std, min(x) AS "min", max(x) AS "max",
  {r('coalesce(skewness(x), 0)', 3)} AS skew, {r('coalesce(kurtosis(x), 0)', 3)} AS kurtosis FROM numbers GROUP BY col"""


@check("profile_numeric_moments", f"WITH numbers AS ({long('lineitem', LINE_NUMBERS, 'x')}) {MOMENTS_BODY}")
def _(spark, sf):
    return profile.numeric_moments(read(spark, sf, "lineitem"))


@check("profile_moments_dirty", dirty(MOMENTS_BODY, f"numbers AS ({long('d', DIRTY_NUMBERS, 'x')})"))
def _(spark, sf):
    return profile.numeric_moments(dirty_orders(spark, sf))


FIRST_LAST_BODY = """SELECT col AS "column", arg_min(v, row_id) FILTER (v IS NOT NULL) AS "first", arg_max(v, row_id) FILTER (v IS NOT NULL) AS "last"
  FROM keyed_cells GROUP BY col"""
KEYED_CELLS = f"keyed_cells AS ({long('keyed', ALL_TEXT, 'v', ', row_id')})"


@check("profile_first_last", dirty(FIRST_LAST_BODY, KEYED_CELLS))
def _(spark, sf):
    return profile.first_last(Facts(dirty_keyed(spark, sf), order_by="row_id"))


MODES_BODY = """SELECT col AS "column", arg_min(v, (-n, v)) AS mode FROM
  (SELECT col, v, count(*) AS n FROM cells WHERE v IS NOT NULL AND col IN ('priority_txt', 'status') GROUP BY col, v) GROUP BY col"""


@check("profile_modes", dirty(MODES_BODY, CELLS))
def _(spark, sf):
    return profile.modal_values(dirty_orders(spark, sf))


RANGES_BODY = """SELECT col AS "column", min(t) AS earliest, max(t) AS latest FROM dates GROUP BY col"""
DATES = f"dates AS ({long('d', DIRTY_DATES, 't')})"


@check("profile_date_ranges", dirty(RANGES_BODY, DATES))
def _(spark, sf):
    return profile.datetime_ranges(dirty_orders(spark, sf))


SHARES_BODY = f"""SELECT 'active' AS "column", {r("avg(CASE WHEN active = 'yes' THEN 1.0 ELSE 0.0 END)", 3)} AS true_share FROM d"""


@check("profile_boolean_shares", dirty(SHARES_BODY))
def _(spark, sf):
    return profile.boolean_shares(dirty_orders(spark, sf))


@check("profile_full", dirty(
    """SELECT c."column", inferred_dtype, "count", "unique", missing, missing_pct, mean, std, "min", "max", skew, kurtosis, mode,
      earliest, latest, true_share, "first", "last" FROM counts c LEFT JOIN moments m ON m."column" = c."column"
      LEFT JOIN modes o ON o."column" = c."column" LEFT JOIN ranges g ON g."column" = c."column"
      LEFT JOIN shares s ON s."column" = c."column" LEFT JOIN ends e ON e."column" = c."column" """,
    CELLS, f"numbers AS ({long('d', DIRTY_NUMBERS, 'x')})", DATES, KEYED_CELLS, f"counts AS ({COUNTS_BODY})", f"moments AS ({MOMENTS_BODY})",
    f"modes AS ({MODES_BODY})", f"ranges AS ({RANGES_BODY})", f"shares AS ({SHARES_BODY})", f"ends AS ({FIRST_LAST_BODY})"))
def _(spark, sf):
    return profile.profile(Facts(dirty_keyed(spark, sf), order_by="row_id"))


ORDER_LINE = f"concat_ws(',', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, {plain('o_totalprice')}, CAST(o_orderdate AS VARCHAR), o_orderpriority)"


@check("size_estimate", f"""SELECT count(*) AS n_rows, {r(f'sum(strlen({ORDER_LINE}) + 1) / CAST(count(*) AS DOUBLE)', 2)} AS avg_row_bytes,
  {r(f'sum(strlen({ORDER_LINE}) + 1) / 1e6', 3)} AS size_mb FROM orders""")
def _(spark, sf):
    return profile.size_estimate(read(spark, sf, "orders"))


@check("value_counts_nulls", dirty(
    f"""SELECT email AS "value", count(*) AS "count", {pct('count(*)', '(SELECT count(*) FROM d)')} AS percentage FROM d
      GROUP BY email ORDER BY count(*) DESC, email ASC NULLS LAST LIMIT 20"""))
def _(spark, sf):
    return profile.value_counts_with_nulls(dirty_orders(spark, sf), "email")


# -- missing cells ------------------------------------------------------------------

GAPS_BODY = f"""SELECT col AS "column", count(*) - count(v) AS missing, {pct('count(*) - count(v)', 'count(*)')} AS missing_pct FROM cells GROUP BY col"""


@check("missing_by_column", dirty(GAPS_BODY, CELLS))
def _(spark, sf):
    return missing.missing_by_column(dirty_orders(spark, sf))


@check("missing_columns", dirty(GAPS_BODY + " HAVING count(*) > count(v)", CELLS))
def _(spark, sf):
    return missing.missing_columns(dirty_orders(spark, sf))


TOTALS_BODY = f"""SELECT count(*) AS total_cells, count(*) - count(v) AS total_missing, {pct('count(*) - count(v)', 'count(*)')} AS overall_pct,
  {pct('count(v)', 'count(*)')} AS completeness_pct, count(DISTINCT col) FILTER (v IS NULL) AS columns_with_missing FROM cells"""


@check("missing_totals", dirty(TOTALS_BODY, CELLS))
def _(spark, sf):
    return missing.missing_totals(dirty_orders(spark, sf))


@check("missing_mask", dirty(
    "SELECT row_id, " + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}" for c in DIRTY_COLUMNS) + " FROM keyed"))
def _(spark, sf):
    return missing.missing_mask(Facts(dirty_keyed(spark, sf), order_by="row_id"))


@check("co_missing", dirty(
    "SELECT concat_ws(', ', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in DIRTY_COLUMNS)
    + f") AS missing_columns, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM d)')} AS share_pct FROM d GROUP BY 1"))
def _(spark, sf):
    return missing.co_missing(dirty_orders(spark, sf))


# -- duplicates ---------------------------------------------------------------------

ALL = ", ".join(DIRTY_COLUMNS)
DUPLICATES_BODY = f"""SELECT sum(n) - count(*) AS duplicate_rows, {pct('sum(n) - count(*)', 'sum(n)')} AS share_pct,
  count(*) AS rows_after, CAST(11 AS INTEGER) AS columns_after FROM (SELECT {ALL}, count(*) AS n FROM d GROUP BY {ALL})"""
NUMBERED = f"numbered AS (SELECT *, row_number() OVER (PARTITION BY {ALL} ORDER BY row_id) AS copy FROM keyed)"


@check("duplicate_summary", dirty(f"SELECT CAST(duplicate_rows AS BIGINT) AS duplicate_rows, share_pct, rows_after, columns_after FROM ({DUPLICATES_BODY})"))
def _(spark, sf):
    return duplicates.duplicate_summary(dirty_orders(spark, sf))


@check("duplicate_preview", dirty("SELECT * EXCLUDE (copy) FROM numbered WHERE copy > 1 ORDER BY row_id LIMIT 20", NUMBERED))
def _(spark, sf):
    return duplicates.duplicate_preview(Facts(dirty_keyed(spark, sf), order_by="row_id"))


@check("deduplicated_preview", dirty("SELECT * EXCLUDE (copy) FROM numbered WHERE copy = 1 ORDER BY row_id LIMIT 20", NUMBERED))
def _(spark, sf):
    return duplicates.deduplicated_preview(Facts(dirty_keyed(spark, sf), order_by="row_id"))


@check("dedup_full", dirty("SELECT DISTINCT * FROM d"))
def _(spark, sf):
    return duplicates.drop_duplicates(dirty_orders(spark, sf))


@check("dedup_subset", dirty(
    "SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY email, status ORDER BY row_id) AS place FROM keyed) WHERE place = 1"))
def _(spark, sf):
    return duplicates.drop_duplicates(dirty_keyed(spark, sf), ["email", "status"], order_by="row_id")


@check("duplicates_removed", dirty(
    "SELECT (SELECT count(*) FROM d) AS rows_before, count(*) AS rows_after, (SELECT count(*) FROM d) - count(*) AS removed FROM (SELECT DISTINCT * FROM d)"))
def _(spark, sf):
    table = dirty_orders(spark, sf)
    return duplicates.duplicates_removed(table, duplicates.drop_duplicates(table))


@check("unique_small_doubles", "SELECT 'tiny' AS \"column\", count(DISTINCT CAST(o_custkey AS DOUBLE) * 1e-13) AS \"unique\" FROM orders")
def _(spark, sf):
    tiny = read(spark, sf, "orders").select((F.col("o_custkey").cast("double") * 1e-13).alias("tiny"))
    return profile.profile(Facts(tiny)).select("column", "unique")


@check("hash_sample", "SELECT o_orderkey FROM orders WHERE CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 7 = 0")
def _(spark, sf):
    return kinds.hash_sample(read(spark, sf, "orders"), "o_orderkey", 7).select("o_orderkey")


# -- dates in many notations: each reads as the order's own date ------------------------------------

NOTATIONS = ["dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "MMMM d, yyyy", "d MMMM yyyy", "d-MMM-yy", "MMM d, yyyy", "yyyy/MM/dd", "M/d/yyyy h:mm a",
             "dd-MM-yyyy", "MM-dd-yyyy", "MMM d yyyy", "d MMM yyyy HH:mm", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "yyyy.MM.dd", "dd/MM/yy", "dd.MM.yy",
             "yyyyMMdd'T'HHmmss", "MMMM d, yyyy h:mm a"]
NOTATION_LIST = ", ".join("'" + n.replace("'", "''") + "'" for n in NOTATIONS)


@check("date_notations", f"""SELECT n AS notation, 'datetime' AS kind, count(*) AS parsed, min(o_orderdate) AS first, max(o_orderdate) AS last, count(DISTINCT o_orderdate) AS days
  FROM orders CROSS JOIN unnest([{NOTATION_LIST}]) AS t(n) GROUP BY n""")
def _(spark, sf):
    orders = read(spark, sf, "orders")
    written = orders.select(*[F.date_format("o_orderdate", n).alias(f"n{i}") for i, n in enumerate(NOTATIONS)])
    facts = Facts(written)
    parts = [
        facts.df.agg(F.count(t).alias("parsed"), F.min(t).alias("first"), F.max(t).alias("last"), F.count_distinct(t).alias("days"))
        .select(F.lit(n).alias("notation"), F.lit(facts.kinds[f"n{i}"].kind).alias("kind"), "*")
        for i, n in enumerate(NOTATIONS) for t in [facts.timestamp(f"n{i}")]
    ]
    return union_all(parts)


# -- facts that are stored by part and merged ---------------------------------------------------

_STORED = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate", "l_returnflag"]
_STORED_NUMBERS = _STORED[:4]


@check("stored_facts", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS rows, count({c}) AS count, count(*) - count({c}) AS missing, """
    + (f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, {r(f'avg({c})', 6)} AS mean, {r(f'stddev_samp({c})', 6)} AS std, "
       if c in _STORED_NUMBERS else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, ")
    + "true AS near_distinct, true AS near_median FROM lineitem" for c in _STORED))
def _(spark, sf):
    lines = read(spark, sf, "lineitem").select(*_STORED, "l_linenumber")
    merged = stored.facts_profile(stored.merge_facts(stored.column_facts(lines, by="l_linenumber")))
    # the estimates against exact counts: within four standard errors, and within the bound of the ranks
    exact = lines.agg(*[F.count_distinct(c).alias(f"u_{c}") for c in _STORED])
    ranks = merged.where(F.col("q50").isNotNull()).select("column", "q50").collect()
    shares = lines.agg(*[
        F.struct((F.count_if(F.col(x["column"]) < x["q50"]) / F.count("*")).alias("below"), (F.count_if(F.col(x["column"]) <= x["q50"]) / F.count("*")).alias("upto")).alias(x["column"])
        for x in ranks])
    unique = exact.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"u_{c}").alias("u")) for c in _STORED])))
    share = shares.select(F.inline(F.array(*[F.struct(F.lit(x["column"]).alias("column"), F.col(f"{x['column']}.below").alias("below"), F.col(f"{x['column']}.upto").alias("upto")) for x in ranks])))
    near = (F.col("below") <= 0.5 + stored.RANK_ERROR) & (F.col("upto") >= 0.5 - stored.RANK_ERROR)
    return merged.join(unique, "column").join(share, "column", "left").select(
        "column", "rows", "count", "missing", "min", "max", rounded(F.col("mean"), 6).alias("mean"), rounded(F.col("std"), 6).alias("std"),
        (F.abs(F.col("unique") - F.col("u")) <= 4 * 0.013 * F.col("u")).alias("near_distinct"), F.coalesce(near, F.lit(True)).alias("near_median"))
