"""Cleaning steps and the logged cleaning run."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from assayframe.operators import clean
from assayframe.plans.facts import Facts
from checks.inputs import DIRTY_COLUMNS, dirty_keyed, dirty_orders, read
from checks.quality_checks import DIRTY_OUTLIERS, HIT
from checks.registry import check, dirty, num, pct, r, round_all, stripped, ts  # noqa: F401

OTHERS = ", ".join(c for c in DIRTY_COLUMNS if c != "total")


def _imputed(expr: str) -> str:
    return dirty(f"SELECT row_id, {OTHERS}, {r(expr, 4)} AS total FROM keyed")


def _impute(method: str, **more):
    return lambda spark, sf: round_all(clean.impute(dirty_keyed(spark, sf), "total", method, order_by="row_id", **more), 4)


check("impute_mean", _imputed("coalesce(total, (SELECT avg(total) FROM keyed))"))(_impute("mean"))
check("impute_median", _imputed("coalesce(total, (SELECT quantile_cont(total, 0.5) FROM keyed))"))(_impute("median"))
check("impute_mode", _imputed(
    "coalesce(total, (SELECT total FROM keyed WHERE total IS NOT NULL GROUP BY total ORDER BY count(*) DESC, total LIMIT 1))"
))(_impute("mode"))
check("impute_constant", _imputed("coalesce(total, 12.5)"))(_impute("constant", constant="12.5"))
check("impute_drop", dirty(f"SELECT row_id, {OTHERS}, {r('total', 4)} AS total FROM keyed WHERE total IS NOT NULL"))(_impute("drop"))
check("impute_ffill", _imputed(
    "last_value(total IGNORE NULLS) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
))(_impute("ffill"))
check("impute_bfill", _imputed(
    "first_value(total IGNORE NULLS) OVER (ORDER BY row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
))(_impute("bfill"))
check("impute_ffill_keyed", _imputed(
    "last_value(total IGNORE NULLS) OVER (PARTITION BY status ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
))(_impute("ffill", keys=["status"]))

TYPED = {
    "qty_txt": num("qty_txt"), "date_txt": ts("date_txt"),
    "active": "CASE WHEN lower(trim(active)) IN ('true','yes','y','1','t') THEN true WHEN lower(trim(active)) IN ('false','no','n','0','f') THEN false END",
}


def _replaced(table: str, views: dict[str, str], keep: str = "") -> str:
    return f"SELECT {keep}" + ", ".join(f"{views[c]} AS {c}" if c in views else c for c in DIRTY_COLUMNS) + f" FROM {table}"


@check("correct_dtypes", dirty(_replaced("d", TYPED)))
def _(spark, sf):
    return clean.correct_types(dirty_orders(spark, sf))


@check("coerce_bool", dirty(_replaced("d", {"active": TYPED["active"]})))
def _(spark, sf):
    return clean.coerce_booleans(dirty_orders(spark, sf), ["active"])


def _standard(c: str) -> str:
    return f"lower({stripped(c)})"


@check("standardise_labels", dirty(_replaced("d", {c: _standard(c) for c in ("priority_txt", "status")})))
def _(spark, sf):
    return clean.standardise_labels(dirty_orders(spark, sf), ["priority_txt", "status"], merge_fuzzy=False)


# Within one priority the spellings are prefixes of each other and different priorities are
# far apart, so the greedy merge ends at the shortest prefix that is similar enough.
FUZZY_MAP = f"""spellings AS (SELECT DISTINCT {_standard('priority_txt')} AS l FROM d),
merged AS (SELECT b.l AS label, arg_min(a.l, (length(a.l), a.l)) AS canonical FROM spellings b JOIN spellings a
  ON starts_with(b.l, a.l) AND 200.0 * length(a.l) / (length(a.l) + length(b.l)) >= 88 GROUP BY b.l)"""


@check("fuzzy_merge", dirty(
    f"SELECT canonical AS priority_txt, count(*) AS n FROM d JOIN merged ON label = {_standard('priority_txt')} GROUP BY canonical", FUZZY_MAP))
def _(spark, sf):
    merged = clean.standardise_labels(dirty_orders(spark, sf), ["priority_txt"])
    return merged.groupBy("priority_txt").agg(F.count(F.lit(1)).alias("n"))


# Labels one by one in order of length and text; a bit vector holds a row of the longest-common-subsequence programme.
@check("fuzzy_merge_customers", f"""WITH RECURSIVE names AS (SELECT DISTINCT lower({stripped('c_name')}) AS l FROM customer WHERE c_name IS NOT NULL),
labels AS MATERIALIZED (SELECT l, row_number() OVER (ORDER BY length(l), l) AS i, map_from_entries(list_transform(list_distinct(string_split(l, '')),
    lambda c: (c, list_sum(list_transform(range(1, length(l) + 1), lambda j: CASE WHEN l[j] = c THEN 1::BIGINT << (j - 1)::INTEGER ELSE 0::BIGINT END))::BIGINT))) AS places FROM names),
pairs AS (SELECT a.i AS a, b.i AS b, length(a.l) AS m, length(b.l) AS n, list_reduce(list_prepend((1::BIGINT << length(a.l)::INTEGER) - 1,
    list_transform(string_split(b.l, ''), lambda c: coalesce(a.places[c], 0))),
    lambda row, hit: ((row + (row & hit)) | (row - (row & hit))) & ((1::BIGINT << length(a.l)::INTEGER) - 1)) AS rest
  FROM labels a JOIN labels b ON a.i < b.i AND 200.0 * length(a.l) >= 88 * (length(a.l) + length(b.l))),
near AS MATERIALIZED (SELECT b, list(a ORDER BY a) AS earlier FROM pairs WHERE 200.0 * (m - bit_count(rest)) / (m + n) >= 88 GROUP BY b),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS chosen
  UNION ALL SELECT w.i + 1, CASE WHEN list_has_any(coalesce(e.earlier, []), w.chosen) THEN w.chosen ELSE list_append(w.chosen, w.i + 1) END
  FROM walk w JOIN labels t ON t.i = w.i + 1 LEFT JOIN near e ON e.b = w.i + 1),
done AS (SELECT chosen FROM walk ORDER BY i DESC LIMIT 1),
merged AS (SELECT l AS label, coalesce((SELECT o.l FROM labels o WHERE o.i = list_min(list_intersect(e.earlier, d.chosen))), t.l) AS canonical
  FROM labels t LEFT JOIN near e ON e.b = t.i CROSS JOIN done d)
SELECT canonical AS c_name, count(*) AS n FROM customer JOIN merged ON label = lower({stripped('c_name')}) GROUP BY 1""")
def _(spark, sf):
    merged = clean.standardise_labels(read(spark, sf, "customer"), ["c_name"])
    return merged.groupBy("c_name").agg(F.count(F.lit(1)).alias("n"))


# -- outliers ------------------------------------------------------------------------------


def _bound(col: str, which: str) -> str:
    return f"(SELECT {which} FROM tests WHERE col = '{col}' AND method = 'IQR')"


TOTAL_OUT = f"coalesce(total < {_bound('total', 'lo')} OR total > {_bound('total', 'hi')}, false)"
QTY_OUT = f"coalesce(({num('qty_txt')}) < {_bound('qty_txt', 'lo')} OR ({num('qty_txt')}) > {_bound('qty_txt', 'hi')}, false)"


@check("outlier_flag", dirty(f"SELECT *, {TOTAL_OUT} AS total_is_outlier FROM keyed", *DIRTY_OUTLIERS))
def _(spark, sf):
    return clean.flag_outliers(Facts(dirty_keyed(spark, sf), order_by="row_id"))


@check("outlier_cap", dirty(
    f"""SELECT row_id, {OTHERS}, {r(f"CASE WHEN total < {_bound('total', 'lo')} THEN {_bound('total', 'lo')} WHEN total > {_bound('total', 'hi')} THEN {_bound('total', 'hi')} ELSE total END", 4)} AS total
      FROM keyed""", *DIRTY_OUTLIERS))
def _(spark, sf):
    return round_all(clean.cap_outliers(Facts(dirty_keyed(spark, sf), order_by="row_id")), 4)


@check("outlier_remove", dirty(f"SELECT * FROM keyed WHERE NOT ({TOTAL_OUT}) AND NOT ({QTY_OUT})", *DIRTY_OUTLIERS))
def _(spark, sf):
    return clean.remove_outliers(Facts(dirty_keyed(spark, sf), order_by="row_id"))


# -- the logged run ---------------------------------------------------------------------------

OPTIONS = dict(
    imputation={"total": "median", "email": "mode"}, drop_duplicates=True, standardise=True, outlier_action="cap",
)
MOMENT = dt.datetime(2000, 1, 1)

# All spellings of the statuses are single letters, which never resemble one another.
_MERGED = f"(SELECT canonical FROM merged WHERE label = {_standard('priority_txt')})"
STEPS = [
    FUZZY_MAP,
    "dd AS (SELECT *  EXCLUDE (copy) FROM (SELECT *, row_number() OVER (PARTITION BY " + ", ".join(DIRTY_COLUMNS) + " ORDER BY row_id) AS copy FROM keyed) WHERE copy = 1)",
    """filled AS (SELECT * REPLACE (coalesce(total, (SELECT quantile_cont(total, 0.5) FROM dd)) AS total,
      coalesce(email, (SELECT email FROM dd WHERE email IS NOT NULL GROUP BY email ORDER BY count(*) DESC, email LIMIT 1)) AS email) FROM dd)""",
    f"typed AS ({_replaced('filled', {**TYPED, 'priority_txt': _MERGED, 'status': _standard('status')}, 'row_id, ')})",
    """fences AS (SELECT quantile_cont(total, 0.25) - 1.5 * (quantile_cont(total, 0.75) - quantile_cont(total, 0.25)) AS tl,
      quantile_cont(total, 0.75) + 1.5 * (quantile_cont(total, 0.75) - quantile_cont(total, 0.25)) AS th,
      quantile_cont(qty_txt, 0.25) - 1.5 * (quantile_cont(qty_txt, 0.75) - quantile_cont(qty_txt, 0.25)) AS ql,
      quantile_cont(qty_txt, 0.75) + 1.5 * (quantile_cont(qty_txt, 0.75) - quantile_cont(qty_txt, 0.25)) AS qh FROM typed)""",
    f"""cleaned AS (SELECT typed.* REPLACE ({r('CASE WHEN total < tl THEN tl WHEN total > th THEN th ELSE total END', 4)} AS total,
      CASE WHEN qty_txt < ql THEN ql WHEN qty_txt > qh THEN qh ELSE qty_txt END AS qty_txt) FROM typed CROSS JOIN fences)""",
]


def cleaning_run(spark, sf) -> clean.CleaningRun:
    return clean.CleaningRun(dirty_keyed(spark, sf), options=clean.CleaningOptions(**OPTIONS), order_by="row_id")


@check("clean_pipeline", dirty("SELECT * FROM cleaned", *STEPS))
def _(spark, sf):
    return round_all(cleaning_run(spark, sf).cleaned, 4)


def _changed(c: str, to: str | None = None) -> str:
    return f"(SELECT count(*) FROM filled WHERE {c} <> {to or _standard(c)})"


def _line(place: int, operation: str, columns: str, detail: str, hits: str, always: bool = True) -> str:
    return f"SELECT {place} AS place, '{operation}' AS operation, '{columns}' AS columns, {detail} AS detail, CAST({hits} AS BIGINT) AS rows_affected" + (
        "" if always else f" WHERE {hits} > 0"
    )


def _text(template: str, hits: str) -> str:
    return f"printf('{template}', CAST({hits} AS BIGINT))"


_REMOVED = "(SELECT (SELECT count(*) FROM keyed) - (SELECT count(*) FROM dd))"
_NO_TOTAL, _NO_EMAIL = "(SELECT count(*) FROM dd WHERE total IS NULL)", "(SELECT count(*) FROM dd WHERE email IS NULL)"
_BAD_QTY = f"(SELECT count(*) FROM filled WHERE qty_txt IS NOT NULL AND ({num('qty_txt')}) IS NULL)"
_BAD_DATE = f"(SELECT count(*) FROM filled WHERE date_txt IS NOT NULL AND ({ts('date_txt')}) IS NULL)"
_CAP_T, _CAP_Q = "(SELECT count(*) FROM typed, fences WHERE total < tl OR total > th)", "(SELECT count(*) FROM typed, fences WHERE qty_txt < ql OR qty_txt > qh)"
LOG_LINES = " UNION ALL ".join([
    _line(0, "start", "", _text("Began cleaning on %d rows x 11 columns", "(SELECT count(*) FROM keyed)"), "0"),
    _line(1, "duplicate-removal", "all", _text("Removed %d duplicate rows", _REMOVED), _REMOVED),
    _line(2, "missing-impute", "total", _text("Imputed %d missing values using ''median''", _NO_TOTAL), _NO_TOTAL),
    _line(3, "missing-impute", "email", _text("Imputed %d missing values using ''mode''", _NO_EMAIL), _NO_EMAIL),
    _line(4, "dtype-correction", "qty_txt", _text("Coerced to numeric; %d unparseable values became NaN", _BAD_QTY), _BAD_QTY, False),
    _line(5, "dtype-correction", "date_txt", _text("Coerced to datetime; %d unparseable values became NaN", _BAD_DATE), _BAD_DATE, False),
    _line(6, "dtype-correction", "active", "'Coerced to boolean'", "0"),
    _line(7, "categorical-standardisation", "priority_txt", _text("Normalised %d labels (strip/case + fuzzy merge)", _changed("priority_txt", _MERGED)), _changed("priority_txt", _MERGED), False),
    _line(8, "categorical-standardisation", "status", _text("Normalised %d labels (strip/case + fuzzy merge)", _changed("status")), _changed("status"), False),
    _line(9, "outlier-cap", "total", _text("Winsorized %d values outside IQR bounds to nearest fence", _CAP_T), _CAP_T),
    _line(10, "outlier-cap", "qty_txt", _text("Winsorized %d values outside IQR bounds to nearest fence", _CAP_Q), _CAP_Q),
    _line(11, "end", "", _text("Cleaning complete: %d rows x 11 columns", "(SELECT count(*) FROM cleaned)"), "0"),
])


@check("cleaning_log", dirty(f"SELECT '2000-01-01 00:00:00' AS \"timestamp\", operation, columns, detail, rows_affected, 'applied' AS status FROM ({LOG_LINES})", *STEPS))
def _(spark, sf):
    return cleaning_run(spark, sf).log(MOMENT).drop("place")


_GAPS = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in DIRTY_COLUMNS)


@check("before_after", dirty(
    f"""SELECT 'before' AS stage, count(*) AS rows, 12 AS columns, CAST(sum({_GAPS}) AS BIGINT) AS missing_cells FROM keyed
      UNION ALL SELECT 'after', count(*), 12, CAST(sum({_GAPS}) AS BIGINT) FROM cleaned""", *STEPS))
def _(spark, sf):
    return clean.before_after(dirty_keyed(spark, sf), cleaning_run(spark, sf).cleaned)


# -- types stay as they are ---------------------------------------------------------------

IDS = """SELECT o_orderkey, o_orderkey + 9007199254740993 AS big_id, CAST(CAST(o_totalprice AS DECIMAL(20, 4)) AS VARCHAR) AS price FROM orders"""


@check("cap_keeps_types", IDS)
def _(spark, sf):
    price = F.col("o_totalprice").cast("decimal(20,4)")
    orders = read(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") + 9007199254740993).alias("big_id"), price.alias("price"))
    capped = clean.cap_outliers(orders, 100.0)
    assert capped.schema == orders.schema
    return capped.withColumn("price", F.col("price").cast("string"))


@check("clean_keeps_arrays", "SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dims, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings")
def _(spark, sf):
    vectors = read(spark, sf, "embeddings")
    run = clean.CleaningRun(vectors.unionByName(vectors.where("vec_id % 7 = 0")), options=clean.CleaningOptions(drop_duplicates=True, outlier_action="remove", iqr_factor=1e6))
    assert run.cleaned.schema["embedding"].dataType == vectors.schema["embedding"].dataType
    return run.cleaned.select("vec_id", "label", F.size("embedding").alias("dims"), F.col("embedding")[0].cast("double").alias("first"))
