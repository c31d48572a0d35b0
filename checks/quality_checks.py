"""Type consistency, outliers, label quality, validation rules and the score."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayframe.operators import categories, outliers, score, validation
from assayframe.operators.duplicates import drop_duplicates
from assayframe.plans.facts import Facts
from checks.inputs import dirty_keyed, dirty_orders, read
from checks.profile_checks import DUPLICATES_BODY, TOTALS_BODY
from checks.registry import (
    ALL_TEXT, AS_OF, AS_OF_SQL, DIRTY_DATES, DIRTY_NUMBERS, LABEL_TEXT, LINE_NUMBERS, check, dirty, long, norm, num, pct, plain, r, stripped, ts,
)


def examples(value: str) -> str:
    return f"substr(array_to_string(list_sort(list_distinct(list({value})))[1:5], ', '), 1, 200)"


# -- type consistency -----------------------------------------------------------------

TYPE_ISSUES_BODY = f"""SELECT 'qty_txt' AS "column", 'numeric' AS detected_as, count(*) AS anomalous_count,
    {pct('count(*)', '(SELECT count(*) FROM d)')} AS anomalous_share, {examples('qty_txt')} AS examples,
    'Convert to numeric after cleaning / inspection' AS suggestion
  FROM d WHERE qty_txt IS NOT NULL AND ({num('qty_txt')}) IS NULL
  UNION ALL SELECT 'date_txt', 'datetime', count(*), {pct('count(*)', '(SELECT count(date_txt) FROM d)')}, {examples('date_txt')}, 'Normalise date formats'
  FROM d WHERE date_txt IS NOT NULL AND ({ts('date_txt')}) IS NULL"""


@check("type_issues", dirty(TYPE_ISSUES_BODY))
def _(spark, sf):
    return validation.type_issues(dirty_orders(spark, sf))


# -- outliers -----------------------------------------------------------------------------


def _outliers_ctes(numbers: str) -> list[str]:
    return [
        f"numbers AS ({numbers})",
        """known AS (SELECT col, x FROM numbers WHERE x IS NOT NULL)""",
        """bounds AS (SELECT col, count(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, avg(x) AS mu, stddev_pop(x) AS sd
          FROM known GROUP BY col HAVING count(*) >= 6)""",
        """tests AS (SELECT col, 'IQR' AS method, n, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, mu, sd FROM bounds
          UNION ALL SELECT col, 'Z-score', n, mu - 3 * sd, mu + 3 * sd, mu, sd FROM bounds WHERE sd > 0)""",
    ]


HIT = "CASE method WHEN 'IQR' THEN x < lo OR x > hi ELSE abs((x - mu) / sd) > 3 END"
OUTLIERS_BODY = f"""SELECT t.col AS "column", method, {r('any_value(lo)', 3)} AS lower_bound, {r('any_value(hi)', 3)} AS upper_bound,
  count_if({HIT}) AS outliers, {pct(f'count_if({HIT})', 'any_value(n)')} AS share_pct
  FROM tests t JOIN known k ON k.col = t.col GROUP BY t.col, method"""
AS_BIG = 'SELECT "column", method, lower_bound, upper_bound, CAST(outliers AS BIGINT) AS outliers, share_pct'
LINE_OUTLIERS = "WITH " + ", ".join(_outliers_ctes(long("lineitem", LINE_NUMBERS, "x")))
DIRTY_OUTLIERS = _outliers_ctes(long("d", DIRTY_NUMBERS, "x"))


@check("outliers_iqr", f"{LINE_OUTLIERS} {AS_BIG} FROM ({OUTLIERS_BODY}) WHERE method = 'IQR'")
def _(spark, sf):
    return outliers.outliers(read(spark, sf, "lineitem"), "IQR")


@check("outliers_zscore", f"{LINE_OUTLIERS} {AS_BIG} FROM ({OUTLIERS_BODY}) WHERE method = 'Z-score'")
def _(spark, sf):
    return outliers.outliers(read(spark, sf, "lineitem"), "Z-score")


@check("outliers_dirty", dirty(f"{AS_BIG} FROM ({OUTLIERS_BODY})", *DIRTY_OUTLIERS))
def _(spark, sf):
    return outliers.outliers(dirty_orders(spark, sf))


@check("outlier_rows", dirty(
    f"""SELECT row_id, t.col AS "column", method, x AS "value" FROM tests t
      JOIN ({long('keyed', DIRTY_NUMBERS, 'x', ', row_id')}) k ON k.col = t.col WHERE x IS NOT NULL AND {HIT}""", *DIRTY_OUTLIERS))
def _(spark, sf):
    return outliers.outlier_rows(Facts(dirty_keyed(spark, sf), order_by="row_id"))


# -- labels --------------------------------------------------------------------------------


def _labels(table: str, views: dict[str, str]) -> list[str]:
    return [
        f"labels AS ({long(table, views)})",
        "total AS (SELECT count(*) AS rows FROM " + table + ")",
        "counts AS (SELECT pos, col, v, count(*) AS n FROM labels WHERE v IS NOT NULL GROUP BY pos, col, v)",
        f"spelled AS (SELECT col, {norm('v')} AS normalised, count(*) AS n_variants, array_to_string(list_sort(list(v))[1:5], ', ') AS variants FROM counts GROUP BY 1, 2 HAVING count(*) > 1)",
    ]


DIRTY_LABELS = _labels("d", LABEL_TEXT)


def _top(where: str = "true", k: int = 10) -> str:
    return f"""SELECT col AS "column", CAST(place AS INTEGER) AS "rank", v AS "value", n AS "count", {pct('n', '(SELECT rows FROM total)')} AS percentage
      FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS place FROM counts WHERE {where}) WHERE place <= {k}"""


@check("cardinality", dirty(
    f"""SELECT col AS "column", count(*) AS n_unique, {r('count(*) / CAST((SELECT rows FROM total) AS DOUBLE)', 3)} AS cardinality_ratio FROM counts GROUP BY col""",
    *DIRTY_LABELS))
def _(spark, sf):
    return categories.cardinality(dirty_orders(spark, sf))


@check("category_top", dirty(_top(), *DIRTY_LABELS))
def _(spark, sf):
    return categories.category_top(dirty_orders(spark, sf))


PART_LABELS = _labels("part", {c: c for c in ("p_name", "p_brand", "p_type")})


@check("category_top_part", "WITH " + ", ".join(PART_LABELS) + _top())
def _(spark, sf):
    return categories.category_top(read(spark, sf, "part"))


@check("category_rare", dirty(_top("n / CAST((SELECT rows FROM total) AS DOUBLE) < 0.01"), *DIRTY_LABELS))
def _(spark, sf):
    return categories.category_rare(dirty_orders(spark, sf))


INCONSISTENT_BODY = """SELECT col AS "column", CAST(place AS INTEGER) AS "rank", normalised, n_variants, variants FROM
  (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n_variants DESC, normalised) AS place FROM spelled) WHERE place <= 10"""


@check("label_inconsistent", dirty(INCONSISTENT_BODY, *DIRTY_LABELS))
def _(spark, sf):
    return categories.inconsistent_labels(dirty_orders(spark, sf))


@check("category_suggestion", dirty(
    f"""SELECT c.col AS "column", u AS n_unique, {r('u / CAST(rows AS DOUBLE)', 3)} AS cardinality_ratio, coalesce(g, 0) AS inconsistent_groups,
      CASE WHEN u / CAST(rows AS DOUBLE) > 0.95 AND (chars / CAST(cells AS DOUBLE) > 50 OR u > 0.9 * cells) THEN 'Looks like free text / unique IDs: treat as text, not category.'
        WHEN g > 0 THEN 'Similar labels differ in casing/whitespace — consider standardising.'
        WHEN u > 50 THEN 'High cardinality category — consider grouping rare values.' ELSE '' END AS suggestion
      FROM (SELECT col, count(*) AS u, sum(n) AS cells, sum(n * length(v)) AS chars FROM counts GROUP BY col) c CROSS JOIN total
      LEFT JOIN (SELECT col, count(*) AS g FROM spelled GROUP BY col) s ON s.col = c.col""", *DIRTY_LABELS))
def _(spark, sf):
    return categories.category_analysis(dirty_orders(spark, sf))


DOC_LABELS = _labels("documents", {c: c for c in ("text", "lang", "source")})


@check("category_suggestion_documents", "WITH " + ", ".join(DOC_LABELS) +
    f"""SELECT c.col AS "column", u AS n_unique, {r('u / CAST(rows AS DOUBLE)', 3)} AS cardinality_ratio, coalesce(g, 0) AS inconsistent_groups,
      CASE WHEN u / CAST(rows AS DOUBLE) > 0.95 AND (chars / CAST(cells AS DOUBLE) > 50 OR u > 0.9 * cells) THEN 'Looks like free text / unique IDs: treat as text, not category.'
        WHEN g > 0 THEN 'Similar labels differ in casing/whitespace — consider standardising.'
        WHEN u > 50 THEN 'High cardinality category — consider grouping rare values.' ELSE '' END AS suggestion
      FROM (SELECT col, count(*) AS u, sum(n) AS cells, sum(n * length(v)) AS chars FROM counts GROUP BY col) c CROSS JOIN total
      LEFT JOIN (SELECT col, count(*) AS g FROM spelled GROUP BY col) s ON s.col = c.col""")
def _(spark, sf):
    return categories.category_analysis(read(spark, sf, "documents"))


# -- validation ----------------------------------------------------------------------------

EMAIL = r"'^[^@\s]+@[^@\s]+\.[^@\s]+$', 'i'"
PHONE = r"'^\+?\d[\d\s().-]{6,}$'"
COLS = 'SELECT seq, "column", "check", severity, failures, share_pct, examples, detail'


def _number_rules(numbers: dict[str, tuple[int, str]], table: str) -> str:
    parts = []
    for c, (seq, x) in numbers.items():
        bound = (
            f"(SELECT quantile_cont(x, 0.01) - 10 * greatest(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 1e-9) AS lo, "
            f"quantile_cont(x, 0.99) + 10 * greatest(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 1e-9) AS hi, count(x) AS n "
            f"FROM (SELECT {x} AS x FROM {table}))"
        )
        parts.append(f"""SELECT {seq} AS seq, '{c}' AS "column", 'value range' AS "check", 'warning' AS severity, count(*) AS failures,
          {pct('count(*)', 'any_value(n)')} AS share_pct, {examples(plain('x'))} AS examples,
          printf('Values far outside the plausible range [%.2f, %.2f]', any_value(lo), any_value(hi)) AS detail
          FROM (SELECT {x} AS x FROM {table}) CROSS JOIN {bound} WHERE x < lo OR x > hi HAVING count(*) > 0""")
        parts.append(f"""SELECT {seq + 1}, '{c}', 'negative value', 'info', count(*), {pct('count(*)', f'(SELECT count({x}) FROM {table})')},
          {examples(plain('x'))}, 'Non-negative expected' FROM (SELECT {x} AS x FROM {table}) WHERE x < 0 HAVING count(*) > 0""")
    return " UNION ALL ".join(parts)


def _validation(table: str) -> str:
    total = f"(SELECT count(*) FROM {table})"
    parts = [_number_rules({"total": (10, "total"), "qty_txt": (20, num("qty_txt"))}, table)]
    parts.append(f"""SELECT 0, 'order_id', 'ID uniqueness', 'error', CAST(sum(n - 1) AS BIGINT), {pct('sum(n - 1)', f'(SELECT count(order_id) FROM {table})')},
      {examples('order_id')}, 'Duplicate identifiers found — IDs should be unique'
      FROM (SELECT order_id, count(*) AS n FROM {table} WHERE order_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0""")
    for i, (c, t) in enumerate(DIRTY_DATES.items()):
        parts.append(f"""SELECT {30 + i}, '{c}', 'future date', 'info', count(*), {pct('count(*)', total)}, {examples(ALL_TEXT[c])}, 'Dates in the future found'
          FROM {table} WHERE {t} > {AS_OF_SQL} HAVING count(*) > 0""")
    parts.append(f"""SELECT 40, 'email', 'email format', 'warning', count(*), {pct('count(*)', f'(SELECT count(email) FROM {table})')}, {examples('email')}, 'Values failing email regex'
      FROM {table} WHERE NOT regexp_matches({stripped('email')}, {EMAIL}) HAVING count(*) > 0""")
    parts.append(f"""SELECT 41, 'phone', 'phone format', 'warning', count(*), {pct('count(*)', f'(SELECT count(phone) FROM {table})')}, {examples('phone')}, 'Values failing phone pattern'
      FROM {table} WHERE NOT regexp_matches({stripped('phone')}, {PHONE}) HAVING count(*) > 0""")
    parts.append(f"""SELECT 42, 'start_date vs end_date', 'start<=end', 'warning', count(*), {pct('count(*)', total)}, '', 'Rows where start_date is after end_date'
      FROM {table} WHERE start_date > end_date HAVING count(*) > 0""")
    return " UNION ALL ".join(parts)


VALIDATION_BODY = _validation("d")


def _rule_sql(rule: str | None = None) -> str:
    where = f" WHERE \"check\" = '{rule}'" if rule else ""
    return dirty(f"SELECT * EXCLUDE (seq) FROM ({VALIDATION_BODY}){where}")


@check("validation_all", _rule_sql())
def _(spark, sf):
    return validation.validate(dirty_orders(spark, sf), AS_OF)


def _register_rule(name: str, rule: str) -> None:
    @check(name, _rule_sql(rule))
    def _(spark, sf):
        return validation.validate(dirty_orders(spark, sf), AS_OF).where(F.col("check") == rule)


for _name, _rule in (
    ("validate_range", "value range"), ("validate_future", "future date"), ("validate_email", "email format"),
    ("validate_phone", "phone format"), ("validate_id", "ID uniqueness"), ("validate_start_end", "start<=end"),
):
    _register_rule(_name, _rule)


@check("validate_negative", f"SELECT * EXCLUDE (seq) FROM ({_number_rules({'c_custkey': (0, 'CAST(c_custkey AS DOUBLE)'), 'c_nationkey': (2, 'CAST(c_nationkey AS DOUBLE)'), 'c_acctbal': (4, 'c_acctbal')}, 'customer')})")
def _(spark, sf):
    return validation.validate(read(spark, sf, "customer").drop("c_name"), AS_OF)


@check("validate_negative_supplier", f"SELECT * EXCLUDE (seq) FROM ({_number_rules({'s_suppkey': (0, 'CAST(s_suppkey AS DOUBLE)'), 's_nationkey': (2, 'CAST(s_nationkey AS DOUBLE)'), 's_acctbal': (4, 's_acctbal')}, 'supplier')})")
def _(spark, sf):
    return validation.validate(read(spark, sf, "supplier").drop("s_name"), AS_OF)


# -- score -----------------------------------------------------------------------------------

GRADE = "CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 80 THEN 'Good' WHEN score >= 65 THEN 'Fair' WHEN score >= 50 THEN 'Poor' ELSE 'Critical' END"


def score_ctes() -> list[str]:
    """The score of table ``d`` as CTE ``scores(dimension, score, weight)``."""
    return [
        f"cells AS ({long('d', ALL_TEXT)})",
        *DIRTY_OUTLIERS,
        *DIRTY_LABELS,
        f"validation AS ({VALIDATION_BODY})",
        f"""facts AS (SELECT (SELECT completeness_pct FROM ({TOTALS_BODY})) AS complete,
          (SELECT duplicate_rows / CAST((SELECT count(*) FROM d) AS DOUBLE) FROM ({DUPLICATES_BODY})) AS dup,
          (SELECT coalesce(sum(failures * CASE severity WHEN 'error' THEN 1.5 ELSE 1.0 END), 0) / CAST((SELECT count(*) FROM d) AS DOUBLE) FROM validation) AS w,
          (SELECT coalesce(sum(least(0.6 * anomalous_share, 30)), 0) FROM ({TYPE_ISSUES_BODY}) WHERE anomalous_count > 0) AS typed,
          (SELECT count(DISTINCT col) FROM spelled) AS k,
          (SELECT sum(outliers) / CAST(count(*) * (SELECT count(*) FROM d) AS DOUBLE) FROM ({OUTLIERS_BODY}) WHERE method = 'IQR') AS s)""",
        f"""scores AS (
          SELECT 'completeness' AS dimension, CAST(CASE WHEN complete >= 99 THEN 100 WHEN complete >= 95 THEN 95 WHEN complete >= 90 THEN 88 WHEN complete >= 75 THEN 75 ELSE 50 END AS DOUBLE) AS score, 0.25 AS weight FROM facts
          UNION ALL SELECT 'uniqueness', {r('greatest(0, 100 * (1 - dup) - CASE WHEN dup > 0.05 THEN 10 * least(dup, 0.5) ELSE 0 END)', 1)}, 0.15 FROM facts
          UNION ALL SELECT 'validity', {r('greatest(0, 100 - 40 * least(w, 2.5))', 1)}, 0.2 FROM facts
          UNION ALL SELECT 'consistency', {r('greatest(0, 100 - typed - CASE WHEN k > 0 THEN least(5 + 6 * k, 35) ELSE 0 END)', 1)}, 0.2 FROM facts
          UNION ALL SELECT 'accuracy', {r('greatest(0, 100 - 60 * least(s, 1))', 1)}, 0.2 FROM facts)""",
        f"""scored AS (SELECT dimension, score, CAST(weight AS DOUBLE) AS weight FROM scores
          UNION ALL SELECT 'overall', {r('sum(score * CAST(weight AS DOUBLE))', 1)}, 1.0 FROM scores)""",
    ]


@check("score_dimensions", dirty(f"SELECT dimension, score, weight, {GRADE} AS grade FROM scored WHERE dimension <> 'overall'", *score_ctes()))
def _(spark, sf):
    return score.quality_score(dirty_orders(spark, sf), AS_OF).where("dimension <> 'overall'").drop("detail")


@check("score_overall", dirty(f"SELECT score AS overall, {GRADE} AS grade FROM scored WHERE dimension = 'overall'", *score_ctes()))
def _(spark, sf):
    return score.quality_score(dirty_orders(spark, sf), AS_OF).where("dimension = 'overall'").select(F.col("score").alias("overall"), "grade")


def _deduplicated_score() -> str:
    """The same score statement with ``d`` replaced by its distinct rows."""
    whole = dirty("SELECT dimension, score FROM scored", *score_ctes())
    return whole.replace("d AS (SELECT * EXCLUDE (row_id) FROM keyed)", "d AS (SELECT DISTINCT * EXCLUDE (row_id) FROM keyed)")


@check("score_delta", f"""SELECT b.dimension, b.score AS "before", a.score AS "after", {r('a.score - b.score', 1)} AS delta
  FROM ({dirty("SELECT dimension, score FROM scored", *score_ctes())}) b JOIN ({_deduplicated_score()}) a ON a.dimension = b.dimension""")
def _(spark, sf):
    table = dirty_orders(spark, sf)
    return score.score_delta(score.quality_score(table, AS_OF), score.quality_score(drop_duplicates(table), AS_OF))
