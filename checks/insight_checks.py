"""Findings, top issues and the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayframe.operators import clean, eda, insights, report
from assayframe.plans.facts import Facts
from assayframe.plans.wide import union_all
from checks.clean_checks import LOG_LINES, MOMENT, STEPS, cleaning_run
from checks.eda_checks import KNOWN, PRICED_LABELS, PRICED_NUMBERS, RELATED, SHAPE, SIGN, STATS, SUMMARY_BODY, _eta, _label_ctes, _pairs, _tables, priced_lines
from checks.inputs import dirty_keyed, dirty_orders, read
from checks.profile_checks import DUPLICATES_BODY, KINDS, TOTALS_BODY
from checks.quality_checks import DIRTY_LABELS, DIRTY_OUTLIERS, INCONSISTENT_BODY, OUTLIERS_BODY, TYPE_ISSUES_BODY, VALIDATION_BODY
from checks.registry import ALL_TEXT, AS_OF, DIRTY_DATES, DIRTY_NUMBERS, LABELLED, check, dirty, long, pct, r

# Rules as (category, severity) rows; the pieces are the statements of the other checks.
FOUND = f"""found AS (
  SELECT 'structure' AS category, 'info' AS severity, 'shape' AS what
  UNION ALL SELECT 'data_issue', 'warning', 'duplicates' FROM ({DUPLICATES_BODY}) WHERE duplicate_rows > 0
  UNION ALL SELECT 'data_issue', CASE WHEN overall_pct > 5 THEN 'warning' ELSE 'info' END, 'missing' FROM ({TOTALS_BODY}) WHERE overall_pct > 1
  UNION ALL SELECT 'distribution', CASE WHEN abs(sk) >= 1.5 THEN 'warning' ELSE 'info' END, 'skew' FROM stats WHERE abs(sk) >= 0.5
  UNION ALL SELECT 'distribution', 'info', 'dispersion' FROM stats WHERE mean <> 0 AND sd / mean > 2
  UNION ALL SELECT 'distribution', 'info', 'dominated' FROM judged WHERE distribution_label LIKE '%dominated%' OR distribution_label LIKE '%constant%'
  UNION ALL SELECT 'relationship', 'info', 'eta' FROM etas WHERE eta >= 0.6
  UNION ALL SELECT 'relationship', 'info', 'v' FROM vs WHERE v >= 0.6
  UNION ALL SELECT 'relationship', 'info', 'r' FROM (SELECT corr(total, x) AS r FROM (SELECT total, {DIRTY_NUMBERS['qty_txt']} AS x FROM d)) WHERE abs(r) >= 0.6
  UNION ALL SELECT 'data_issue', 'warning', 'gaps' FROM (SELECT col FROM cells GROUP BY col HAVING {pct('count(*) - count(v)', 'count(*)')} > 10)
  UNION ALL SELECT 'data_issue', 'warning', 'types' FROM ({TYPE_ISSUES_BODY}) WHERE anomalous_count > 0
  UNION ALL SELECT 'anomaly', 'warning', 'outliers' FROM ({OUTLIERS_BODY}) WHERE method = 'IQR' AND outliers > 0 AND share_pct >= 2
  UNION ALL SELECT 'data_issue', 'warning', 'labels' FROM (SELECT DISTINCT "column" FROM ({INCONSISTENT_BODY}))
  UNION ALL SELECT 'data_issue', CASE severity WHEN 'error' THEN 'error' ELSE 'info' END, 'rules' FROM ({VALIDATION_BODY}) WHERE severity <> 'info'
  UNION ALL SELECT 'structure', 'info', 'span' FROM (SELECT col FROM dates WHERE t IS NOT NULL GROUP BY col HAVING count(*) >= 2 AND date_diff('day', min(t), max(t)) > 0))"""

PIECES = [
    f"cells AS ({long('d', ALL_TEXT)})", *DIRTY_OUTLIERS, *DIRTY_LABELS, f"dates AS ({long('d', DIRTY_DATES, 't')})",
    f"stat_numbers AS ({long('d', DIRTY_NUMBERS, 'x')})",
    KNOWN.replace("known AS", "stat_known AS").replace("FROM numbers", "FROM stat_numbers"), STATS.replace("known", "stat_known"),
    *[c.replace("labels AS", "plot_labels AS").replace("FROM labels", "FROM plot_labels").replace("total AS", "plot_total AS").replace("CROSS JOIN total", "CROSS JOIN plot_total")
      .replace("counts AS", "plot_counts AS").replace("FROM counts", "FROM plot_counts") for c in _label_ctes("d", LABELLED)],
    _eta("d", DIRTY_NUMBERS, LABELLED), _tables("d", LABELLED), FOUND,
]


def pct1(x: str) -> str:
    return f"printf('%.1f%%', CAST(round(CAST({x} AS DECIMAL(18,6)), 1) AS DOUBLE))"


def two(x: str) -> str:
    return f"format('{{:,.2f}}', CAST(round(CAST({x} AS DECIMAL(18,6)), 2) AS DOUBLE))"


def signed(x: str) -> str:
    return f"printf('%+.2f', {x})"


SHAPE_LABEL = f"(SELECT col AS c, {SHAPE} AS label FROM stats)"

# The same rules with their sentences.
TEXTS = f"""findings AS (
  SELECT 1 AS rule, 0 AS place, 0 AS sub, 'structure' AS category, 'info' AS severity,
    printf('The dataset has %s rows and 11 columns (%d numeric, %d categorical, %d datetime, %d free-text, %d boolean).', format('{{:,}}', (SELECT count(*) FROM d)),
      count_if(kind = 'numerical'), count_if(kind = 'categorical'), count_if(kind = 'datetime'), count_if(kind = 'text'), count_if(kind = 'boolean')) AS text FROM kinds
  UNION ALL SELECT 2, 0, 0, 'data_issue', 'warning', format('{{:,}}', CAST(duplicate_rows AS BIGINT)) || ' fully duplicated rows (' || {pct1('100.0 * duplicate_rows / (SELECT count(*) FROM d)')} || ') will skew all downstream metrics if left untouched.'
    FROM ({DUPLICATES_BODY}) WHERE duplicate_rows > 0
  UNION ALL SELECT 3, 0, 0, 'data_issue', CASE WHEN overall_pct > 5 THEN 'warning' ELSE 'info' END, 'Overall missingness is ' || {pct1('overall_pct')} || ' across ' || format('{{:,}}', total_missing) || ' cells.'
    FROM ({TOTALS_BODY}) WHERE overall_pct > 1
  UNION ALL SELECT 4, pos, 0, 'distribution', CASE WHEN abs(sk) >= 1.5 THEN 'warning' ELSE 'info' END,
    CASE WHEN abs(sk) >= 1.5 THEN '''' || col || ''' is highly skewed (' || {signed('sk')} || ') — ' || label || '. Consider log/square-root transforms for models.'
      ELSE '''' || col || ''' is mildly skewed (' || {signed('sk')} || ').' END FROM stats JOIN {SHAPE_LABEL} ON c = col WHERE abs(sk) >= 0.5
  UNION ALL SELECT 4, pos, 1, 'distribution', 'info', '''' || col || ''' has very high relative dispersion (CV=' || {two('sd / mean')} || ') — values are spread over many orders of magnitude.'
    FROM stats WHERE mean <> 0 AND sd / mean > 2
  UNION ALL SELECT 5, pos, 0, 'distribution', 'info', CASE WHEN distribution_label LIKE '%dominated%'
      THEN '''' || "column" || ''' is dominated by a single category (' || {pct1('dominant_share')} || ' of rows). Check whether ≤' || n_unique || ' categories are truly meaningful.'
      ELSE '''' || "column" || ''' is constant — it carries no discriminating information.' END
    FROM judged WHERE distribution_label LIKE '%dominated%' OR distribution_label LIKE '%constant%'
  UNION ALL SELECT 6, CAST((1 - abs(m)) * 1000000000 AS BIGINT), 0, 'relationship', 'info', text FROM (
    SELECT r AS m, CASE WHEN abs(r) >= 0.85 THEN 'Very strong' ELSE 'Strong' END || ' ' || {SIGN} || ' correlation (' || {signed('r')} || ') between ''' || x || ''' and ''' || y || '''. '
      || CASE WHEN abs(r) > 0.9 THEN 'This may indicate redundancy.' ELSE '' END AS text FROM pairs WHERE abs(r) >= 0.6
    UNION ALL SELECT eta, '''' || num || ''' varies strongly with ''' || cat || ''' (eta=' || printf('%.2f', eta) || '): ' || lower(printf('Category of %s explains ~%.0f%% of variance in %s', cat, 100 * eta * eta, num)) || '.' FROM etas WHERE eta >= 0.6
    UNION ALL SELECT v, '''' || x || ''' and ''' || y || ''' are strongly associated (Cramér''s V=' || printf('%.2f', v) || ') — they may encode overlapping information.' FROM vs WHERE v >= 0.6)
  UNION ALL SELECT 7, CAST(-missing * 1000000 / total AS BIGINT), 0, 'data_issue', 'warning', 'Column ''' || col || ''' is missing ' || {two('pct')} || '% of its values (' || format('{{:,}}', missing) || ' cells).'
    FROM (SELECT col, count(*) AS total, count(*) - count(v) AS missing, {pct('count(*) - count(v)', 'count(*)')} AS pct FROM cells GROUP BY col) WHERE pct > 10
  UNION ALL SELECT 8, place, 0, 'data_issue', 'warning', '''' || "column" || ''' contains ' || anomalous_count || ' values that don''t parse as ' || detected_as || ' (e.g. ''' || examples || ''').'
    FROM ({TYPE_ISSUES_BODY}) JOIN places ON name = "column" WHERE anomalous_count > 0
  UNION ALL SELECT 9, place, 0, 'anomaly', 'warning', 'IQR method flags ' || outliers || ' outliers (' || {pct1('share_pct')} || ') in ''' || "column" || ''' outside [' || {two('lower_bound')} || ', ' || {two('upper_bound')} || '].'
    FROM ({OUTLIERS_BODY}) JOIN places ON name = "column" WHERE method = 'IQR' AND outliers > 0 AND share_pct >= 2
  UNION ALL SELECT 10, place, 0, 'data_issue', 'warning', '''' || "column" || ''' has inconsistent labels: ''' || variants || ''' look like the same value (' || n_variants || ' variants). Standardise casing before analysis.'
    FROM ({INCONSISTENT_BODY}) JOIN places ON name = "column" WHERE "rank" = 1
  UNION ALL SELECT 11, coalesce(place, 0), 0, 'data_issue', CASE severity WHEN 'error' THEN 'error' ELSE 'info' END,
    CASE severity WHEN 'error' THEN "check" || ' check failed on ''' || "column" || ''': ' || failures || ' violations (' || {pct1('share_pct')} || '). ' || detail
      ELSE "check" || ' check on ''' || "column" || ''' found ' || failures || ' suspicious values (' || {pct1('share_pct')} || ').' END
    FROM ({VALIDATION_BODY}) LEFT JOIN places ON name = "column" WHERE severity <> 'info'
  UNION ALL SELECT 12, pos, 0, 'structure', 'info', '''' || col || ''' spans ' || days || ' days (' || CAST(first AS DATE) || ' → ' || CAST(last AS DATE) || ') with ' ||
    CASE WHEN n / CAST(days AS DOUBLE) >= 100 THEN 'high' WHEN n / CAST(days AS DOUBLE) >= 1 THEN 'medium' ELSE 'sparse' END || ' data density (~' || printf('%.1f', CAST(round(CAST(n / CAST(days AS DOUBLE) AS DECIMAL(18,6)), 1) AS DOUBLE)) || ' records/day).'
    FROM (SELECT pos, col, count(t) AS n, min(t) AS first, max(t) AS last, CAST(floor((epoch(max(t)) - epoch(min(t))) / 86400) AS BIGINT) AS days FROM dates WHERE t IS NOT NULL GROUP BY pos, col) WHERE n >= 2 AND days > 0)"""

NAMED_PLACES = "places AS (SELECT DISTINCT pos + 1 AS place, col AS name FROM cells)"
TEXT_PIECES = [KINDS.replace("judged", "kind_judged"), *PIECES[:-1], _pairs("d", DIRTY_NUMBERS), NAMED_PLACES, TEXTS]


@check("insight_counts", dirty("SELECT category, severity, count(*) AS n FROM found GROUP BY category, severity", *PIECES))
def _(spark, sf):
    found = insights.insights(dirty_orders(spark, sf), AS_OF)
    return found.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))


@check("health", dirty(
    f"""SELECT count(*) AS findings, CAST(count_if(severity <> 'info') AS BIGINT) AS issues, {r("1 - count_if(severity <> 'info') / CAST(count(*) AS DOUBLE)")} AS health FROM found""",
    *PIECES))
def _(spark, sf):
    from checks.registry import round_all

    return round_all(insights.health(insights.insights(dirty_orders(spark, sf), AS_OF)))


@check("insights", dirty("SELECT category, severity, text FROM findings", *TEXT_PIECES))
def _(spark, sf):
    return insights.insights(dirty_orders(spark, sf), AS_OF)


@check("insights_structure", dirty("SELECT text FROM findings WHERE rule <= 3", *TEXT_PIECES))
def _(spark, sf):
    return insights.structural_insights(Facts.of(dirty_orders(spark, sf))).select("text")


@check("insights_with_log", dirty(
    """SELECT category, severity, text FROM findings
    UNION ALL SELECT 'structure', 'info', printf('Cleaning applied %d transformations — see the cleaning log for details.', (SELECT count(*) - 2 FROM log))""",
    *TEXT_PIECES, *STEPS, f"log AS ({LOG_LINES})"))
def _(spark, sf):
    return insights.insights(dirty_orders(spark, sf), AS_OF, cleaning_run(spark, sf).log(MOMENT))


@check("insights_relationships", f"""WITH {', '.join(RELATED)} SELECT CASE "type"
    WHEN 'num-num' THEN printf('%s %s correlation (%+.2f) between ''%s'' and ''%s''. %s', CASE WHEN abs(metric) >= 0.85 THEN 'Very strong' ELSE 'Strong' END,
      direction, metric, x, y, CASE WHEN abs(metric) > 0.9 THEN 'This may indicate redundancy.' ELSE '' END)
    WHEN 'num-cat' THEN printf('''%s'' varies strongly with ''%s'' (eta=%.2f): %s.', y, x, metric, lower(detail))
    ELSE printf('''%s'' and ''%s'' are strongly associated (Cramér''s V=%.2f) — they may encode overlapping information.', x, y, metric) END AS text
  FROM related WHERE abs(metric) >= 0.65 OR ("type" <> 'num-num' AND metric >= 0.6)""")
def _(spark, sf):
    return insights.relationship_insights(Facts.of(priced_lines(spark, sf))).select("text")


@check("insights_events")
def _(spark, sf):
    return insights.insights(read(spark, sf, "events"), AS_OF)


@check("top_issues", dirty(
    """SELECT severity, text FROM findings WHERE severity IN ('error', 'warning') ORDER BY CASE severity WHEN 'error' THEN 0 ELSE 1 END, rule, place, sub, text LIMIT 8""", *TEXT_PIECES))
def _(spark, sf):
    return insights.top_issues(insights.insights(dirty_orders(spark, sf), AS_OF), 8)


@check("report_tables")
def _(spark, sf):
    return report.report(Facts(dirty_keyed(spark, sf), order_by="row_id"), "dirty_orders", "2000-01-01 00:00:00", AS_OF)


@check("quality_suite", dirty(
    f"""SELECT 'missing' AS section, count(DISTINCT col) AS n FROM cells UNION ALL SELECT 'duplicates', count(*) FROM ({DUPLICATES_BODY})
    UNION ALL SELECT 'type_issues', count(*) FROM ({TYPE_ISSUES_BODY}) WHERE anomalous_count > 0 UNION ALL SELECT 'outliers', count(*) FROM ({OUTLIERS_BODY})
    UNION ALL SELECT 'categorical', count(DISTINCT col) FROM counts UNION ALL SELECT 'validation', count(*) FROM ({VALIDATION_BODY})""", *PIECES[:-1]))
def _(spark, sf):
    suite = report.quality_suite(dirty_orders(spark, sf), AS_OF)
    return union_all([frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("section"), "n") for name, frame in suite.items()])


@check("eda_suite", f"""WITH {', '.join(RELATED)}, numbers AS ({long('priced', PRICED_NUMBERS, 'x')}), {KNOWN}, {STATS}, {', '.join(_label_ctes('priced', PRICED_LABELS))}
    SELECT 'numeric' AS section, count(*) AS n FROM stats UNION ALL SELECT 'categorical', count(*) FROM ({SUMMARY_BODY})
    UNION ALL SELECT 'correlations', 2 * count(*) + (SELECT count(*) FROM stats) FROM pairs UNION ALL SELECT 'relationships', count(*) FROM related""")
def _(spark, sf):
    suite = eda.eda_suite(priced_lines(spark, sf))
    return union_all([frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("section"), "n") for name, frame in suite.items()])


@check("impute_unknown", """SELECT 'missing-impute' AS operation, 'email' AS columns, 'Could not impute using ''magic'': Unknown method: magic' AS detail,
  CAST(0 AS BIGINT) AS rows_affected FROM (SELECT count(*) FROM orders)""")
def _(spark, sf):
    options = clean.CleaningOptions(imputation={"email": "magic"}, correct_types=False)
    log = clean.CleaningRun(dirty_orders(spark, sf), options=options).log()
    return log.where("operation = 'missing-impute'").select("operation", "columns", "detail", "rows_affected")
