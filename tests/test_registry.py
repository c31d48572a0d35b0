import os

import pytest

import __spark_entry__ as entry_point
from checks import CHECKS
from checks.compare import TABLES, canonical

SF = "/root/testdata/sf0.001"
QUICK = [
    "detect_types", "profile_full", "missing_totals", "duplicate_summary", "type_issues", "outliers_dirty", "label_inconsistent",
    "validation_all", "score_dimensions", "impute_ffill_keyed", "clean_pipeline", "cleaning_log", "relationships", "hist_bins", "csv_na_tokens",
]


def test_names_and_statements_agree():
    queries, statements = entry_point.queries(), entry_point.oracle_sql()
    assert set(statements) <= set(queries) and len(queries) > 90
    assert all(callable(q) for q in queries.values())


def test_only_queries_without_sql_are_left_out():
    left_out = set(CHECKS) - set(entry_point.oracle_sql())
    assert left_out == {
        "insights_events", "report_tables",
    }


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry_point.queries()[name](spark, SF)
    cursor = con.execute(entry_point.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.columns, df.collect()) == canonical(columns, cursor.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry(spark):
    found = {r["dimension"]: r["score"] for r in entry_point.entry(spark).collect()}
    assert set(found) == {"completeness", "uniqueness", "validity", "consistency", "accuracy", "overall"}
    assert all(0 <= s <= 100 for s in found.values())
