import datetime as dt

import pytest

from assayframe.operators import categories, missing, outliers, score, validation
from assayframe.plans.facts import Facts
from conftest import by_column, rows

AS_OF = dt.datetime(2024, 6, 1)


def test_missing_totals_and_order(spark):
    df = spark.createDataFrame([(1, None, None), (2, float("nan"), "x"), (3, 1.0, "y")], "i int, x double, s string")
    assert rows(missing.missing_by_column(df)) == [("x", 2, 66.67), ("s", 1, 33.33), ("i", 0, 0.0)]
    assert missing.missing_totals(df).first() == (9, 3, 33.33, 66.67, 2)
    assert missing.missing_totals(df.where("i > 9")).first()["completeness_pct"] == 100.0


def test_type_issues_use_their_own_denominators(spark):
    data = [("10", "2024-01-01")] * 9 + [("x", "2024-01-02")] * 2 + [(None, None)] * 2 + [("11", "soon")] * 2
    issues = by_column(validation.type_issues(spark.createDataFrame(data, "n string, d string")))
    assert (issues["n"]["anomalous_count"], issues["n"]["anomalous_share"], issues["n"]["examples"]) == (2, 13.33, "x")
    assert (issues["d"]["anomalous_count"], issues["d"]["anomalous_share"], issues["d"]["examples"]) == (2, 15.38, "soon")


def test_outliers_need_six_cells_and_spread(spark):
    five = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "x double")
    assert outliers.outliers(five).count() == 0
    six = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5, 100)], "x double")
    assert rows(outliers.outliers(six, "IQR")) == [("x", "IQR", -1.5, 8.5, 1, 16.67)]
    flat = spark.createDataFrame([(2.5,)] * 8, "x double")
    assert [r["method"] for r in outliers.outliers(flat).collect()] == ["IQR"]


def test_fences_are_strict(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4, 5, 6, 7, 8)] + [(14.0,), (-6.0,)], "x double")
    low, high = Facts(df).fences()["x"]
    edge = spark.createDataFrame([(low,), (high,)], "x double")
    assert outliers.outlier_tests(Facts(df))[0][2:4] == (low, high)
    hit = outliers.outlier_tests(Facts(df))[0][4]
    assert edge.where(hit).count() == 0


def test_inconsistent_labels_and_advice(spark):
    data = [("North",), ("north",), ("NORTH ",), ("South",), ("new  york",), ("New York",)] * 10
    df = spark.createDataFrame(data, "region string")
    found = rows(categories.inconsistent_labels(df).orderBy("rank").select("normalised", "n_variants", "variants"))
    assert found == [("north", 3, "NORTH , North, north"), ("new york", 2, "New York, new  york")]
    assert categories.category_analysis(df).first()["suggestion"] == categories.ADVICE_STANDARDISE


def test_rare_and_top(spark):
    df = spark.createDataFrame([("a",)] * 150 + [("b",)] * 50 + [("c",)], "s string")
    assert [(r["value"], r["percentage"]) for r in categories.category_rare(df).collect()] == [("c", 0.5)]
    assert [r["value"] for r in categories.category_top(df).orderBy("rank").collect()] == ["a", "b", "c"]


def test_validation_rules(spark):
    data = [
        (i, float(i % 50) - 1, "bad" if i % 40 == 0 else f"u{i}@x.org", "12" if i % 50 == 0 else "+1 555 1234567",
         dt.datetime(2024, 1, 1) + dt.timedelta(days=i), dt.datetime(2024, 1, 5) + dt.timedelta(days=i - (10 if i % 30 == 0 else 0)), f"K{i // 2}")
        for i in range(200)
    ] + [(200, 1e9, "u@x.org", "+1 555 1234567", None, None, "K500")]
    df = spark.createDataFrame(data, "n int, amount double, email string, phone string, start_day timestamp_ntz, end_day timestamp_ntz, sku string")
    got = {(r["column"], r["check"]): r for r in validation.validate(df, AS_OF).collect()}
    assert got["amount", "value range"]["failures"] == 1 and got["amount", "value range"]["examples"] == "1000000000"
    assert got["amount", "negative value"]["failures"] == 4
    assert got["email", "email format"]["failures"] == 5 and got["email", "email format"]["examples"] == "bad"
    assert got["phone", "phone format"]["failures"] == 4
    assert got["sku", "ID uniqueness"]["failures"] == 100 and got["sku", "ID uniqueness"]["severity"] == "error"
    assert got["start_day", "future date"]["failures"] == 47 and got["start_day", "future date"]["share_pct"] == 23.38
    assert got["start_day vs end_day", "start<=end"]["failures"] == 7


def test_name_rules_take_the_first_marker_and_can_be_overridden(spark):
    df = spark.createDataFrame([(f"w{i}", f"v{i % 60}") for i in range(120)], "email_id string, width string")
    got = {(r["column"], r["check"]) for r in validation.validate(df, AS_OF).collect()}
    assert got == {("email_id", "email format"), ("width", "ID uniqueness")}
    assert {r["column"] for r in validation.validate(df, AS_OF, {"width": "none"}).collect()} == {"email_id"}


def test_date_pairs():
    assert validation.date_pairs(["Start_Date", "end_date", "valid_from", "valid_to", "start_x"]) == [("Start_Date", "end_date"), ("valid_from", "valid_to")]


@pytest.mark.parametrize("amount,word", [(90, "Excellent"), (89.9, "Good"), (80, "Good"), (65, "Fair"), (50, "Poor"), (49.9, "Critical")])
def test_grades(spark, amount, word):
    from pyspark.sql import functions as F

    assert spark.range(1).select(score.grade(F.lit(float(amount)))).first()[0] == word


def test_score_of_clean_and_empty_tables(spark):
    clean = spark.range(100).selectExpr("cast(id + 0.5 AS double) AS x", "concat('c', id % 4) AS c")
    got = {r["dimension"]: r["score"] for r in score.quality_score(clean, AS_OF).collect()}
    assert got == {"completeness": 100.0, "uniqueness": 100.0, "validity": 100.0, "consistency": 100.0, "accuracy": 100.0, "overall": 100.0}
    assert {r["score"] for r in score.quality_score(clean.where("x < 0"), AS_OF).collect()} == {0.0}


def test_score_weights_and_penalties(spark):
    df = spark.createDataFrame([("North",), ("north",)] * 30 + [(None,)] * 4, "region string")
    got = {r["dimension"]: r["score"] for r in score.quality_score(df, AS_OF, {**score.WEIGHTS, "completeness": 0.3}).collect()}
    assert got["completeness"] == 88.0  # 93.75 % filled
    assert got["consistency"] == 89.0  # one column with variants: 5 + 6
    assert got["uniqueness"] == 0.0  # 61 of 64 rows repeat: 4.7 - 5, floored
    delta = score.score_delta(score.quality_score(df, AS_OF), score.quality_score(df.distinct(), AS_OF))
    assert {r["dimension"]: r["delta"] for r in delta.collect()}["uniqueness"] == 100.0
