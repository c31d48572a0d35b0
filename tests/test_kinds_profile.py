import datetime as dt
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayframe.functions.coerce import as_boolean, as_number, as_timestamp, normalise_label, strip
from assayframe.operators import kinds, profile
from assayframe.plans.facts import Facts
from conftest import by_column, rows


def kind_of(spark, values, dtype="string"):
    return kinds.detect_kinds(spark.createDataFrame([(v,) for v in values], f"v {dtype}"))["v"]


@pytest.mark.parametrize("text,number", [
    ("1,200", 1200.0), ("$5.5", 5.5), ("50%", 50.0), ("1e3", 1000.0), (" 7 ", 7.0), (".5", 0.5), ("5.", 5.0),
    ("1d", None), ("NaN", None), ("inf", None), ("2024-01-15", None), ("555-1234", None), ("1.2.3", None), ("", None), ("abc", None),
])
def test_number_view(spark, text, number):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(as_number(F.col("v"), df.schema["v"].dataType)).first()[0] == number


@pytest.mark.parametrize("text,stamp", [
    ("2024-01-15", dt.datetime(2024, 1, 15)), ("2024-1-5 10:30", dt.datetime(2024, 1, 5, 10, 30)),
    ("2024/02/03", dt.datetime(2024, 2, 3)), ("02/03/2024", dt.datetime(2024, 2, 3)), ("5 Jan 2024", dt.datetime(2024, 1, 5)),
    ("01-15-2024", dt.datetime(2024, 1, 15)), ("Jan 15 2024", dt.datetime(2024, 1, 15)), ("15 Jan 2024 10:30", dt.datetime(2024, 1, 15, 10, 30)),
    ("Mon, 15 Jan 2024 10:00:00 GMT", dt.datetime(2024, 1, 15, 10)), ("2024.01.15", dt.datetime(2024, 1, 15)), ("15.01.24", dt.datetime(2024, 1, 15)),
    ("2024-01", dt.datetime(2024, 1, 1)), ("20240115T103000", dt.datetime(2024, 1, 15, 10, 30)), ("January 5, 2024 3:00 PM", dt.datetime(2024, 1, 5, 15)),
    ("1/5/99", dt.datetime(1999, 1, 5)), ("15 Foo 2024", None), ("1.2.34", None), ("10-20-30", None), ("12345678", None), ("1999-2000", None),
    ("Jan 5, 2024", dt.datetime(2024, 1, 5)), ("2024-13-01", None), ("bad-date", None), ("12", None), ("", None),
])
def test_timestamp_view(spark, text, stamp):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(as_timestamp(F.col("v"), df.schema["v"].dataType)).first()[0] == stamp


@pytest.mark.parametrize("text", ["15-01-2024", "15/01/24", "15/01/2024"])
def test_days_first(spark, text):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(as_timestamp(F.col("v"), df.schema["v"].dataType, True)).first()[0] == dt.datetime(2024, 1, 15)


def test_boolean_and_label_views(spark):
    df = spark.createDataFrame([(" Yes",), ("f",), ("maybe",), (None,)], "v string")
    assert [r[0] for r in df.select(as_boolean(F.col("v"), df.schema["v"].dataType)).collect()] == [True, False, None, None]
    one = spark.createDataFrame([("  New\t\nYork ",)], "v string")
    assert one.select(strip(F.col("v")), normalise_label(F.col("v"))).first() == ("New\t\nYork", "new york")


def test_kind_rules_and_edges(spark):
    assert kind_of(spark, ["yes", "NO ", None]).kind == "boolean"
    assert kind_of(spark, ["yes", "no", "y"]).kind != "boolean"
    assert kind_of(spark, [0, 1, 1], "int").kind == "boolean"
    assert kind_of(spark, [0, 1, 2], "int").kind == "numerical"
    assert kind_of(spark, [1.0, 0.0], "double").kind == "numerical"
    assert kind_of(spark, [None, None]) == kinds.Kind("v", "text", 0.4, "Column is entirely empty", "empty")
    # The shares must exceed their thresholds.
    assert kind_of(spark, ["1", "2", "3", "x"] * 5).kind == "categorical"
    assert kind_of(spark, ["10", "20", "30", "40"] * 20 + ["abc"] * 20).kind == "numerical"
    assert kind_of(spark, ["2024-01-01"] * 4 + ["x"]).kind == "categorical"
    assert kind_of(spark, ["2024-01-01"] * 9 + ["x"]).kind == "datetime"
    assert kind_of(spark, ["a", "b"] * 20).confidence == 0.85
    assert kind_of(spark, ["a", "b", "c"]).confidence == 0.8
    assert kind_of(spark, [f"w{i}" for i in range(100)]).kind == "categorical"
    assert kind_of(spark, [f"w{i}" for i in range(101)]).kind == "text"
    assert kind_of(spark, [f"w{i}" for i in range(3000)]).kind == "text"
    assert kind_of(spark, [["a"], ["b"]], "array<string>").kind == "categorical"


def test_kinds_do_not_depend_on_partitioning(spark):
    df = spark.range(500).selectExpr("concat('id', id) AS a", "cast(id % 7 AS string) AS b", "if(id % 3 = 0, 'yes', 'no') AS c")
    assert kinds.detect_kinds(df) == kinds.detect_kinds(df.repartition(13))


def test_profile_against_pandas(spark):
    values = [1.0, 2.0, 2.0, 3.5, 10.0, None, float("nan"), -4.0]
    df = spark.createDataFrame([(i, v, "a" if i % 3 else "b") for i, v in enumerate(values)], "i int, x double, c string")
    facts = Facts(df, order_by="i")
    got = by_column(profile.profile(facts))["x"]
    s = pd.Series([v for v in values if v is not None and v == v])
    assert (got["count"], got["missing"], got["missing_pct"], got["unique"]) == (6, 2, 25.0, 5)
    assert got["mean"] == round(s.mean(), 3) and got["std"] == round(s.std(), 4)
    assert got["skew"] == round(s.skew(), 3) and got["kurtosis"] == round(s.kurt(), 3)
    assert (got["first"], got["last"]) == ("1", "-4")
    assert by_column(profile.profile(facts))["c"]["mode"] == "a"


def test_profile_small_and_constant(spark):
    three = by_column(profile.numeric_moments(spark.createDataFrame([(1.5,), (2.5,), (9.5,)], "x double")))["x"]
    assert three["skew"] is None and three["kurtosis"] is None and three["std"] == round(statistics.stdev([1.5, 2.5, 9.5]), 4)
    same = by_column(profile.numeric_moments(spark.createDataFrame([(5.5,)] * 6, "x double")))["x"]
    assert same["skew"] == 0.0 and same["kurtosis"] == 0.0 and same["std"] == 0.0


def test_empty_table_is_refused(spark):
    with pytest.raises(ValueError):
        profile.profile(spark.createDataFrame([], "x double"))


def test_value_counts_keep_null(spark):
    df = spark.createDataFrame([("a",), (None,), (None,), ("b",)], "v string")
    assert rows(profile.value_counts_with_nulls(df, "v", 2)) == [(None, 2, 50.0), ("a", 1, 25.0)]
