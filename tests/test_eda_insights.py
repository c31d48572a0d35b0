import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayframe.functions.stats import distribution_label, histogram_bins, strength_word
from assayframe.operators import chartdata, eda, insights, report
from assayframe.plans.facts import Facts
from conftest import by_column, rows

AS_OF = dt.datetime(2024, 6, 1)


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


@pytest.mark.parametrize("skew,kurt,label", [
    (None, None, "unknown"), (0.0, 0.0, "roughly normal / symmetric"), (0.29, 0.6, "symmetric"), (0.1, 1.1, "symmetric with heavy tails"),
    (0.1, None, "symmetric"), (0.3, 0.0, "mildly skewed right"), (-0.3, 0.0, "mildly skewed left"), (1.0, 0.0, "mildly skewed right"),
    (1.01, 0.0, "strongly skewed right (right tail)"), (-1.01, 9.0, "strongly skewed left (left tail)"),
])
def test_distribution_labels(spark, skew, kurt, label):
    assert one(spark, distribution_label(F.lit(skew).cast("double"), F.lit(kurt).cast("double"))) == label


@pytest.mark.parametrize("n,spread,iqr,bins", [(4, 1.0, 1.0, 5), (29, 1.0, 1.0, 5), (30, 1.0, 0.0, 50), (1000, 10.0, 2.0, 25), (30, 1.0, 100.0, 5)])
def test_bins(spark, n, spread, iqr, bins):
    assert one(spark, histogram_bins(F.lit(n), F.lit(spread), F.lit(iqr))) == bins


@pytest.mark.parametrize("r,word", [(0.85, "very strong"), (-0.65, "strong"), (0.4, "moderate"), (-0.2, "weak"), (0.19, "very weak")])
def test_strength(spark, r, word):
    assert one(spark, strength_word(F.lit(r))) == word


def frame(n=400):
    rng = np.random.default_rng(8)
    x = rng.normal(1e6, 3, n)
    pdf = pd.DataFrame({
        "x": x, "y": -2 * x + rng.normal(0, 1, n), "z": rng.exponential(2, n), "flat": 3.5,
        "c": np.where(x > 1e6, "hi", "lo"), "d": rng.choice(["p", "q", "r"], n),
    })
    pdf["e"] = pdf["c"].str.upper()
    pdf.loc[::7, "y"] = np.nan
    pdf.loc[::11, "d"] = None
    return pdf


def test_describe_against_pandas(spark):
    pdf = frame()
    got = by_column(eda.describe(spark.createDataFrame(pdf)))
    for c in ("x", "y", "z", "flat"):
        s = pdf[c].dropna()
        want = {"count": len(s), "mean": s.mean(), "std": s.std(), "q25": s.quantile(0.25), "median": s.median(), "skew": s.skew(),
                "kurtosis": s.kurt(), "variance": s.var(), "range": s.max() - s.min(), "cv": s.std() / s.mean(), "mode": s.mode().iloc[0]}
        for k, v in want.items():
            assert got[c][k] == pytest.approx(v, rel=1e-6, abs=1e-7), (c, k)


def test_correlation_against_pandas(spark):
    pdf = frame()
    want = pdf[["x", "y", "z", "flat"]].corr()
    got = {(r["x"], r["y"]): r["r"] for r in eda.correlation_matrix(spark.createDataFrame(pdf)).collect()}
    assert len(got) == 16
    for (a, b), r in got.items():
        if "flat" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-9)
    top = eda.top_correlations(spark.createDataFrame(pdf)).first()
    assert (top["x"], top["y"], top["direction"]) == ("x", "y", "negative")


def test_associations(spark):
    pdf = frame()
    df = spark.createDataFrame(pdf)
    got = {(r["cat"], r["num"]): r["eta"] for r in eda.eta(df).collect()}
    t = pdf[["c", "x"]].dropna()
    groups = t.groupby("c")["x"]
    between = (groups.size() * (groups.mean() - t["x"].mean()) ** 2).sum()
    assert got["c", "x"] == pytest.approx(np.sqrt(between / (len(t) * t["x"].var())), abs=1e-9)
    assert not any(num == "flat" for _, num in got)
    v = {(r["x"], r["y"]): r["v"] for r in eda.cramers_v(df).collect()}
    assert v["c", "e"] == pytest.approx(1.0)
    table = pd.crosstab(pdf["c"], pdf["d"])
    expected = np.outer(table.sum(axis=1), table.sum(axis=0)) / table.to_numpy().sum()
    assert v["c", "d"] == pytest.approx(np.sqrt(((table - expected) ** 2 / expected).to_numpy().sum() / table.to_numpy().sum()), abs=1e-9)
    strong = eda.strong_relationships(df).collect()
    assert [r["metric"] for r in strong] == sorted((r["metric"] for r in strong), key=abs, reverse=True)
    assert {r["type"] for r in strong} == {"num-num", "num-cat", "cat-cat"}


def test_category_labels(spark):
    data = [("k", "a" if i < 80 else "b", f"g{i % 5}", f"h{i % 3 if i < 90 else 2}") for i in range(100)]
    got = by_column(eda.category_labels(spark.createDataFrame(data, "one string, dom string, five string, few string")))
    assert got["one"]["distribution_label"] == "constant (single value)"
    assert got["dom"]["distribution_label"] == "dominated by one category" and got["dom"]["dominant_share"] == 80.0
    assert got["five"]["distribution_label"] == "roughly balanced"
    assert got["few"]["distribution_label"] == "concentrated in few categories"


def test_histogram_closes_the_last_bin_and_keeps_empty_ones(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (9.9,), (10.0,), (None,)], "x double")
    assert [r["n"] for r in chartdata.histogram(df, "x", 5).orderBy("bin").collect()] == [2, 0, 0, 0, 2]


def test_time_series_fills_periods(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-03", 3.0), ("2024-01-03", 5.0)], "d string, x double")
    days = rows(chartdata.daily_counts(df, "d").orderBy("day"))
    assert days == [(dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 2), 0), (dt.date(2024, 1, 3), 2)]
    assert rows(chartdata.value_over_time(df, "d", "x")) == [(dt.date(2024, 1, 1), 3.0)]
    many = spark.range(60).selectExpr("date_add(date'2024-01-01', CAST(id * 2 AS INT)) AS d", "CAST(id AS DOUBLE) AS x")
    daily = rows(chartdata.value_over_time(many, "d", "x").orderBy("period"))
    assert len(daily) == 119 and daily[1][1] is None and daily[2][1] == 1.0


def test_grouped_box_matches_pandas(spark):
    pdf = frame()
    got = {r["label"]: r for r in chartdata.grouped_box(Facts(spark.createDataFrame(pdf)), "z", "d").collect()}
    for label, s in pdf.groupby("d")["z"]:
        assert got[label]["median"] == pytest.approx(s.median()) and got[label]["q3"] == pytest.approx(s.quantile(0.75))


def test_pie_composition_and_choice(spark):
    df = spark.createDataFrame([(f"v{i % 13:02d}", "x" if i % 2 else "y") for i in range(200)], "a string, b string")
    assert len(chartdata.pie_other(df, "a").collect()) == 11
    assert sum(r["n"] for r in chartdata.pie_other(df, "a").collect()) == 200
    assert chartdata.composition(df, "a", "b").agg(F.sum("n")).first()[0] == 200 - sum(200 // 13 + (i < 200 % 13) for i in range(8, 13))
    assert chartdata.interesting_categories(df).first()["column"] == "b"


def test_chart_plan(spark):
    plan = rows(chartdata.chart_plan(spark.createDataFrame(frame())).select("chart", "columns"))
    assert plan[0] == ("histogram", "z")
    assert [p[0] for p in plan] == ["histogram", "scatter matrix", "box plots", "bar", "pie", "correlation heatmap", "stacked bar"]


def test_insight_texts(spark):
    pdf = frame()
    pdf["when"] = pd.date_range("2024-01-01", periods=len(pdf), freq="D")
    texts = insights.insights(spark.createDataFrame(pdf), AS_OF).collect()
    found = [r["text"] for r in texts]
    assert "The dataset has 400 rows and 8 columns (4 numeric, 3 categorical, 1 datetime, 0 free-text, 0 boolean)." in found
    assert any(t.startswith("Very strong negative correlation (-") and t.endswith("This may indicate redundancy.") for t in found)
    assert "'when' spans 399 days (2024-01-01 → 2025-02-03) with medium data density (~1.0 records/day)." in found
    assert "Column 'y' is missing 14.50% of its values (58 cells)." in found
    order = [r["severity"] for r in texts]
    assert order == sorted(order, key=["error", "warning", "info"].index)


def test_top_issues_and_health(spark):
    tidy = insights.insights(spark.range(50).selectExpr("cast(id AS double) AS x"), AS_OF)
    assert rows(insights.top_issues(tidy)) == [("info", insights.CLEAN_MESSAGE)]
    assert insights.health(tidy).first() == (1, 0, 1.0)


@pytest.mark.parametrize("name", ["numeric", "categorical", "mixed", "dirty"])
def test_whole_suite_on_the_sample_tables(spark, name):
    from test_clean import mixed

    tables = {
        "numeric": lambda: spark.range(400).selectExpr("round(5000 + 1500 * sin(id), 2) AS sales", "200 + id % 17 AS units", "1 + id % 89 AS days_to_ship", "round(6 + 4 * cos(id), 2) AS return_rate"),
        "categorical": lambda: spark.range(300).selectExpr("element_at(array('North', 'South', 'north', 'NORTH', 'south ', 'East'), CAST(id % 6 AS INT) + 1) AS region", "element_at(array('Online', 'Retail', 'Partner'), CAST(id % 3 AS INT) + 1) AS channel", "id % 5 < 2 AS repeat"),
        "mixed": lambda: mixed(spark),
        "dirty": lambda: spark.createDataFrame([(a, b, c) for a, b, c in zip(["10", "20", "30", "40"] * 20 + ["abc"] * 20, ["1", "2", "3", "4"] * 25, ["x", "y"] * 50)], "a string, b string, cat string"),
    }
    facts = Facts(tables[name]())
    found = report.report(facts, name, "2024-01-01 00:00:00", AS_OF)
    sections = {r["section"] for r in found.select("section").distinct().collect()}
    assert {"overview", "profile", "missing", "duplicates", "insights", "score"} <= sections
    if name == "dirty":
        assert facts.kinds["a"].kind == "numerical"
    facts.release()


def test_pair_counts_equal_plain_counts(spark, monkeypatch):
    import collections
    import random

    from assayframe.plans import crosstabs

    rnd = random.Random(8)
    columns = [["x", "y", None], [f"many {i}" for i in range(300)], ["", "é", "x"], [None]]
    data = [tuple(rnd.choice(values) for values in columns) for _ in range(700)] + [("x", "hot", "x", None)] * 300
    df = spark.createDataFrame(data, "a string, b string, c string, d string").repartition(3)
    pairs = [(0, 1), (0, 2), (1, 2), (2, 0), (0, 3)]
    want = collections.Counter((p, r[x], r[y]) for r in data for p, (x, y) in enumerate(pairs) if r[x] is not None and r[y] is not None)
    for held in (1 << 20, 40):
        monkeypatch.setattr(crosstabs, "HELD", held)
        assert {(r["pair"], r["a"], r["b"]): r["n"] for r in crosstabs.pair_counts(df, pairs).collect()} == want
    assert crosstabs.pair_counts(df.limit(0), pairs).collect() == []
