import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayframe.operators.duplicates import drop_duplicates, duplicate_summary
from assayframe.plans.carry import directional_fill
from assayframe.plans.durable import clear_scratch, written
from assayframe.plans.duplicates import duplicate_groups
from assayframe.plans.facts import Facts
from assayframe.plans.frequency import top_per_group, value_counts
from assayframe.plans import quantiles as Q
from assayframe.plans.ordering import numbered
from assayframe.plans.quantiles import exact_quantiles
from conftest import rows


@pytest.mark.parametrize("shape", ["spread", "ties", "hot", "two", "far", "near", "signs"])
def test_quantiles_equal_numpy(spark, shape):
    rng = np.random.default_rng(5)
    n = 30_000
    x = {
        "spread": rng.normal(0, 1, n),
        "ties": rng.integers(0, 50, n).astype(float),
        "hot": np.where(rng.random(n) < 0.34, 7.0, rng.exponential(3, n)),
        "two": (np.arange(n) % 2).astype(float),
        "near": 1 + rng.integers(0, 9000, n) * 2.0**-52,
        "signs": rng.choice([-0.0, 0.0, -1e-310, 1e-310, -2.5, 2.5], n),
        "far": np.concatenate([rng.normal(0, 1, n - 3), [1e12, -1e15, 1e300]]),
    }[shape]
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(7)
    ps = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    counts = {"x": (n, float(x.min()), float(x.max())), "half": (n // 2, 0.0, float(n // 2 - 1))}
    got = exact_quantiles(df, {"x": F.col("x"), "half": F.when(F.lit(False), 0.0)}, ps, counts | {"half": (0, None, None)})
    assert got["half"] == {}
    for p in ps:
        assert got["x"][p] == pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-12)


def test_counts_of_digits_are_handed_on_when_there_are_many(spark, monkeypatch):
    monkeypatch.setattr(Q, "HELD", 40)
    x = np.random.default_rng(9).normal(0, 1, 5000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(3)
    got = exact_quantiles(df, {"x": F.col("x")}, [0.25, 0.5], {"x": (5000, float(x.min()), float(x.max()))})["x"]
    assert got == pytest.approx({p: np.quantile(x, p) for p in (0.25, 0.5)})


def test_order_of_bits():
    x = np.array([-np.inf, -1e300, -1.5, -5e-324, 0.0, 5e-324, 1.0, np.inf])
    bits = Q.ordered_bits(x)
    assert (np.diff(bits) > 0).all() and [Q.number_of(int(b)) for b in bits] == x.tolist()
    assert Q.ordered_bits(np.array([-0.0]))[0] == Q.ordered_bits(np.array([0.0]))[0]


def test_medians_of_groups_with_one_hot_group(spark):
    rnd = random.Random(4)
    data = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), rnd.choice([None, 1.0, rnd.random()])) for _ in range(4000)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(data, "g string, x double").repartition(6)
    want = {g: float(np.median(v)) for g in {g for g, _ in data} if (v := [x for k, x in data if k == g and x is not None])}
    assert {r["g"]: r["x"] for r in Q.grouped_medians(df, "g", "x").collect()} == pytest.approx(want)


def test_numbers_in_order(spark):
    df = spark.createDataFrame([(i % 5, "k") for i in range(500)], "a int, k string").repartition(4)
    found = numbered(df, [F.desc("a")], "place").collect()
    assert sorted(r["place"] for r in found) == list(range(1, 501))
    assert all(100 * (4 - r["a"]) < r["place"] <= 100 * (5 - r["a"]) for r in found)
    assert numbered(df.limit(0), [F.asc("a")]).collect() == []


def brute_fill(data, keys, backward):
    last, out = {}, {}
    for row in sorted(data, key=lambda r: r[0], reverse=backward):
        key = row[1] if keys else None
        if row[2] is not None:
            last[key] = row[2]
        out[row[0]] = last.get(key) if row[2] is None else row[2]
    return out


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("keys", [None, ["k"]])
def test_fill_over_many_partitions(spark, keys, backward):
    rnd = random.Random(11)
    # One key holds most rows and long gaps run over partition borders; one key has only gaps.
    data = []
    for i in range(3000):
        k = "hot" if rnd.random() < 0.7 else rnd.choice(["a", "b", None, "empty"])
        v = None if k == "empty" or 500 < i < 1900 or rnd.random() < 0.6 else i
        data.append((i, k, v))
    df = spark.createDataFrame(data, "i int, k string, v int").repartition(9)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r["i"]: r["v"] for r in directional_fill(df, ["v"], "i", keys, backward).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute_fill(data, keys, backward)


def test_several_columns_of_any_type_are_filled_with_one_exchange(spark):
    rnd = random.Random(6)
    pick = lambda *values: rnd.choice([None, None, *values])
    data = [
        (i, rnd.choice([1.5, None, float("nan")]), pick("a", ""), pick([1, None], []), pick((1, "x")), pick({"k": 1}), pick(Decimal("1.25")),
         pick(dt.datetime(2024, 1, 2, 3)), pick(dt.date(2024, 1, 2)), pick(True, False)) for i in range(400)]
    schema = "`row.id` int, k double, s string, a array<int>, `t.u` struct<x:int,y:string>, m map<string,int>, d decimal(9,2), ts timestamp, day date, b boolean"
    df = spark.createDataFrame(data, schema).repartition(5)
    columns = df.columns[2:]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        filled = directional_fill(df, columns, "row.id", ["k"])
        found = {r[0]: r for r in filled.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert filled.schema == df.schema and "Exchange" not in filled._jdf.queryExecution().toString()
    last = {}
    for row in data:
        key = repr(row[1])
        known = last.setdefault(key, [None] * 8)
        known[:] = [new if new is not None else old for new, old in zip(row[2:], known)]
        got = found[row[0]]
        assert [tuple(x) if isinstance(x, tuple) else x for x in got[2:]] == known
    assert directional_fill(df.limit(0), columns, "row.id").collect() == []


def test_duplicates_treat_null_nan_and_zero_signs_as_equal(spark):
    data = [(None, 1.0), (None, 1.0), ("a", float("nan")), ("a", None), ("b", 0.0), ("b", -0.0), ("c", 1.0), (None, None)]
    df = spark.createDataFrame(data, "s string, x double")
    got = duplicate_summary(df).first()
    assert (got["duplicate_rows"], got["rows_after"], got["share_pct"]) == (3, 5, 37.5)


def test_shifted_nulls_are_not_duplicates(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    assert duplicate_groups(df, ["x", "y"]).count() == 0


def test_map_columns_can_be_compared(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1) UNION ALL SELECT map('a', 1)")
    assert duplicate_summary(df).first()["duplicate_rows"] == 1


def test_keep_first_by_order(spark):
    df = spark.createDataFrame([(3, "a", 1), (1, "a", 2), (2, "b", 3)], "i int, k string, v int")
    assert sorted(rows(drop_duplicates(df, ["k"], order_by="i"))) == [(1, "a", 2), (2, "b", 3)]


def test_top_per_group_limits_before_the_shuffle(spark):
    counts = value_counts(spark.range(1000).selectExpr("cast(id % 300 AS string) AS s"), {"s": F.col("s")})
    ranked = top_per_group(counts, ["column"], [F.desc("n"), F.asc("value")], 3)
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().toString()
    assert [r["value"] for r in ranked.orderBy("rank").collect()] == ["0", "1", "10"]


def test_scratch_tables_can_be_cleared(spark):
    kept = written(spark.range(5), "numbers")
    path = kept.inputFiles()[0]
    assert kept.count() == 5 and any("/numbers-" in p for p in clear_scratch(spark))
    assert clear_scratch(spark) == []
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_settled_facts_parse_text_once(spark):
    df = spark.createDataFrame([(f"{i}.5", f"2024-01-{i % 28 + 1:02}", i, "x") for i in range(100)], "n string, d string, i int, t string")
    facts = Facts.settled(df)
    assert "rlike" not in facts.df._jdf.queryExecution().toString().lower() and facts.table.columns == df.columns
    assert facts.summary == Facts(df).summary
    plain = Facts.settled(df.select("i"))
    assert plain.df.columns == ["i"] and Facts.settled(plain) is plain
