import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayframe.operators import stored


def numbers(spark, n=6000):
    rnd = random.Random(12)
    data = [(i, rnd.choice(["a", "b"]), rnd.choice([None, float("nan"), rnd.gauss(5, 2)]), f"v{rnd.randrange(900)}", None) for i in range(n)]
    return spark.createDataFrame(data, "i int, day string, x double, s string, e double").repartition(5)


def test_merged_facts_equal_those_of_the_whole(spark, tmp_path):
    df = numbers(spark)
    old, new = df.where("i < 4000"), df.where("i >= 4000")
    stored.column_facts(old, by="day").write.parquet(str(tmp_path / "facts"))
    stored.column_facts(new, by="day").write.mode("append").parquet(str(tmp_path / "facts"))
    kept = spark.read.parquet(str(tmp_path / "facts"))
    merged = {r["column"]: r for r in stored.facts_profile(stored.merge_facts(kept)).collect()}
    whole = {r["column"]: r for r in stored.facts_profile(stored.column_facts(df.drop("day"))).collect()}
    assert merged.keys() == whole.keys() == {"i", "x", "s", "e"}
    for c in whole:
        for field in ("rows", "count", "missing", "min", "max", "unique"):
            assert merged[c][field] == whole[c][field], (c, field)
        assert merged[c]["mean"] == pytest.approx(whole[c]["mean"]) and merged[c]["std"] == pytest.approx(whole[c]["std"])
    x = np.array([r["x"] for r in df.select("x").collect() if r["x"] is not None and r["x"] == r["x"]])
    assert (merged["x"]["count"], merged["x"]["missing"]) == (len(x), 6000 - len(x))
    assert merged["x"]["std"] == pytest.approx(x.std(ddof=1))
    for field, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        assert abs((x <= merged["x"][field]).mean() - p) <= stored.RANK_ERROR
    assert abs(merged["s"]["unique"] - df.select("s").distinct().count()) < 0.04 * 900
    assert merged["s"]["mean"] is None and merged["e"]["count"] == 0 and merged["e"]["q50"] is None
    per_day = stored.merge_facts(kept, ["day"]).where("column = 'x'").orderBy("day").collect()
    assert [r["n"] for r in per_day] == [df.where((F.col("day") == d) & F.col("x").isNotNull() & ~F.isnan("x")).count() for d in ("a", "b")]


def test_empty_tables(spark):
    df = numbers(spark, 10).limit(0)
    found = stored.facts_profile(stored.merge_facts(stored.column_facts(df))).collect()
    assert {(r["rows"], r["count"], r["mean"], r["std"], r["q50"]) for r in found} == {(0, 0, None, None, None)}
    assert stored.column_facts(df, by="day").collect() == []
