"""Poisson mix against plain inversion; no Python in its plan."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from assayframe.llm import common, poisson_mix as M

SCHEMA = "doc_id long, text string, source string, copy string, parts int"


def documents():
    rows = [(i, "x" * (i % 50), f"s{min(i % 7, 3)}", "c", 1) for i in range(400)]
    return rows + [(1000 + i, "tiny", "rare", "c", 1) for i in range(2)] + [(2000, None, None, "c", 1), (2001, "abc", None, "c", 1), (None, "a", "s1", "c", 1), (5, "again", "s1", "c", 1), (5, "again", "s1", "c", 1)]


def uniform(*parts):
    return int(hashlib.md5("|".join(parts).encode()).hexdigest()[:13], 16) / 2**52


def inverted(u, mean):
    k, p = 0, math.exp(-mean)
    total = p
    while total <= u and k < mean + 12 * math.sqrt(mean) + 30:
        k += 1
        p *= mean / k
        total += p
    return k


def expected(rows, weights=None, budget=1.0):
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len(t or "") + 1
    w = {s: float(math.isqrt(n)) for s, n in sizes.items()} if weights is None else {s: max(0.0, weights.get(s) or 0.0) for s in sizes}
    out = []
    for d, t, s, *_ in rows:
        rate = budget * ((w[s] / sum(w.values())) * (sum(sizes.values()) / sizes[s])) if sum(w.values()) else 0
        parts = max(1, math.ceil(rate / M.PART))
        own = "" if d is None else str(d)
        n = sum(inverted(uniform("poisson-42", own, str(j)), rate / parts) for j in range(parts))
        out += [(d, t, s, 1, c, n, hashlib.md5(f"mix-42|{own}|{c}".encode()).hexdigest()) for c in range(1, n + 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("weights, budget", [(None, 1.0), (None, 0.2), ({"s0": 1.0, "rare": 3.0, None: 1.0, "s2": -1.0, "gone": 5.0}, 3.0), ({}, 1.0)])
@pytest.mark.parametrize("rows_of_broadcast", [100_000, 0])
def test_mix_equals_plain_inversion(spark, monkeypatch, weights, budget, rows_of_broadcast):
    monkeypatch.setattr(M, "BROADCAST_ROWS", rows_of_broadcast)
    monkeypatch.setattr(common, "HOT_SHARE", 0.2)
    df = spark.createDataFrame(documents(), SCHEMA).repartition(3)
    given = None if weights is None else spark.createDataFrame([(k, v) for k, v in weights.items()] + [("null weight", None)], "source string, weight double")
    found = M.mix(df, given, budget)
    assert found.columns == ["doc_id", "text", "source", "parts", "copy", "n_copies", "mix_key"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected(documents(), weights, budget)


def test_large_rates_are_sums_of_parts(spark):
    df = spark.createDataFrame([(i, "y" * 999, "big", "c", 1) for i in range(30)] + [(99, "z", "small", "c", 1)], SCHEMA)
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0)], "source string, weight double")
    small = M.source_rates(df, weights=weights).where("_source = '=small'").first()
    assert small["parts"] > 100 and len(small["cdf"]) < 150
    n = M.mix(df, weights).where("source = 'small'").count()
    assert abs(n - small["rate"]) < 6 * math.sqrt(small["rate"])


def test_copies_follow_the_target_weights(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("0123456789").alias("text"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"))
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "source string, weight double")
    n = {r["source"]: r["count"] for r in M.mix(df, weights).groupBy("source").count().collect()}
    assert abs(n["a"] - 2000) < 250 and abs(n["b"] - 2000) < 250


def test_only_frame_functions_run(spark):
    found = M.mix(spark.createDataFrame(documents(), SCHEMA))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    ordered = [r["mix_key"] for r in found.select("mix_key").coalesce(1).collect()]
    assert len(ordered) == found.count()
    assert M.mix(spark.createDataFrame([], SCHEMA)).collect() == []
