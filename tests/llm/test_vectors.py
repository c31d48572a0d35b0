"""Vector searches against brute force, with unusable, equal and repeated vectors."""

import math
import random

import numpy as np
import pytest

from assayframe.llm import exact_topk, rotated_bits, vector_blocks

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank string"


def sample(seed=5, n=300, dim=24):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 1) for _ in range(dim)], 0, 1.0, "x") for i in range(n)]
    rows += [(1000 + i, rows[i][1], 0, 1.0, "x") for i in range(20)]  # equal vectors, ties
    rows += [rows[7], rows[7]]  # repeated rows
    rows += [
        (2000, None, 0, 1.0, "x"), (2050, [1.0, None] + [0.0] * (dim - 2), 0, 1.0, "x"), (2100, [float("nan")] * dim, 0, 1.0, "x"),
        (2150, [float("inf")] + [0.0] * (dim - 1), 0, 1.0, "x"), (2200, [], 0, 1.0, "x"), (2250, [0.0] * dim, 0, 1.0, "x"),
        (None, [1.0] * dim, 0, 1.0, "x"), (2300, [1.0, 2.0], 0, 1.0, "x"), (2301, [2.0, 2.0], 0, 1.0, "x"),
    ]
    return rows


def usable(rows, zero):
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            yield i, np.float32(v).astype(float)


def expected(rows, every, k, score, best, zero):
    held, out = list(usable(rows, zero)), []
    for q, x in held:
        if q % every == 0:
            scored = [(best * score(x, y), c, score(x, y)) for c, y in held if c != q and len(x) == len(y)]
            out += [(q, place + 1, c, s) for place, (_, c, s) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def integers(x, y):
    return int(np.floor(256 * x).astype(int) @ np.floor(256 * y).astype(int))


def distance(x, y):
    return float(np.sqrt(np.cumsum((x - y) ** 2)[-1]))


@pytest.mark.parametrize("step, rows_of_block", [(8, 4096), (3, 50)])
def test_exact_top_k_equals_brute_force(spark, monkeypatch, step, rows_of_block):
    monkeypatch.setattr(exact_topk, "STEP", step)
    monkeypatch.setattr(vector_blocks, "CANDIDATES", rows_of_block)
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = exact_topk.top_k(df, "vec_id", "embedding", 5, 50).collect()
    assert sorted(map(tuple, found)) == expected(rows, 50, 5, integers, -1, zero=True)


def test_scores_beyond_floats_are_exact():
    ids = np.arange(3)
    data = np.array([[3.0e8, 1.0], [3.0e8, 2.0], [3.0e8, 3.0]])
    row = {"ids": ids.tobytes(), "data": data.tobytes(), "query_ids": ids[:1].tobytes(), "query_data": np.array([[3.0e8, 1.0]]).tobytes(), "dim": 2}
    assert exact_topk.block_top_k(row, 2) == ([0, 0], [2, 1], [9 * 10**16 + 3, 9 * 10**16 + 2])


def test_query_blocks_meet_in_a_shuffle_as_by_broadcast(spark, monkeypatch):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    monkeypatch.setattr(vector_blocks, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(vector_blocks, "QUERIES", 20)
    found = exact_topk.top_k(df, "vec_id", "embedding", 5, 5).collect()
    assert sorted(map(tuple, found)) == expected(rows, 5, 5, integers, -1, zero=True)


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert len(exact_topk.top_k(df, "vec_id", "embedding", 5, 50).collect()) == 1
    assert [r["vec_id"] for r in rotated_bits.search(df, "vec_id", "embedding", 10, 100).collect()] == [1]
    for search in (exact_topk.top_k(df.limit(0), "vec_id", "embedding", 5, 50), rotated_bits.search(df.limit(0), "vec_id", "embedding", 10, 100)):
        assert search.collect() == [] and search.columns == ["query_id", "rank", "vec_id", "score"]


def test_one_bit_codes_find_the_nearest(spark):
    rows = sample(n=600, dim=40)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = {tuple(r) for r in rotated_bits.search(df, "vec_id", "embedding", 10, 20).collect()}
    want = set(expected(rows, 20, 10, distance, 1, zero=False))
    assert len(found) == len(want) and len(found & want) / len(want) >= 0.95
    scores = {(q, c): s for q, _, c, s in want}
    assert all(scores[q, c] == s for q, _, c, s in found if (q, c) in scores)


def test_codes_estimate_inner_products():
    r = np.random.default_rng(1)
    data = r.standard_normal((500, 64))
    turn = rotated_bits.rotation(64, 42)
    assert np.allclose(turn @ turn.T, np.eye(64))
    bits = rotated_bits.packed_bits(data >= 0)
    assert bits.shape == (500, 1) and np.bitwise_count(bits).sum() == (data >= 0).sum()
