"""Exact top-k search by columnar branch and bound.

The vectors of a block lie vertically: one contiguous row per dimension, dimensions in the order of their energy.
For a query the scores of all candidates grow by one block of dimensions at a time. What the dimensions still to
come can add is at most the product of the remaining norms, so after every block the candidates whose upper bound
is below the k-th best lower bound are dropped and the survivors compacted. The survivors' scores are exact integers.

Defined results: rows whose id is null, or whose vector is null, empty or holds null or non-finite components take no
part; a candidate with the query's own id never matches it; ties go to the smaller id; a repeated row counts as often
as it occurs; with fewer than ``k`` candidates all are returned; an empty table gives an empty result. Columns other
than the id and the vector are ignored. Scores beyond 2^53 are summed with Python integers and must fit a long.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from assayframe.llm.vector_blocks import nearest, unpacked, usable

#: Dimensions that are accumulated between two cuts.
STEP = 8


def top_k(df: DataFrame, id_col: str, vector: str, k: int, query_every: int, scale: int = 256) -> DataFrame:
    """Best ``k`` integer inner products of ``floor(scale * x)`` for every row whose id is divisible by ``query_every``."""
    vectors = usable(df, id_col, vector).withColumn("vector", F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("double")))
    queries = vectors.where(F.col("id") % query_every == 0)
    return nearest(vectors, queries, lambda row: block_top_k(row, k), k, "long", smallest=False, dtype="float64")


def block_top_k(row: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, data = unpacked(row, "ids", "data", "float64")
    query_ids, queries = unpacked(row, "query_ids", "query_data", "float64")
    exact = np.abs(data).max(initial=0) * np.abs(queries).max(initial=0) * data.shape[1] < 2**52
    order = np.argsort(-np.einsum("ij,ij->j", data, data), kind="stable")
    columns, queries = np.ascontiguousarray(data.T[order]), np.ascontiguousarray(queries[:, order])
    cuts = [*range(0, len(order), STEP), len(order)]
    rest = np.array([np.sqrt(np.einsum("ij,ij->j", columns[a:], columns[a:])) for a in cuts[1:]])
    out_query, out_id, out_score = [], [], []
    for query_id, query in zip(query_ids.tolist(), queries):
        found, scores = (_bounded if exact else _plain)(columns, rest, cuts, query, ids != query_id, k)
        best = np.lexsort((ids[found], -scores))[:k]
        out_query += [query_id] * len(best)
        out_id += ids[found[best]].tolist()
        out_score += [int(s) for s in scores[best]]
    return out_query, out_id, out_score


def _bounded(columns: np.ndarray, rest: np.ndarray, cuts: list[int], query: np.ndarray, allowed: np.ndarray, k: int):
    alive = np.flatnonzero(allowed)
    scores = np.zeros(len(alive))
    held = columns if len(alive) == columns.shape[1] else columns[:, alive]
    for step, (a, b) in enumerate(zip(cuts, cuts[1:])):
        scores += query[a:b] @ held[a:b]
        slack = rest[step][alive] * np.sqrt(query[b:] @ query[b:]) * (1 + 1e-9) + 1e-3 * (b < len(query))
        if len(alive) > k and b < len(query):
            least = np.partition(scores - slack, len(alive) - k)[len(alive) - k]
            keep = scores + slack >= least
            if np.count_nonzero(keep) < 0.9 * len(alive):  # compacting copies what is left
                alive, scores = alive[keep], scores[keep]
                held = held[:, keep]
    return alive, scores


def _plain(columns: np.ndarray, rest: np.ndarray, cuts: list[int], query: np.ndarray, allowed: np.ndarray, k: int):
    alive = np.flatnonzero(allowed)
    whole = [int(x) for x in query]
    return alive, np.array([sum(q * int(x) for q, x in zip(whole, columns[:, i])) for i in alive], dtype=object)
