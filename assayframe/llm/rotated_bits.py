"""Approximate nearest neighbours from randomly rotated one-bit codes.

Every vector is centred on the mean of all vectors, turned by one random rotation and stored as the signs of its
coordinates, packed into 64-bit words, with two correction scalars: its distance from the centre and the inner
product of its unit vector with its own code. A query is turned likewise and rounded to ``QUERY_BITS`` bits, so that
its inner product with a code is a sum of popcounts; divided by the code's scalar it estimates the inner product of
the unit vectors without bias, with an error bound that shrinks with the dimension. Candidates are reranked by their
exact distance in the order of the estimate, those only whose lower bound can still reach the k-th best distance.

Every row is coded and compared with every query; nothing is fitted on a sample. The centre is the mean of all rows.

Defined results: rows whose id is null, or whose vector is null, empty, zero or holds null or non-finite components take
no part; the query's own id never matches it; ties go to the smaller id; a repeated row counts as often as it occurs;
with fewer than ``k`` candidates all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, functions as F

from assayframe.llm.vector_blocks import nearest, unpacked, usable

QUERY_BITS = 6
#: Half-widths of the error bound in standard deviations of the estimate.
BOUND = 4.0


def search(df: DataFrame, id_col: str, vector: str, k: int, query_every: int, seed: int = 42) -> DataFrame:
    """The ``k`` nearest found by Euclidean distance for every row whose id is divisible by ``query_every``."""
    vectors = usable(df, id_col, vector).where(F.exists("vector", lambda x: x != 0))
    centres = {
        size: np.array(mean)
        for size, mean in vectors.select(F.size("vector").alias("size"), F.posexplode("vector"))
        .groupBy("size", "pos").agg(F.avg(F.col("col").cast("double")).alias("mean"))
        .groupBy("size").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"])).collect()
    }
    queries = vectors.where(F.col("id") % query_every == 0)
    wide = vectors.withColumn("vector", F.col("vector").cast("array<double>"))
    asked = queries.withColumn("vector", F.col("vector").cast("array<double>"))
    return nearest(wide, asked, lambda row: block_nearest(row, k, centres[row["dim"]], seed), k, "double", smallest=True, dtype="float64")


@functools.cache
def rotation(dim: int, seed: int) -> np.ndarray:
    turned, upper = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return turned * np.sign(np.diag(upper))


def packed_bits(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    width = -(-signs.shape[1] // 64) * 64
    full = np.zeros((len(signs), width), bool)
    full[:, : signs.shape[1]] = signs
    return np.packbits(full, axis=1).view(np.uint64)


def block_nearest(row: dict, k: int, centre: np.ndarray, seed: int) -> tuple[list, list, list]:
    ids, data = unpacked(row, "ids", "data", "float64")
    query_ids, queries = unpacked(row, "query_ids", "query_data", "float64")
    dim = row["dim"]
    turn = rotation(dim, seed)
    turned = (data - centre) @ turn
    radius = np.linalg.norm(turned, axis=1)
    unit = turned / np.where(radius > 0, radius, 1)[:, None]
    signs = turned >= 0
    codes, ones = packed_bits(signs), signs.sum(axis=1)
    own = np.abs(unit).sum(axis=1) / np.sqrt(dim)  # inner product of the unit vector with its code
    own = np.where(own > 0, own, 1.0)
    width = np.sqrt(np.maximum(0, 1 - own**2)) / own / np.sqrt(max(dim - 1, 1)) * BOUND
    asked = (queries - centre) @ turn
    out_query, out_id, out_score = [], [], []
    for query_id, query, original in zip(query_ids.tolist(), asked, queries):
        reach = np.linalg.norm(query)
        low, high = query.min(), query.max()
        step = (high - low) / (2**QUERY_BITS - 1) or 1.0
        levels = np.rint((query - low) / step).astype(np.int64)
        total = np.zeros(len(ids), np.int64)
        for bit in range(QUERY_BITS):
            plane = packed_bits(((levels >> bit) & 1).astype(bool)[None, :])
            total += np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64) << bit
        # sum of signed coordinates: twice the sum under set bits less the sum of all
        signed = 2 * (step * total + low * ones) - (step * levels.sum() + low * dim)
        estimate = signed / np.sqrt(dim) / own
        rounding = step * np.sqrt(dim) / 2 / own / np.sqrt(dim) * BOUND
        squared = radius**2 + reach**2 - 2 * radius * estimate
        below = squared - 2 * radius * (reach * width + rounding)
        below[ids == query_id] = np.inf
        squared[ids == query_id] = np.inf
        n = int(np.count_nonzero(ids != query_id))
        first = np.argpartition(squared, min(k, n) - 1)[: min(k, n)] if n else np.empty(0, int)
        limit = np.max(_squared(data[first], original), initial=-1.0)
        near = np.flatnonzero(below <= limit * (1 + 1e-9)) if n > k else first
        if n > k:
            near = np.union1d(near, first)
        distance = exact_distance(data[near], original)
        best = np.lexsort((ids[near], distance))[:k]
        out_query += [query_id] * len(best)
        out_id += ids[near[best]].tolist()
        out_score += distance[best].tolist()
    return out_query, out_id, out_score


def _squared(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    gap = rows - query
    return np.einsum("ij,ij->i", gap, gap)


def exact_distance(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distance, the squares summed from the first dimension to the last."""
    return np.sqrt(np.cumsum((rows - query) ** 2, axis=1)[:, -1]) if len(rows) else np.empty(0)
