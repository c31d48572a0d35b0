"""Blocks of vectors, and the meeting of query blocks with all candidate blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from assayframe.llm.common import finite_vector

#: Rows of a candidate block and of a query block at most.
CANDIDATES, QUERIES = 4096, 2048
#: Query blocks of at most so many bytes in all are broadcast, otherwise they meet the candidates in a shuffle.
BROADCAST_BYTES = 32 << 20

_BLOCK = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("dim", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("data", T.BinaryType()),
])


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``(id, vector)`` of the rows that take part: id not null, vector with finite components only."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vector")).where(F.col("id").isNotNull() & finite_vector("vector"))


def blocks(vectors: DataFrame, rows: int, dtype: str = "float32") -> DataFrame:
    """Rows packed, partition by partition and dimension by dimension, into blocks of at most ``rows`` vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            chunks = waiting.pop(dim)
            ids, data = np.concatenate([c[0] for c in chunks]), np.concatenate([c[1] for c in chunks])
            return pa.RecordBatch.from_pydict(
                {"part": [part], "dim": [dim], "ids": [ids.tobytes()], "data": [data.tobytes()]},
                schema=pa.schema([("part", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())]))

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.empty(0, int)
            for dim in np.unique(sizes).tolist():
                rows_of = np.flatnonzero(sizes == dim)
                for first in range(0, len(rows_of), rows):
                    some = rows_of[first : first + rows]
                    held = sum(len(c[0]) for c in waiting.get(dim, []))
                    if held + len(some) > rows:
                        yield out(dim)
                    waiting.setdefault(dim, []).append((ids[some], flat[starts[some][:, None] + np.arange(dim)]))
        for dim in list(waiting):
            yield out(dim)

    return vectors.mapInArrow(pack, _BLOCK)


def unpacked(row: dict, ids: str, data: str, dtype: str = "float32") -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row[ids], np.int64), np.frombuffer(row[data], dtype).reshape(-1, row["dim"])


def nearest(
    candidates: DataFrame, queries: DataFrame, kernel: Callable[[dict], tuple[np.ndarray, np.ndarray, np.ndarray]],
    k: int, score_type: str, smallest: bool, dtype: str = "float32",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the best ``k`` candidates of every query over all blocks.

    ``kernel`` gets one pair of blocks (``ids``, ``data``, ``query_ids``, ``query_data``, ``dim``) and gives the best ``k``
    of that pair for each of its queries, so that the merge handles ``k`` rows for a query and a candidate block.
    Repeated rows take part like others; vectors meet those of their own length only.
    """
    n, widest = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    parts = max(1, -(-n // QUERIES))
    asked = blocks(queries.repartition(parts), QUERIES, dtype).select(
        "part", "dim", F.col("ids").alias("query_ids"), F.col("data").alias("query_data"))
    held = blocks(candidates, CANDIDATES, dtype).drop("part")
    few = n * (8 + np.dtype(dtype).itemsize * widest) <= BROADCAST_BYTES
    if few:
        pairs = held.join(F.broadcast(asked.drop("part")), "dim")
    else:
        pairs = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(asked, ["part", "dim"])
    number = pa.float64() if score_type == "double" else pa.int64()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                query_id, vec_id, score = kernel(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_id, pa.int64()), pa.array(vec_id, pa.int64()), pa.array(score, number)], names=["query_id", "vec_id", "score"])

    found = pairs.select("dim", "ids", "data", "query_ids", "query_data").mapInArrow(search, f"query_id long, vec_id long, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.col("score").asc() if smallest else F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
