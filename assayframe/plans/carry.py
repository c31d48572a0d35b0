"""Filling gaps from the previous row over data that is only range-partitioned: a prefix scan in two passes.

A plain window would send a whole key, or without a key the whole table, to one task. Here rows are range-partitioned and
sorted by (key, order) once, so a hot key spans many partitions, and kept as they lie. The first pass reads only the key and
the filled columns and reports, for each partition, its first and last key and the last known cells of the last key. From
these rows, as many as partitions, follows what every partition inherits. The second pass goes through the same partitions
in their order and fills all columns at once, in Arrow, with no further exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayframe.plans.durable import durable


def _starts(keys: pa.Array, before: str | None) -> np.ndarray:
    """Rows with another key than the row before; ``before`` is the key of the row before the batch."""
    shifted = pa.concat_arrays([pa.array([before], keys.type), keys[:-1]])
    return pc.fill_null(pc.not_equal(keys, shifted), True).to_numpy(zero_copy_only=False)


class _Fill:
    """Last known cells of the current key while batches of one partition pass by."""

    def __init__(self, key: str | None = None, cells: list[pa.Array] | None = None):
        self.key, self.cells = key, cells

    def columns(self, keys: pa.Array, columns: list[pa.Array]) -> list[pa.Array]:
        """The columns with gaps filled from earlier rows of the same key."""
        n = len(keys)
        rows = np.arange(1, n + 1)
        begins = np.maximum.accumulate(np.where(_starts(keys, self.key), rows, 0))
        filled = []
        for i, column in enumerate(columns):
            last = np.maximum.accumulate(np.where(column.is_valid().to_numpy(zero_copy_only=False), rows, 0))
            # place 0 holds the cell from before the batch, which counts up to the first row with another key
            last = np.where(last >= begins, last, 0)
            lost = (last == 0) & (begins > 0)
            carried = pa.nulls(1, column.type) if self.cells is None else self.cells[i].cast(column.type)
            filled.append(pa.concat_arrays([carried, column]).take(pa.array(last, mask=lost)))
        self.key, self.cells = keys[-1].as_py(), [c[-1:] for c in filled]
        return filled


def directional_fill(df: DataFrame, columns: list[str], order_by: str, keys: list[str] | None = None, backward: bool = False) -> DataFrame:
    """Replace nulls by the nearest earlier (or later) non-null cell of the same key.

    ``order_by`` must be unique within a key. A null key is a key like any other.
    """
    col = lambda c: F.col(f"`{c}`")
    by = [col(k).asc() for k in keys or []] + [col(order_by).desc() if backward else col(order_by).asc()]
    # keys as text, so that they compare alike in Arrow whatever their types; places instead of names, which may hold dots
    key: Column = F.to_json(F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)]), {"ignoreNullFields": "false"}) if keys else F.lit("")
    names = [f"c{i}" for i in range(len(df.columns))]
    fields = [T.StructField(n, df.schema[c].dataType) for n, c in zip(names, df.columns)]
    wanted = [df.columns.index(c) for c in columns]
    placed = durable(
        df.repartitionByRange(*by).sortWithinPartitions(*by)
        .select(F.spark_partition_id().alias("part"), key.alias("key"), *[col(c).alias(n) for c, n in zip(df.columns, names)]))

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, first = _Fill(), None
        part = None
        for batch in batches:
            if batch.num_rows:
                part = batch.column(0)[:1]
                first = batch.column(1)[:1] if first is None else first
                state.columns(batch.column(1), batch.columns[2:])
        if part is not None:
            yield pa.RecordBatch.from_arrays([part, first, pa.array([state.key], pa.string()), *state.cells], names=["part", "first", "last", *[names[i] for i in wanted]])

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), *[fields[i] for i in wanted]])
    narrow = placed.select("part", "key", *[names[i] for i in wanted])
    found = narrow.mapInArrow(borders, schema).toArrow().sort_by("part").combine_chunks()  # one row per partition
    inherited: dict[int, tuple[str, list[pa.Array]]] = {}
    state = _Fill()
    for i in range(found.num_rows):
        row = found.slice(i, 1)
        first, last = row["first"][0].as_py(), row["last"][0].as_py()
        cells = [row[names[j]].combine_chunks() for j in wanted]
        cells = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cells]
        if state.cells is not None and state.key == first:
            inherited[row["part"][0].as_py()] = (first, state.cells)
            if first == last:
                cells = [c if c[0].is_valid else before for c, before in zip(cells, state.cells)]
        state.key, state.cells = last, cells
    shared = df.sparkSession.sparkContext.broadcast(inherited)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if state is None:
                state = _Fill(*shared.value.get(batch.column(0)[0].as_py(), ()))
            rows = batch.columns[2:]
            for i, column in zip(wanted, state.columns(batch.column(1), [rows[i] for i in wanted])):
                rows[i] = column
            yield pa.RecordBatch.from_arrays(rows, names=names)

    return placed.mapInArrow(fill, T.StructType(fields)).toDF(*df.columns)
