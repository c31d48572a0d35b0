"""Exact linear-interpolated quantiles by radix selection.

A number's 64 bits, turned so that their order is that of the numbers, are read digit by digit from the top. A pass counts,
for every column and every prefix that a wanted rank has been traced to, how many cells have each next digit, and notes the
smallest and the largest of them. The rank falls into one digit; if all cells with it are equal, or it was the last one, the
value is found, otherwise the prefix grows by the digit. ``DIGITS`` has four digits, so four passes are the most there can be,
and two are usual. A task holds at most ``HELD`` counts, and what is shuffled and ranked is bounded by columns, probabilities
and digits, whatever the number of rows; no value has to be equal to few others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayframe.plans.ordering import numbered
from assayframe.plans.wide import small_frame

#: Bits of each digit.
DIGITS = (16, 20, 14, 14)
#: Counts that a task holds before it hands them on.
HELD = 1 << 20

_COUNTS = "spec int, digit int, n long, low long, high long"


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Integers in the order of the numbers; both zeros are equal, and not-a-number is the largest."""
    bits = (values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def number_of(bits: int) -> float:
    value = np.array([bits], np.int64)
    return float((value ^ ((value >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)[0])


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """Rows ``(spec, digit, n, low, high)``, one for each digit of a spec."""
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(rows[:, :2], axis=0) != 0).any(axis=1)]))
    return np.column_stack([
        rows[starts, :2], np.add.reduceat(rows[:, 2], starts), np.minimum.reduceat(rows[:, 3], starts), np.maximum.reduceat(rows[:, 4], starts)])


def digit_counts(cells: DataFrame, specs: list[tuple[int, int]], depth: int) -> DataFrame:
    """Partial counts of the digits at ``depth``; ``specs`` has ``(column, prefix)`` pairs."""
    above = sum(DIGITS[:depth])
    shift, mask = np.uint64(64 - above - DIGITS[depth]), np.uint64((1 << DIGITS[depth]) - 1)
    by_column: dict[int, list[tuple[int, int]]] = {}
    for number, (column, prefix) in enumerate(specs):
        by_column.setdefault(column, []).append((number, prefix))

    def counted(values: pa.Array, wanted: list[tuple[int, int]]) -> Iterator[np.ndarray]:
        bits = np.sort(ordered_bits(values.drop_null().to_numpy(zero_copy_only=False)))
        keys = bits.view(np.uint64) ^ np.uint64(1 << 63)
        for number, prefix in wanted:
            first, last = 0, len(keys)
            if depth:  # the cells with the prefix stand together
                first = int(np.searchsorted(keys, np.uint64(prefix << 64 - above), side="left"))
                last = int(np.searchsorted(keys, np.uint64((prefix + 1 << 64 - above) - 1), side="right"))
            if first < last:
                digits = (keys[first:last] >> shift & mask).astype(np.int64)
                starts = np.concatenate([[0], np.flatnonzero(np.diff(digits)) + 1])
                ends = np.concatenate([starts[1:], [len(digits)]])
                yield np.column_stack([np.full(len(starts), number), digits[starts], ends - starts, bits[first + starts], bits[first + ends - 1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        held, settled = 0, 0
        for batch in batches:
            for column, wanted in by_column.items():
                for part in counted(batch.column(column), wanted):
                    waiting.append(part)
                    held += len(part)
            if held > 2 * settled + HELD // 8:
                waiting = [_summed(waiting)]
                held = settled = len(waiting[0])
                if held > HELD:
                    yield out(waiting[0])
                    waiting, held, settled = [], 0, 0
        if waiting:
            yield out(_summed(waiting))

    def out(rows: np.ndarray) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(rows[:, i]).cast(k) for i, k in enumerate(kinds)], names=["spec", "digit", "n", "low", "high"])

    return cells.mapInArrow(run, _COUNTS)


def exact_quantiles(df: DataFrame, views: dict[str, Column], probabilities: list[float], counts: dict[str, tuple]) -> dict[str, dict[float, float]]:
    """``{name: {p: value}}`` for each numeric view.

    ``counts`` holds ``(n, min, max)`` of the non-null cells of each view, which the caller has from its summary pass. The
    result has one number per view and probability, so it is bounded by the schema.
    """
    result: dict[str, dict[float, float]] = {name: {} for name in views}
    live = [name for name in views if counts[name][0]]
    if not live:
        return result
    found: dict[tuple[int, int], float] = {}  # by column and rank
    open_ranks: dict[tuple[int, int], dict[int, int]] = {}  # by column and prefix: ranks among all cells and among those with the prefix
    for column, name in enumerate(live):
        n, low, high = counts[name]
        for p in probabilities:
            for rank in {math.floor(p * (n - 1)), min(math.floor(p * (n - 1)) + 1, n - 1)}:
                if rank in (0, n - 1):
                    found[column, rank] = float(low if rank == 0 else high)
                else:
                    open_ranks.setdefault((column, 0), {})[rank] = rank
    cells = df.select(*[views[name].cast("double").alias(f"c{i}") for i, name in enumerate(live)])
    for depth in range(len(DIGITS)):
        specs = list(open_ranks)
        if not specs:
            break
        tally = digit_counts(cells, specs, depth).groupBy("spec", "digit").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        upto = tally.withColumn("upto", F.sum("n").over(Window.partitionBy("spec").orderBy("digit")))  # a digit's range of rows at most
        wanted = small_frame(df.sparkSession, [(i, own, rank) for i, spec in enumerate(specs) for rank, own in open_ranks[spec].items()], "spec int, own bigint, rank bigint")
        hits = upto.join(F.broadcast(wanted), "spec").where((F.col("own") < F.col("upto")) & (F.col("own") >= F.col("upto") - F.col("n")))
        after: dict[tuple[int, int], dict[int, int]] = {}
        for r in hits.collect():  # a row per view and rank
            column, prefix = specs[r["spec"]]
            if r["low"] == r["high"]:
                found[column, r["rank"]] = number_of(r["low"])
            else:
                after.setdefault((column, prefix << DIGITS[depth] | r["digit"]), {})[r["rank"]] = r["own"] - (r["upto"] - r["n"])
        open_ranks = after
    for column, name in enumerate(live):
        for p in probabilities:
            position = p * (counts[name][0] - 1)
            rank = math.floor(position)
            low, high = found[column, rank], found[column, min(rank + 1, counts[name][0] - 1)]
            result[name][p] = low if position == rank or low == high else (rank + 1 - position) * low + (position - rank) * high
    return result


def grouped_medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """``(group, value)``: the exact median of each group, which may be of any size.

    All cells are numbered in one sort by range over group and value; the places of the medians follow from the first place
    and the size of each group, and only the cells at those places are picked.
    """
    placed = numbered(rows.select(group, value).where(F.col(value).isNotNull()), [F.asc(group), F.asc(value)], "_at")
    sizes = placed.groupBy(group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    middle = F.col("_first") + (F.col("_n") - 1) / 2
    places = sizes.select(F.col(group).alias("_group"), F.explode(F.array_distinct(F.array(F.floor(middle), F.ceil(middle)))).alias("_at"))
    return placed.join(places, "_at").groupBy(F.col("_group").alias(group)).agg(F.avg(value).alias(value))
