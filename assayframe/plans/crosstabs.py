"""Counts of label combinations for many pairs of columns in one scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Combinations of all pairs that a task holds before it hands them on.
HELD = 1 << 20


class _Levels:
    """The labels of a column that a task has met, with their places."""

    def __init__(self) -> None:
        self.places: dict[str, int] = {}
        self.labels: list[str] = []

    def of(self, labels: list[str]) -> np.ndarray:
        for label in labels:
            if label not in self.places:
                self.places[label] = len(self.labels)
                self.labels.append(label)
        return np.array([self.places[label] for label in labels], np.int64)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = map(np.concatenate, zip(*parts))
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, counts, len(keys)).astype(np.int64)


def _combinations(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the combinations of a batch and how often each occurs; -1 is no label."""
    there = (a >= 0) & (b >= 0)
    codes = a[there] * n_b + b[there]
    if n_a * n_b <= 4 * len(a):
        counts = np.bincount(codes, minlength=n_a * n_b)
        codes = np.flatnonzero(counts)
        counts = counts[codes]
    else:
        codes, counts = np.unique(codes, return_counts=True)
    return *np.divmod(codes, max(n_b, 1)), counts


def pair_counts(texts: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """``(pair, a, b, n)`` over the text columns of ``texts``; ``pairs`` has places of columns.

    A task encodes each column by a dictionary of its own, counts every pair on the codes and hands its sums on when it
    ends, or when it holds ``HELD`` of them; Spark adds them up by label. A hot label is one row per task and partner.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = [_Levels() for _ in texts_columns]
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in pairs]
        size, summed = 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            for pair, (x, y) in enumerate(pairs):
                if held[pair]:
                    keys, counts = _summed(held[pair])
                    a, b = keys >> 32, keys & 0xFFFFFFFF
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(keys), pair), pa.int32()), pa.array([levels[x].labels[i] for i in a.tolist()], pa.string()),
                        pa.array([levels[y].labels[i] for i in b.tolist()], pa.string()), pa.array(counts)], names=["pair", "a", "b", "n"])

        for batch in batches:
            encoded = [c.dictionary_encode() for c in batch.columns]
            codes = [e.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for e in encoded]
            places = [known.of(e.dictionary.to_pylist()) for known, e in zip(levels, encoded)]
            for pair, (x, y) in enumerate(pairs):
                a, b, counts = _combinations(codes[x], len(places[x]), codes[y], len(places[y]))
                if len(counts):
                    held[pair].append((places[x][a] << 32 | places[y][b], counts))
                    size += len(counts)
            if size > 2 * summed + HELD // 8:
                held = [[_summed(parts)] if parts else [] for parts in held]
                size = summed = sum(len(parts[0][0]) for parts in held if parts)
                if summed > HELD:
                    yield from out()
                    held, levels = [[] for _ in pairs], [_Levels() for _ in texts_columns]
                    size, summed = 0, 0
        yield from out()

    texts_columns = list(texts.columns)
    return texts.mapInArrow(run, "pair int, a string, b string, n bigint").groupBy("pair", "a", "b").agg(F.sum("n").alias("n"))
