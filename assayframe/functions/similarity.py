"""Label similarity: 200 * LCS / (len a + len b), the normalised InDel ratio."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def ratio_function() -> Callable[[str, str], float]:
    """A plain ratio function that travels to the workers by value.

    One big-integer bit vector holds a whole row of the longest-common-
    subsequence programme.
    """

    def ratio(a: str, b: str) -> float:
        if not a and not b:
            return 100.0
        places: dict = {}
        for i, ch in enumerate(a):
            places[ch] = places.get(ch, 0) | (1 << i)
        full = (1 << len(a)) - 1
        row = full
        for ch in b:
            hits = row & places.get(ch, 0)
            row = ((row + hits) | (row - hits)) & full
        return 200.0 * (len(a) - bin(row).count("1")) / (len(a) + len(b))

    return ratio


def lcs_ratio(left: Column, right: Column) -> Column:
    """Similarity of two labels on the 0-100 scale.

    Spark's ``levenshtein`` also counts substitutions and is a different
    measure, so this is an Arrow-batched UDF.
    """
    ratio = ratio_function()

    @F.pandas_udf("double")
    def ratios(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([ratio(a, b) for a, b in zip(first, second)], dtype="float64")

    return ratios(left, right)


# Cells of an array of bit vectors, and of one of characters, which fit into the processor's cache.
CELLS, CHARACTERS = 1 << 17, 1 << 18

# Characters after which labels that can no longer reach the threshold are left, and the share of all pairs that may remain
# by their characters alone for each of them to be compared by itself.
LEAVE, FEW = 4, 0.07


def similar_function(cells: int = CELLS, characters: int = CHARACTERS) -> Callable[[list[str], list[str], float], np.ndarray]:
    """A plain function that compares many labels with many others and travels to the workers by value.

    Labels whose characters, in whatever order, differ too much are told apart first. The others go through the programme of
    ``ratio_function`` on arrays: pair by pair if they are few, else with a bit vector for each pair of an other label and a
    beginning of labels, so that labels in their order share the rows of what they begin with, and a beginning from which no
    label can reach the threshold is not followed.
    """

    def numbers(text: str) -> np.ndarray:
        return np.array([text], f"U{max(len(text), 1)}").view(np.uint32)[: len(text)]

    def marks(labels: list[str]) -> np.ndarray:
        """Two bits for each of 32 groups of characters: at least one, at least two. Labels differ by as many characters as bits, or more."""
        owner = np.repeat(np.arange(len(labels)), [len(x) for x in labels])
        times = np.bincount(owner * 32 + numbers("".join(labels)) % 32, minlength=32 * len(labels)).reshape(-1, 32)
        bits = np.concatenate([times >= 1, times >= 2], axis=1)
        return np.packbits(bits, axis=1).view(np.uint64)[:, 0]

    def near(own: np.ndarray, theirs: np.ndarray, most: np.ndarray) -> np.ndarray | None:
        """The pairs, numbered row by row, whose marks differ by at most so many bits; none at all if they are not few."""
        found, n, step = [], 0, max(1, cells // len(theirs))
        for at in range(0, len(own), step):
            found.append(np.flatnonzero(np.bitwise_count(own[at : at + step, None] ^ theirs) <= most) + at * len(theirs))
            n += len(found[-1])
            if n > FEW * len(own) * len(theirs):
                return None
        return np.concatenate(found)

    def places(others: list[str], alphabet: np.ndarray, words: int) -> np.ndarray:
        """Bit vectors of the places of each character in each other label."""
        size = np.array([len(x) for x in others])
        given = numbers("".join(others))
        at = np.minimum(np.searchsorted(alphabet, given), len(alphabet) - 1)
        place = np.arange(len(given)) - np.repeat(np.cumsum(size) - size, size)
        known = alphabet[at] == given
        bits = np.zeros((len(alphabet), len(others), words), np.uint64)
        cell = (at[known], np.repeat(np.arange(len(others)), size)[known], place[known] >> 6)
        np.bitwise_or.at(bits, cell, np.uint64(1) << (place[known] & 63).astype(np.uint64))
        return bits

    def next_rows(rows: np.ndarray, hits: np.ndarray) -> np.ndarray:
        hits &= rows
        total = rows + hits
        if rows.shape[-1] > 1:  # what a word carries over goes to the next one
            carry = total < rows
            for w in range(1, rows.shape[-1]):
                total[..., w] += carry[..., w - 1]
                carry[..., w] |= carry[..., w - 1] & (total[..., w] == 0)
        rows -= hits
        total |= rows
        return total

    def compared(tree: list[tuple[np.ndarray, np.ndarray]], leaves: np.ndarray, bits: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The labels that may reach the threshold, and their longest common subsequences with all others."""
        words = bits.shape[-1]
        rows, kept = np.full((1, *bits.shape[1:]), ~np.uint64(0)), None

        def common() -> np.ndarray:
            return 64 * words - np.bitwise_count(rows).sum(axis=-1, dtype=np.int64)

        for i, (parent, code) in enumerate(tree):
            here = None
            if kept is not None:
                parent = kept[parent]
                here = parent >= 0
                parent, code = parent[here], code[here]
            rows = next_rows(rows[parent], bits[code])
            left = len(tree) - 1 - i
            follow = (common() + left >= least).any(axis=1) if left and i % LEAVE == LEAVE - 1 else None
            if follow is not None and not follow.all():
                rows = rows[follow]
                if here is None:
                    here = follow
                else:
                    here[here] = follow
            kept = None
            if here is not None:
                kept = np.where(here, np.cumsum(here) - 1, -1)
            if not len(rows):
                break
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros((0, bits.shape[1]), np.int64)
        node = leaves if kept is None else kept[leaves]
        there = np.flatnonzero(node >= 0)
        return there, common()[node[there]]

    def part(labels: list[str], others: list[str], threshold: float, out: np.ndarray) -> None:
        length = len(labels[0])
        size = np.array([len(x) for x in others])
        able = np.flatnonzero(200.0 * np.minimum(size, length) / (size + length) >= threshold)
        if not len(able):
            return
        alphabet, codes = np.unique(np.array(labels, f"U{length}").view(np.uint32), return_inverse=True)
        codes = codes.reshape(len(labels), length)
        sums, words = size[able] + length, (int(size[able].max()) + 63) // 64
        kept = near(marks(labels), marks([others[i] for i in able]), np.clip(np.floor(sums * (1 - threshold / 100) + 1e-6), 0, 64).astype(np.uint8))
        if kept is not None:
            row, column = np.divmod(kept, len(able))
            step = max(1, min(cells, 32 * cells // len(alphabet)) // words)
            for at in range(0, len(row), step):
                mine = row[at : at + step]
                used, theirs = np.unique(column[at : at + step], return_inverse=True)
                bits = places([others[i] for i in able[used]], alphabet, words)
                rows = np.full((len(mine), words), ~np.uint64(0))
                for i in range(length):
                    rows = next_rows(rows, bits[codes[mine, i], theirs])
                common = 64 * words - np.bitwise_count(rows).sum(axis=-1, dtype=np.int64)
                out[mine, able[used][theirs]] = 200.0 * common / sums[used][theirs] >= threshold
            return
        begins = np.ones(codes.shape, bool)
        np.logical_or.accumulate(codes[1:] != codes[:-1], axis=1, out=begins[1:])
        nodes, tree = np.cumsum(begins, axis=0) - 1, []
        for i in range(length):
            first = np.flatnonzero(begins[:, i])
            tree.append((nodes[first, i - 1] if i else np.zeros(len(first), np.int64), codes[first, i]))
        least = np.ceil(threshold * sums / 200 - 1e-6)
        step = max(1, cells // (len(labels) * words))
        for at in range(0, len(able), step):
            some = able[at : at + step]
            there, common = compared(tree, nodes[:, -1], places([others[i] for i in some], alphabet, words), least[at : at + step])
            out[np.ix_(there, some)] = 200.0 * common / sums[at : at + step] >= threshold

    def similar(labels: list[str], others: list[str], threshold: float) -> np.ndarray:
        """Which of the labels, one a row, reach the threshold with which of the others; empty ones resemble none."""
        out = np.zeros((len(labels), len(others)), bool)
        order = sorted(range(len(labels)), key=lambda i: (len(labels[i]), labels[i]))
        labels = [labels[i] for i in order]
        at = 0
        while at < len(order):
            length = len(labels[at])
            end = at + max(1, min(cells, characters // max(length, 1)))
            some = [x for x in labels[at:end] if len(x) == length]
            if length and others:
                part(some, others, threshold, out[at : at + len(some)])
            at += len(some)
        return out if order == list(range(len(order))) else out[np.argsort(order)]

    return similar
