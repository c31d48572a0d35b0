"""SimHash near copies by the generalised pigeonhole principle.

A fingerprint has a bit set if more than half of the document's shingle hashes have it. Two fingerprints are linked
if at most ``distance`` bits differ. The links are found without comparing all pairs:

1. Equal fingerprints are merged first, so a group of copies is one row from here on.
2. Bits that go together over all fingerprints are put into the same part (a greedy walk over the correlations of all
   64 bits, summed over every fingerprint).
3. Parts get unequal thresholds ``t`` with ``sum(t + 1) = distance + 1``: whatever ``distance`` differing bits are spread
   over the parts, in one part at most ``t`` differ. A dynamic programme picks the number of parts and the thresholds
   with the least estimated cost of keys and candidates; -1 leaves a part out. A threshold of 1 becomes one key for
   each bit of the part, with that bit masked.
4. Fingerprints that share a key are compared; a key over ``BUCKET`` fingerprints is split by the same principle over the
   bits that it does not fix, until no bucket is larger. Fixed bits grow with every split, so at most
   ``2 ** (bits left)`` fingerprints can share one and the splitting ends. No pair is lost.
5. A bucket reports for every linked fingerprint the smallest one it reaches there, not all pairs. The reports are
   joined to components by alternating stars on Spark.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from assayframe.llm.common import joined_by_size, lookup, settled

#: Fingerprints that are compared with one another in one bucket at most.
BUCKET = 2048
#: Shingles that are hashed at a time.
CHUNK = 1 << 18
#: Estimated cost of one more key of a fingerprint, in compared pairs.
KEY_COST = 50.0


# -- fingerprints -----------------------------------------------------------------


def hashes(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles in chunks; a sequence shorter than ``size`` is one shingle."""
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < size:
        if words:
            yield np.array([digest(join(words), 42)], np.uint64)
        return
    for at in range(0, len(words) - size + 1, CHUNK):
        some = words[at : at + CHUNK + size - 1]
        yield np.fromiter((digest(join(s), 42) for s in zip(*(some[i:] for i in range(size)))), np.uint64)


def majority(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of 64 bit counts."""
    return np.packbits(2 * counts > totals[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def bit_counts(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int32)


def fingerprints_of(texts: list[bytes | None], size: int) -> np.ndarray:
    """One fingerprint per text in UTF-8; zero for a text without words."""
    counts, totals = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    waiting: list[np.ndarray] = []
    owners: list[int] = []

    def settle() -> None:
        if waiting:
            starts = np.cumsum([0, *map(len, waiting[:-1])])
            np.add.at(counts, owners, bit_counts(np.concatenate(waiting), starts))
            np.add.at(totals, owners, [len(w) for w in waiting])
            waiting.clear()
            owners.clear()

    held = 0
    for i, text in enumerate(texts):
        for found in hashes(text.lower().split(), size) if text else ():
            waiting.append(found)
            owners.append(i)
            held += len(found)
            if held >= CHUNK:
                settle()
                held = 0
    settle()
    return majority(counts, totals)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of whole texts: A-Z lower-cased, words between white space, shingles of ``size`` words with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints_of(batch.column(1).to_pylist(), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def hex_digits(fp: str):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# -- parts and thresholds -----------------------------------------------------------


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for all pairs of bits how many have both set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64)), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            both += bits.T @ bits
            n += len(bits)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(4097), pa.int32()), pa.array([*both.ravel().astype(np.int64), n], pa.int64())], names=["cell", "n"])

    sums = {r["cell"]: r["n"] for r in fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    return sums.get(4096, 0), np.array([sums.get(i, 0) for i in range(4096)], float).reshape(64, 64)


def correlated_parts(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """All bits in ``parts`` groups of equal width, each grown from its most correlated pair of bits."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    likeness = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(likeness, -1.0)
    left, groups = list(range(64)), []
    for part in range(parts):
        width = len(left) // (parts - part)
        square = likeness[np.ix_(left, left)]
        a, b = divmod(int(np.argmax(square)), len(left)) if len(left) > 1 else (0, 0)
        group = list(dict.fromkeys([left[a], left[b]]))[:width]
        while len(group) < width:
            rest = [x for x in left if x not in group]
            group.append(rest[int(np.argmax(likeness[np.ix_(rest, group)].sum(axis=1)))])
        groups.append(sorted(group))
        left = [x for x in left if x not in group]
    return groups


def estimated_cost(n: int, share: np.ndarray, part: list[int], threshold: int) -> float:
    """Keys and expected candidate pairs of a part: the chance that two fingerprints differ in at most ``threshold`` of its bits."""
    if threshold < 0:
        return 0.0
    chances = np.zeros(threshold + 1)
    chances[0] = 1.0
    for bit in part:
        differ = 2 * share[bit] * (1 - share[bit])
        chances[1:] = chances[1:] * (1 - differ) + chances[:-1] * differ
        chances[0] *= 1 - differ
    return n * KEY_COST * (len(part) if threshold else 1) + n * n / 2 * chances.sum()


def allocation(n: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """``(bits, threshold)`` of every part: the cheapest of all numbers of parts, thresholds (-1, 0 or 1) by dynamic programme."""
    share = np.diag(both) / max(n, 1)
    best: tuple[float, list] = (np.inf, [])
    for parts in range(-(-(distance + 1) // 2), distance + 2):
        groups = correlated_parts(n, both, parts)
        reached: dict[int, tuple[float, list]] = {0: (0.0, [])}  # by the sum of thresholds plus one
        for group in groups:
            after: dict[int, tuple[float, list]] = {}
            for spent, (cost, chosen) in reached.items():
                for threshold in (-1, 0, 1):
                    total = spent + threshold + 1
                    if total <= distance + 1:
                        now = cost + estimated_cost(n, share, group, threshold)
                        if total not in after or now < after[total][0]:
                            after[total] = (now, [*chosen, (group, threshold)])
            reached = after
        if distance + 1 in reached and reached[distance + 1][0] < best[0]:
            best = reached[distance + 1]
    return [(group, threshold) for group, threshold in best[1] if threshold >= 0]


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def key_masks(parts: list[tuple[list[int], int]]) -> list[int]:
    """The bits that each key fixes."""
    return [m for bits, threshold in parts for m in ([mask_of(bits)] if not threshold else [mask_of([x for x in bits if x != b]) for b in bits])]


def finer_masks(mask: int, distance: int) -> list[int]:
    """Keys of a bucket: it fixes ``mask``; the other bits in ``distance + 1`` parts, of which one must be equal."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | mask_of(free[i :: distance + 1]) for i in range(distance + 1)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


# -- links ------------------------------------------------------------------------


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """``(mask, value, fp)``: every fingerprint under each of the masks."""
    rows = fps.select("fp", F.explode(F.array(*[F.lit(signed(m)).cast("long") for m in masks])).alias("mask"))
    return rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")


def buckets(fps: DataFrame, parts: list[tuple[list[int], int]], distance: int) -> DataFrame:
    """``(mask, value, fp)`` so that linked fingerprints share a bucket and no bucket is over ``BUCKET``."""
    masks = key_masks(parts)
    rows, done = _keyed(fps, masks), None
    while True:
        large = settled(rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).drop("n").withColumn("large", F.lit(True)), "simhash-large")
        found = [r["mask"] for r in large.select("mask").distinct().collect()]  # at most the number of masks
        if not found:
            return rows if done is None else done.unionByName(rows)
        marked = joined_by_size(rows, large, ["mask", "value"])
        small = marked.where("large is null").drop("large")
        done = small if done is None else done.unionByName(small)
        finer = {m: [signed(x) for x in finer_masks(m % (1 << 64), distance)] for m in found}
        choice = F.create_map(*[x for m, subs in finer.items() for x in (F.lit(m).cast("long"), F.array(*[F.lit(s).cast("long") for s in subs]))])
        split = marked.where("large").select("fp", F.explode(choice[F.col("mask")]).alias("mask")).distinct()
        rows = settled(split.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp"), "simhash-split")


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over the links ``a[i] - b[i]``."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if np.array_equal(after, label):
            return label
        label = after


def bucket_links(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by bucket and fingerprint: linked fingerprints with the smallest that they reach in their bucket."""
    left, right = [], []
    step, rows = 1, np.arange(len(fp))
    while True:
        rows = rows[rows + step < len(fp)]
        rows = rows[group[rows] == group[rows + step]]
        if not len(rows):
            break
        near = rows[np.bitwise_count(fp[rows] ^ fp[rows + step]) <= distance]
        left.append(near)
        right.append(near + step)
        step += 1
    if not left:
        return fp[:0], fp[:0]
    root = local_roots(len(fp), np.concatenate(left), np.concatenate(right))
    linked = np.flatnonzero(root != np.arange(len(fp)))
    return fp[linked], fp[root[linked]]


def links(bucketed: DataFrame, distance: int) -> DataFrame:
    """``(a, b)``: fingerprints and a smaller one of the same component, spanning every link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64)] * 3
        for batch in batches:
            kept = [np.concatenate([k, batch.column(i).to_numpy(zero_copy_only=False)]) for i, k in enumerate(kept)]
            border = np.flatnonzero((kept[0][1:] != kept[0][:-1]) | (kept[1][1:] != kept[1][:-1])) + 1
            if len(border):  # the last bucket may go on in the next batch
                yield from out([k[: border[-1]] for k in kept])
                kept = [k[border[-1] :] for k in kept]
        yield from out(kept)

    def out(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        mask, value, fp = rows
        if not len(fp):
            return
        starts = np.concatenate([[0], np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1, [len(fp)]])
        group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        # large buckets one by one, so that the pairs held at a time stay bounded
        large = np.flatnonzero(np.diff(starts) > 128)
        cuts = sorted({0, len(fp), *starts[large].tolist(), *starts[large + 1].tolist()})
        for first, last in zip(cuts, cuts[1:]):
            a, b = bucket_links(group[first:last], fp[first:last].view(np.uint64), distance)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    ordered = bucketed.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
    return ordered.select("mask", "value", "fp").mapInArrow(run, "a long, b long").distinct()


# -- components -------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of all nodes but the roots, for edges ``(a, b)`` in any order: alternating large and small stars.

    Every round writes its edges, so a lost executor costs one round at most; a node with very many edges is looked up
    by broadcast (``lookup``), never gathered.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    now = settled(edges.where("a <> b").select(hi.alias("hi"), lo.alias("lo")).distinct(), "stars")
    seen = _sum_of(now)
    while True:
        # large star: the larger neighbours of every node go to the smallest node around it
        ends = now.select(F.col("hi").alias("lo"), F.col("lo").alias("least")).unionByName(now.select("lo", F.col("lo").alias("least")))
        degree = now.groupBy("lo").agg(F.count("*").alias("n"))
        around = ends.groupBy("lo").agg(F.min("least").alias("least")).join(degree, "lo")
        large = settled(lookup(now, settled(around, "stars"), "lo").select("hi", F.col("least").alias("lo")).distinct(), "stars")
        # small star: a node and its smaller neighbours go to the smallest of them
        below = settled(large.groupBy("hi").agg(F.min("lo").alias("least"), F.count("*").alias("n")), "stars")
        turned = lookup(large, below.where("n > 1"), "hi").where("lo <> least")
        after = settled(
            turned.select(F.col("lo").alias("hi"), F.col("least").alias("lo")).unionByName(below.select("hi", F.col("least").alias("lo"))).distinct(), "stars")
        total = _sum_of(after)
        if total == seen:
            return after.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        now, seen = after, total


def _sum_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


# -- operator ---------------------------------------------------------------------


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, distance: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row of ``docs``.

    ``component_id`` is the smallest id reachable over links, a row's own included. Defined results: a null or empty
    text has the fingerprint zero and is linked like any other; repeated rows are repeated; a null id is never the
    smallest, and a component without ids has a null ``component_id``; an empty table gives an empty result; other
    columns are ignored.
    """
    prints = settled(fingerprints(docs, doc_id, text, size), "simhash")
    fps = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-distinct")
    n, both = bit_statistics(fps)
    if n < 2:
        ids = fps.select("fp", "n", F.col("first").alias("component_id"))
    else:
        found = settled(links(buckets(fps, allocation(n, both, distance), distance), distance), "simhash-links")
        ids = _component_ids(fps, components(found))
    return lookup(prints, settled(ids, "simhash-ids"), "fp").select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")


def _component_ids(fps: DataFrame, roots: DataFrame) -> DataFrame:
    """``(fp, n, component_id)``; a fingerprint without links is a component of its own."""
    nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    members = settled(nodes.join(fps.withColumnRenamed("fp", "node"), "node").select("node", "root", "first"), "simhash-members")
    least = settled(members.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "simhash-least")
    linked = lookup(members, least, "root").select(F.col("node").alias("fp"), "component_id", F.lit(True).alias("is_linked"))
    return fps.join(linked, "fp", "left").select("fp", "n", F.when(F.col("is_linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id"))
