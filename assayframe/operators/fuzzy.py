"""Merging near-duplicate labels.

Labels are taken in order of (length, text); each joins the first earlier representative it resembles, or becomes a
representative itself. The work is on distinct labels, so hot labels cost nothing extra, and gives what taking them one by
one would give, in rounds of joins:

1. The first open labels of each column make a block, whose similar pairs are found once.
2. Over these pairs the rule is applied in parallel: labels that no earlier open label resembles are representatives, labels
   that resemble one of them are covered, and the pairs of covered labels go. This ends after as many steps as the longest
   chain of labels that wait for one another.
3. The other open labels are compared with the block's representatives only, where they are; those that match leave.

A block grows fourfold. Up to ``DIRECT`` labels are broadcast and all compared with each other in arrays, without keys, and a
bit is kept for each pair; so are the others with up to ``BROADCAST_LABELS`` representatives. Larger blocks go by keys, as long
as these promise at most ``PAIRS`` pairs, which are counted before any is made. So labels that resemble few others and have few
pieces in common are done in a few rounds however many there are, and a crowd of similar labels is never paired off with itself:
a small block of it yields representatives for the rest.

Keys are segments (Li, Deng, Wang and Feng, PVLDB 2011): if at most k characters are inserted or deleted, one of k + 1 segments
of the shorter label is left intact and appears in the longer one at nearly the same place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from assayframe.functions.similarity import lcs_ratio, similar_function
from assayframe.plans.durable import durable
from assayframe.plans.frequency import top_per_group
from assayframe.plans.wide import union_all

# Fixed value: default similarity from which labels are merged.
THRESHOLD = 88

# Labels of one column in the first block, and candidate pairs of a block that goes by keys.
BLOCK = 1000
PAIRS = 4_000_000

# Labels of one column in a block that is compared without keys, at most.
DIRECT = 1 << 14

# Representatives of one column that are broadcast, at most, and bytes of broadcast labels.
BROADCAST_LABELS = 1 << 14
BROADCAST_BYTES = 32_000_000

# Labels that are compared at a time.
ROWS = 4096

# Open labels of a task, about, if there are enough for all cores, and at most.
LEAST_OPEN, MOST_OPEN = 4096, 65536

KEY = ["column", "len_a", "seg", "piece"]

MAP_SCHEMA = "column string, label string, canonical string"


def _max_partner_length(length: Column, t: int) -> Column:
    """Longest label that can still reach the threshold with one of ``length``."""
    return F.floor(length * (200 - t) / t).cast("int")


def _edits(first: Column, second: Column, t: int) -> Column:
    """Inserted plus deleted characters allowed between two lengths."""
    return F.floor((first + second) * (100 - t) / 100).cast("int")


def _segments(length: Column, t: int) -> Column:
    return _edits(length, _max_partner_length(length, t), t) + 1


def _segment_start(length: Column, count: Column, i: Column) -> Column:
    """Zero-based start of segment ``i`` when ``length`` is cut into ``count`` even parts."""
    return F.floor(length * i / count).cast("int")


def _splittable(length: Column, t: int) -> Column:
    return _segments(length, t) <= length


def _index_keys(labels: DataFrame, t: int) -> DataFrame:
    """Keys of each label in the role of the shorter, earlier one."""
    length = F.length("label")
    count = _segments(length, t)

    def segment(i: Column) -> Column:
        start = _segment_start(length, count, i)
        end = _segment_start(length, count, i + 1)
        return F.struct(length.alias("len_a"), i.alias("seg"), F.substring(F.col("label"), start + 1, end - start).alias("piece"))

    # Labels too short to cut: one of the first few characters must be matched.
    need = F.ceil(length * t / 100).cast("int")

    def lead(i: Column) -> Column:
        return F.struct(length.alias("len_a"), F.lit(-1).alias("seg"), F.substring(F.col("label"), i + 1, F.lit(1)).alias("piece"))

    cut = F.transform(F.sequence(F.lit(0), count - 1), segment)
    leads = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(length - need, F.lit(0))), lead))
    keys = F.when(_splittable(length, t), cut).otherwise(leads)
    return labels.where(length > 0).select("column", F.col("label").alias("earlier"), F.inline(keys))


def _probe_keys(labels: DataFrame, t: int) -> DataFrame:
    """Keys of each label in the role of the longer, later one, for every shorter length."""
    length = F.length("label")
    shortest = F.ceil(length * t / (200 - t)).cast("int")
    sized = labels.where(length > 0).withColumn("len_b", length).withColumn(
        "len_a", F.explode(F.sequence(F.greatest(shortest, F.lit(1)), length))
    )
    a, b = F.col("len_a"), F.col("len_b")
    count = _segments(a, t)
    sized = sized.withColumns({
        "count": count,
        "deleted": F.floor((_edits(a, b, t) - (b - a)) / 2).cast("int"),
        "inserted": F.floor((_edits(a, b, t) + (b - a)) / 2).cast("int"),
    })

    def pieces(i: Column) -> Column:
        start = _segment_start(a, F.col("count"), i)
        width = _segment_start(a, F.col("count"), i + 1) - start
        first = F.greatest(F.lit(0), start - F.col("deleted"))
        last = F.least(b - width, start + F.col("inserted"))
        places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda at: F.struct(i.alias("seg"), F.substring(F.col("label"), at + 1, width).alias("piece")))

    cut = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.col("count") - 1), pieces)))
    slack = F.greatest(b - F.ceil((a + b) * t / 200).cast("int"), F.lit(0))
    leads = F.array_distinct(
        F.transform(F.sequence(F.lit(0), slack), lambda i: F.struct(F.lit(-1).alias("seg"), F.substring(F.col("label"), i + 1, F.lit(1)).alias("piece")))
    )
    keys = F.when(_splittable(a, t), cut).otherwise(leads)
    return sized.where("deleted >= 0").select("column", F.col("label").alias("later"), "len_a", F.inline(keys))


def _order(label: str) -> Column:
    return F.struct(F.length(label), F.col(label))


def _candidate_count(labels: DataFrame, threshold: int) -> int:
    """How many pairs the keys of the labels make; nothing is paired for it."""
    labels = labels.repartition(labels.sparkSession.sparkContext.defaultParallelism)
    index = _index_keys(labels, threshold).groupBy(*KEY).agg(F.count("*").alias("a"))
    probe = _probe_keys(labels, threshold).groupBy(*KEY).agg(F.count("*").alias("b"))
    return index.join(probe, KEY).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()[0]


def _similar_pairs(labels: DataFrame, threshold: int) -> DataFrame:
    """``(column, earlier, later)`` of all pairs of a block that reach the threshold."""
    pairs = _probe_keys(labels, threshold).join(_index_keys(labels, threshold), KEY).where(_order("earlier") < _order("later"))
    return pairs.select("column", "earlier", "later").distinct().where(lcs_ratio(F.col("earlier"), F.col("later")) >= threshold)


def _few(labels: DataFrame, most: int) -> bool:
    """Whether all tasks may hold the labels, of which no column has more than ``most``."""
    counted = labels.groupBy("column").agg(F.count("*").alias("n"), F.sum(F.octet_length("label")).alias("size"))
    n, size = counted.agg(F.max("n"), F.sum("size")).first()
    return (n or 0) <= most and (size or 0) <= BROADCAST_BYTES


def _by_column(table: pa.Table) -> dict[str, list[str]]:
    """The labels of each column in their order."""
    found: dict[str, list[str]] = {}
    for column, label in zip(table["column"].to_pylist(), table["label"].to_pylist()):
        found.setdefault(column, []).append(label)
    return {column: sorted(labels, key=lambda x: (len(x), x)) for column, labels in found.items()}


def _settle_block(labels: DataFrame, threshold: int) -> DataFrame:
    """``(column, label, canonical)`` of a block; a representative is its own."""
    return _settle_direct(labels, threshold) if _few(labels, DIRECT) else _settle_by_keys(labels, threshold)


def _settle_direct(labels: DataFrame, threshold: int) -> DataFrame:
    """A block whose labels are all compared with each other, each by one task, and a bit kept for each pair."""
    spark = labels.sparkSession
    block = _by_column(labels.toArrow())
    shared, similar, chosen_of = spark.sparkContext.broadcast(block), similar_function(), chosen_function()
    names = ["column", "label", "canonical"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for column in set(columns):
                every = shared.value[column]
                place_of = {label: i for i, label in enumerate(every)}
                place = np.array(sorted(place_of[label] for c, label in zip(columns, own) if c == column))
                found = similar([every[i] for i in place], every[: place[-1]], threshold)
                found &= np.arange(place[-1]) < place[:, None]
                bits = np.packbits(np.pad(found, ((0, 0), (0, len(every) - place[-1]))), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([column] * len(place), pa.string()), pa.array(place, pa.int32()), pa.array([row.tobytes() for row in bits], pa.binary())],
                    names=["column", "place", "earlier"])

    def settle(rows: pa.Table) -> pa.Table:
        column = rows["column"][0].as_py()
        every = shared.value[column]
        place = rows["place"].to_numpy()
        bits = np.frombuffer(b"".join(rows["earlier"].to_pylist()), np.uint8).reshape(len(place), -1)[np.argsort(place)]
        canonical = np.arange(len(every))
        chosen = np.packbits(chosen_of(bits))
        covered = np.flatnonzero((bits & chosen).any(axis=1))
        for at in range(0, len(covered), 1024):
            some = covered[at : at + 1024]
            canonical[some] = np.unpackbits(bits[some] & chosen, axis=1).argmax(axis=1)
        return pa.table([pa.array(x, pa.string()) for x in ([column] * len(every), every, [every[i] for i in canonical])], names=names)

    tasks = min(spark.sparkContext.defaultParallelism, 1 + max(map(len, block.values()), default=0) // 512)
    compared = labels.select("column", "label").repartition(tasks).mapInArrow(compare, "column string, place int, earlier binary")
    return compared.groupBy("column").applyInArrow(settle, MAP_SCHEMA)


def chosen_function() -> Callable[[np.ndarray], np.ndarray]:
    """A plain function that applies the rule to the bits of a block, one row for each label, and travels to the workers by value."""

    def chosen(bits: np.ndarray) -> np.ndarray:
        """Which labels are representatives; a label's bits tell the earlier ones that it resembles."""
        n = len(bits)
        free, found = np.ones(n, bool), np.zeros(n, bool)
        rows = np.arange(n)
        while np.bitwise_count(bits).sum() > PAIRS:
            waiting = bits.any(axis=1)
            first = rows[~waiting]
            found[first], free[first] = True, False
            covered = (bits & np.packbits(found)).any(axis=1)
            free[rows[covered]] = False
            stay = waiting & ~covered
            rows, bits = rows[stay], bits[stay] & np.packbits(free)
        row, a = np.nonzero(np.unpackbits(bits, axis=1, count=n))
        b = rows[row]
        while len(a):
            waiting = np.zeros(n, bool)
            waiting[b] = True
            first = ~waiting[a]
            free[b[first]] = False
            live = free[a] & free[b] & ~first
            a, b = a[live], b[live]
        found[free] = True
        return found

    return chosen


def _settle_by_keys(labels: DataFrame, threshold: int) -> DataFrame:
    """A block whose labels are compared where they share a key."""
    pairs = durable(_similar_pairs(labels, threshold))
    covered, live = [], pairs
    while not live.isEmpty():
        waiting = live.select("column", F.col("later").alias("earlier")).distinct()
        first = live.join(waiting, ["column", "earlier"], "left_anti")
        now = durable(first.select("column", F.col("later").alias("label")).distinct())
        covered.append(now)
        free = live.join(now.withColumnRenamed("label", "later"), ["column", "later"], "left_anti")
        free = free.join(now.withColumnRenamed("label", "earlier"), ["column", "earlier"], "left_anti")
        live = durable(free.join(first.select("column", "earlier").distinct(), ["column", "earlier"], "left_anti"))
    if not covered:
        return labels.select("column", "label", F.col("label").alias("canonical"))
    gone = union_all(covered)
    chosen = labels.select("column", "label").join(gone, ["column", "label"], "left_anti")
    joined = pairs.join(chosen.withColumnRenamed("label", "earlier"), ["column", "earlier"]).groupBy("column", F.col("later").alias("label")).agg(
        F.min_by("earlier", _order("earlier")).alias("canonical"))
    return chosen.withColumn("canonical", F.col("label")).unionByName(joined)


def _nearest(settled: DataFrame, labels: DataFrame, threshold: int) -> DataFrame:
    """``(column, label, canonical)`` of the labels outside the settled block, with the first representative each resembles or null."""
    few = _few(settled, DIRECT)
    block = settled.select("column", "label")
    rest = labels.select("column", "label").join(F.broadcast(block) if few else block, ["column", "label"], "left_anti")
    representatives = settled.where("label = canonical").select("column", "label")
    if few or _few(representatives, BROADCAST_LABELS):
        return _nearest_direct(representatives, rest, threshold)
    rest = durable(rest)
    return rest.join(_nearest_by_keys(representatives, rest, threshold), ["column", "label"], "left")


def _nearest_direct(representatives: DataFrame, labels: DataFrame, threshold: int) -> DataFrame:
    """All labels compared with all representatives of their column, which every task holds."""
    shared = labels.sparkSession.sparkContext.broadcast(_by_column(representatives.toArrow()))
    similar = similar_function()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, own = np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist()
            canonical: list[str | None] = [None] * len(own)
            for column in np.unique(columns).tolist():
                others = shared.value.get(column, [])
                places = np.flatnonzero(columns == column).tolist()
                for at in range(0, len(places) if others else 0, ROWS):
                    some = places[at : at + ROWS]
                    found = similar([own[i] for i in some], others, threshold)
                    first = found.argmax(axis=1)
                    for row in np.flatnonzero(found[np.arange(len(some)), first]).tolist():
                        canonical[some[row]] = others[first[row]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(canonical, pa.string())], names=["column", "label", "canonical"])

    return labels.mapInArrow(run, MAP_SCHEMA)


def _nearest_by_keys(representatives: DataFrame, labels: DataFrame, threshold: int) -> DataFrame:
    """The labels that resemble a representative, with the first one, through shared keys."""
    candidates = _probe_keys(labels, threshold).join(_index_keys(representatives, threshold), KEY).select("column", "later", "earlier").distinct()
    return (
        candidates.where(lcs_ratio(F.col("earlier"), F.col("later")) >= threshold)
        .groupBy("column", F.col("later").alias("label"))
        .agg(F.min_by("earlier", _order("earlier")).alias("canonical"))
    )


def _spread(labels: DataFrame) -> DataFrame:
    """The labels dealt out to all cores, in their order in each task, if there are many."""
    n, cores = labels.count(), labels.sparkSession.sparkContext.defaultParallelism
    if n <= LEAST_OPEN:
        return labels
    dealt = labels.repartition(max(min(cores, n // LEAST_OPEN), n // MOST_OPEN), "column", "label")
    return durable(dealt.sortWithinPartitions("column", F.length("label"), "label"))


def label_map(labels: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``(column, label, canonical)`` for every label that joins another one.

    ``labels`` holds distinct ``(column, label)`` rows. Each round settles a block of every column, so the loop ends.
    """
    open_labels = _spread(durable(labels))
    found, size = [], block
    wait, pause = 0, 2  # rounds before a larger block is tried again, and after the next one that is too large
    order = [F.length("label").asc(), F.asc("label")]
    while True:
        head = durable(top_per_group(open_labels, ["column"], order, size, rank="_place").drop("_place"))
        if size > block and not _few(head, DIRECT) and _candidate_count(head, threshold) > PAIRS:
            size, wait, pause = max(block, size // 4), pause, 2 * pause
            continue
        settled = durable(_settle_block(head, threshold))
        found.append(settled.where("label <> canonical"))
        joined = durable(_nearest(settled, open_labels, threshold))
        found.append(joined.where("canonical IS NOT NULL"))
        open_labels = joined.where("canonical IS NULL").select("column", "label")
        if open_labels.isEmpty():
            return union_all(found)
        wait, size = max(0, wait - 1), size if wait else size * 4
