"""Main text of web pages: blocks by zone, and boilerplate by host suffix arrays.

The token stream of a page is the sequence of its blocks' hashes. The streams of a host's pages are concatenated and
their suffix array sorted; neighbours whose common prefix spans ``LEAST_CHARS`` characters share a long substring. A run
that distinct pages share is boilerplate of the host, and the blocks it covers are removed:

- text of a page that marks no article is removed if more pages have the run than the page has copies (pages of the host
  with the same stream, itself included): what only copies share is their own text, at any length of page and run;
- text inside a marked article stays, since articles quote licences, repeat passages or are copies, and the main text
  has to keep those; furniture by element or role, suspect elements (``page_blocks``), and text beside a marked article, go
  as such. All of them still count as places where a run occurs.

A host with more than ``PAGES`` pages is cut into chunks by the hash of the page, each with a suffix array of its own. Every
chunk reports its runs with the number of its pages, and the sums over the chunks decide, so that the split changes
no result and no task holds more than a chunk. Pages and runs are told apart by 128-bit hashes. Only hashes are shuffled;
pages are parsed again for the text, and joined with the blocks to remove by broadcast where those are few, otherwise in a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from assayframe.llm.common import joined_by_size, lookup, settled
from assayframe.llm.page_blocks import ARTICLE, NEUTRAL, blocks

#: Pages that share one suffix array at most, on average.
PAGES = 512
#: Characters of a run that counts as long.
LEAST_CHARS = 40


# -- suffix arrays ------------------------------------------------------------------


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by doubling the length of the sorted prefixes."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    n, k = len(rank), 1
    while True:
        after = np.full(n, -1)
        after[: n - k] = rank[k:]
        order = np.lexsort((after, rank))
        a, b = order[:-1], order[1:]
        differ = (rank[a] != rank[b]) | (after[a] != after[b])
        rank[order] = np.concatenate([[0], np.cumsum(differ)])
        if rank[order[-1]] == n - 1 or k >= n:
            return order
        k *= 2


def common_prefixes(tokens: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of every suffix with the one before it in ``order``."""
    n = len(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    own, places, before, length, out = tokens.tolist(), place.tolist(), order.tolist(), 0, [0] * n
    for i in range(n):
        if places[i] == 0:
            length = 0
            continue
        j = before[places[i] - 1]
        while i + length < n and j + length < n and own[i + length] == own[j + length]:
            length += 1
        out[places[i]] = length
        if length:
            length -= 1
    return np.array(out)


def needed(chars: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """How many tokens from each place on hold ``LEAST_CHARS`` characters; 0 where the page ends before."""
    total = np.concatenate([[0], np.cumsum(chars)])
    last = np.searchsorted(total, total[:-1] + LEAST_CHARS)
    return np.where(last <= stops, last - np.arange(len(chars)), 0)


def runs(host: str, keys: list[bytes], sizes: np.ndarray, hashes: np.ndarray, chars: np.ndarray, zones: np.ndarray, backwards: bool) -> Iterator[tuple]:
    """``(run, pages, places)`` of the long runs of a chunk, one for each interval of the suffix array.

    A run is the shortest long one that begins at a block, or ``backwards`` the shortest that ends there; a longer shared
    substring is covered by the two kinds together. ``places`` has ``(key, first block, blocks)`` of the occurrences in
    undecided text.
    """
    ends = np.cumsum(sizes)
    page = np.repeat(np.arange(len(sizes)), sizes)
    first = (ends - sizes)[page]
    if backwards:
        turned = first + ends[page] - 1 - np.arange(len(hashes))
        hashes, chars, zones = hashes[turned], chars[turned], zones[turned]
    length = needed(chars, ends[page])
    # a token that no other page has closes every page
    tokens = np.insert(np.unique(hashes, return_inverse=True)[1].astype(np.int64), ends, len(hashes) + np.arange(len(sizes)))
    source = np.insert(np.arange(len(hashes)), ends, -1)
    order = suffix_array(tokens)
    shared = common_prefixes(tokens, order)
    places = source[order]
    want = np.where(places >= 0, length[places], 0)
    begins = (want == 0) | (shared < want)
    begins[1:] |= want[:-1] == 0
    starts = np.flatnonzero(begins)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(places)]):
        if want[a]:
            held, size = places[a:b], int(want[a])
            run = xxhash.xxh3_128_digest(hashes[held[0] : held[0] + size].tobytes() + host.encode(), int(backwards))
            undecided = held[zones[held] == NEUTRAL]
            begin = ends[page[undecided]] - undecided - size if backwards else undecided - first[undecided]
            yield run, len(np.unique(page[held])), list(zip([keys[i] for i in page[undecided].tolist()], begin.tolist(), [size] * len(begin)))


# -- on Spark -------------------------------------------------------------------------

_RUNS = "run binary, pages long, places array<struct<key:binary,first:int,size:int>>"


def keyed(pages: DataFrame) -> DataFrame:
    """``pages`` with ``_key``, two hashes that are equal for equal rows only, and ``_host``."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    key = F.concat(F.hex(F.xxhash64("page_id", "url", "html")), F.lit("-"), F.hex(F.xxhash64(F.lit("second"), "html", "url", "page_id")))
    return pages.withColumn("_key", key.cast("binary")).withColumn("_host", host)


def streams(pages: DataFrame) -> DataFrame:
    """``(host, key, whole, hashes, chars, zones)``: the token stream of every page and the hash of all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(p.as_py()) for p in batch.column(2)]
            hashes = [np.array([xxhash.xxh64_intdigest(t) for t, _ in page], np.uint64).view(np.int64) for page in found]
            whole = [xxhash.xxh3_128_digest(h.tobytes() + (host or "").encode()) for h, host in zip(hashes, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(whole, pa.binary()), pa.array(hashes, pa.list_(pa.int64())),
                pa.array([[len(t) for t, _ in page] for page in found], pa.list_(pa.int32())),
                pa.array([[z for _, z in page] for page in found], pa.list_(pa.int8()))], names=["host", "key", "whole", "hashes", "chars", "zones"])

    return pages.select("_host", "_key", "html").mapInArrow(run, "host string, key binary, whole binary, hashes array<long>, chars array<int>, zones array<byte>")


def chunk_runs(streamed: DataFrame) -> DataFrame:
    """The runs of every chunk (``host``, ``chunk``), chunks gathered one after the other from sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            waiting = rows if waiting is None else pa.concat_tables([waiting, rows])
            names, numbers = waiting["host"].to_pylist(), waiting["chunk"].to_pylist()
            borders = [i for i in range(1, len(names)) if names[i] != names[i - 1] or numbers[i] != numbers[i - 1]]
            for a, b in zip([0, *borders], borders):
                yield from out(waiting.slice(a, b - a))
            waiting = waiting.slice(borders[-1] if borders else 0)
        if waiting is not None:
            yield from out(waiting)

    def out(chunk: pa.Table) -> Iterator[pa.RecordBatch]:
        if not chunk.num_rows:
            return
        keys = chunk["key"].to_pylist()
        first_of = dict(zip(reversed(keys), range(len(keys) - 1, -1, -1)))
        once = sorted(first_of.values())  # equal rows are one page
        keys, chunk = [keys[i] for i in once], chunk.take(once)
        column = lambda name: chunk[name].combine_chunks()
        sizes = column("hashes").value_lengths().to_numpy(zero_copy_only=False)
        if not sizes.sum():
            return
        hashes, chars, zones = (column(n).flatten().to_numpy(zero_copy_only=False) for n in ("hashes", "chars", "zones"))
        split = chunk["chunks"][0].as_py() > 1
        host = chunk["host"][0].as_py()
        rows = [
            {"run": r, "pages": n, "places": [dict(zip(("key", "first", "size"), p)) for p in places]}
            for backwards in (False, True)
            for r, n, places in runs(host, keys, sizes, hashes, chars, zones, backwards)
            if split or (places and n > 1)]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    place = pa.struct([("key", pa.binary()), ("first", pa.int32()), ("size", pa.int32())])
    schema = pa.schema([("run", pa.binary()), ("pages", pa.int64()), ("places", pa.list_(place))])
    sizes = streamed.groupBy("host").agg(F.ceil(F.count("*") / PAGES).cast("int").alias("chunks")).where("chunks > 1")
    dealt = joined_by_size(streamed, sizes, ["host"]).withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("key"), "chunks").cast("int"))
    return dealt.drop("whole").repartition("host", "chunk").sortWithinPartitions("host", "chunk").mapInArrow(run, _RUNS)


def covered(streamed: DataFrame) -> DataFrame:
    """``(key, covered)``: ``(first, size)`` of the stretches of blocks that are boilerplate of the host, by page."""
    found = settled(chunk_runs(streamed), "page-runs")
    totals = settled(found.groupBy("run").agg(F.sum("pages").alias("total"), F.count("*").alias("n")).where("total > 1"), "page-totals")
    places = lookup(found.where(F.size("places") > 0).select("run", "places"), totals, "run", "inner").select("total", F.explode("places").alias("p"))
    by_page = places.select("p.key", "p.first", "p.size", "total")
    # a page's copies are counted only where it has covered text
    copied = streamed.groupBy("whole").agg(F.count_distinct("key").alias("copies"), F.count("*").alias("n")).where("copies > 1")
    copies = lookup(streamed.select("whole", "key"), settled(copied, "page-copies"), "whole", "inner").select("key", "copies").distinct()
    own = joined_by_size(by_page, settled(copies, "page-copies"), ["key"])
    return own.where(F.col("total") > F.coalesce("copies", F.lit(1))).groupBy("key").agg(F.collect_set(F.struct("first", "size")).alias("covered"))


def main_text(page: str | None, stretches: list[dict] | None) -> str:
    """The blocks of the article, or of undecided text, that are not covered, joined by an empty line."""
    found = blocks(page)
    hit = np.zeros(len(found), bool)
    for s in stretches or ():
        hit[s["first"] : s["first"] + s["size"]] = True
    return "\n\n".join(t for i, (t, z) in enumerate(found) if z in (ARTICLE, NEUTRAL) and not hit[i])


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages`` (``page_id``, ``url``, ``html``).

    Defined results: a null or empty html has the empty text; a null url belongs to the host without a name; repeated
    rows count as one page of their host and give repeated rows; a page of any length is parsed whole, in linear time; an
    empty table gives an empty result; other columns are ignored.
    """
    rows = keyed(pages.select("page_id", "url", "html"))
    remove = settled(covered(settled(streams(rows), "page-streams")), "page-covered")
    joined = joined_by_size(rows, remove.withColumnRenamed("key", "_key"), ["_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), stretches.as_py()) for page, stretches in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return joined.select("page_id", "url", "html", "covered").mapInArrow(run, schema)
