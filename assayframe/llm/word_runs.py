"""Periodic runs of words by a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period ``q`` and at least ``max(least, 2 * q)`` words that no
neighbouring word extends. The words of a text are appended one by one to its suffix automaton. The suffix links form a
tree; the states on the way from the newest one to the root hold all suffixes of the words so far, in segments with one
last occurrence each. The tree's preferred paths are these segments: they are kept in splay trees, and an access after
every word cuts and joins them, so that the whole way takes the new end as its last occurrence. A segment that ended at
``j`` and whose longest suffix has ``L`` words says that the ``L`` words up to ``j`` end at ``i`` again; if the distance
``i - j`` is at most ``L`` they hold a square, whose period is the smallest one, because the last occurrence of a square's
second half is its first half. The first square of every run is met in this way; the run goes back to ``i - (i - j) - L + 1``
and forward as long as words at that distance are equal. Appending a word costs amortised logarithmic time whatever the text.

Only stretches that can hold a run are appended. Every run has at least ``least`` words and twice its period, so all of its
words lie in sequences of ``least // 2`` words that occur more than once in the text. Words outside such sequences belong
to no run, and a run never reaches across them; equal hashes of sequences with different words only make stretches longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Words whose sequences are compared at a time; a longer text is compared alone.
CHUNK = 1 << 18
LEAST = 12
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
_ARROW = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

Run = tuple[int, int, int]


class LinkedAutomaton:
    """Suffix automaton of a growing sequence whose suffix links form a link-cut tree; state 0 is none, state 1 the root."""

    def __init__(self) -> None:
        # of a state's moves the first one, and a table of all of them if there are more
        self.symbol, self.target, self.more = [None, None], [0, 0], {}
        self.link, self.length = [0, 0], [0, 0]
        self.left, self.right, self.up = [0, 0], [0, 0], [0, 0]
        #: Where the suffixes of a preferred path ended last; valid at the root of its splay tree.
        self.ended = [-1, -1]
        self.last = 1
        self.size = 0

    def _state(self, length: int, ended: int) -> int:
        self.symbol.append(None)
        self.target.append(0)
        self.link.append(0)
        self.length.append(length)
        self.left.append(0)
        self.right.append(0)
        self.up.append(0)
        self.ended.append(ended)
        return len(self.link) - 1

    def _move(self, state: int, word: int) -> int:
        if self.symbol[state] == word:
            return self.target[state]
        table = self.more.get(state)
        return table.get(word, 0) if table else 0

    def _turn(self, state: int, word: int, target: int) -> None:
        if self.symbol[state] is None or self.symbol[state] == word:
            self.symbol[state], self.target[state] = word, target
        else:
            self.more.setdefault(state, {})[word] = target

    def _splay(self, x: int) -> None:
        """Bring ``x`` to the root of its splay tree."""
        left, right, up = self.left, self.right, self.up
        top = x
        while (p := up[top]) and (left[p] == top or right[p] == top):
            top = p
        self.ended[x] = self.ended[top]
        while (p := up[x]) and (left[p] == x or right[p] == x):
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[p]
        if left[p] == x:
            below = left[p] = right[x]
            right[x] = p
        else:
            below = right[p] = left[x]
            left[x] = p
        if below:
            up[below] = p
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        up[x], up[p] = g, x

    def _clone(self, state: int, length: int) -> int:
        """A copy of ``state`` with shorter suffixes, put between it and its parent on the same preferred path."""
        self._splay(state)
        copy = self._state(length, -1)
        self.symbol[copy], self.target[copy] = self.symbol[state], self.target[state]
        if state in self.more:
            self.more[copy] = dict(self.more[state])
        self.link[copy] = self.link[state]
        self.link[state] = copy
        above = self.left[copy] = self.left[state]
        if above:
            self.up[above] = copy
        self.left[state], self.up[copy] = copy, state
        return copy

    def append(self, word: int) -> list[tuple[int, int]]:
        """Add a word; of every segment on the way to the root the last end before and its longest suffix."""
        link, length = self.link, self.length
        end = self.size
        now = self._state(end + 1, end)
        at = self.last
        while at and not (target := self._move(at, word)):
            self._turn(at, word, now)
            at = link[at]
        if not at:
            parent = 1
        elif length[at] + 1 == length[target]:
            parent = target
        else:
            parent = self._clone(target, length[at] + 1)
            while at and self._move(at, word) == target:
                self._turn(at, word, parent)
                at = link[at]
        link[now] = self.up[now] = parent
        self.last = now
        self.size += 1
        # access: cut what lies below each segment's entry, join the segments to one path
        segments, below, x = [], now, parent
        ended, right, up = self.ended, self.right, self.up
        while x:
            self._splay(x)
            if length[x]:
                segments.append((ended[x], length[x]))
            if right[x]:
                ended[right[x]] = ended[x]
            right[x] = below
            below, x = x, up[x]
        ended[below] = end
        return segments


def runs_of(words: list[int], least: int = LEAST) -> list[Run]:
    """``(start, length, period)`` of all runs, in order."""
    found: list[Run] = []
    reached: dict[int, int] = {}  # by period the end of the last run
    automaton = LinkedAutomaton()
    n = len(words)
    for i, word in enumerate(words):
        for j, longest in automaton.append(word):
            period = i - j
            if period <= longest and reached.get(period, -1) < i:
                start, end = j - longest + 1, i + 1
                while end < n and words[end] == words[end - period]:
                    end += 1
                reached[period] = end - 1
                if end - start >= least:
                    found.append((start, end - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int]]]:
    """For each text the borders of its stretches of repeated sequences, which hold all of its runs."""
    sizes = np.array([len(t) for t in texts], np.int64)
    total, width = int(sizes.sum()), least // 2
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    if total < least:
        return found
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    hashes = np.fromiter((hash(w) for t in texts for w in t), np.int64, total).view(np.uint64)
    n = total - width + 1
    keys = owner[:n].astype(np.uint64)
    for k in range(width):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    whole = np.flatnonzero(owner[:n] == owner[width - 1 :])
    order = whole[np.argsort(keys[whole])]
    same = keys[order[1:]] == keys[order[:-1]]
    repeated = np.concatenate([order[1:][same], order[:-1][same]])
    edges = np.zeros(total + 1, np.int64)
    np.add.at(edges, repeated, 1)
    np.add.at(edges, repeated + width, -1)
    covered = np.cumsum(edges[:-1]) > 0
    starts = np.cumsum(sizes) - sizes
    # a border lies where the cover begins or ends, and between texts
    first = covered & np.concatenate([[True], ~covered[:-1] | (owner[1:] != owner[:-1])])
    final = covered & np.concatenate([~covered[1:] | (owner[1:] != owner[:-1]), [True]])
    for a, b in zip(np.flatnonzero(first).tolist(), (np.flatnonzero(final) + 1).tolist()):
        if b - a >= least:
            text = int(owner[a])
            found[text].append((a - int(starts[text]), b - int(starts[text])))
    return found


def runs_of_texts(texts: list[list[bytes]], least: int = LEAST) -> list[list[Run]]:
    """The runs of every text, by start and period."""
    found = []
    for words, parts in zip(texts, stretches(texts, least)):
        runs: list[Run] = []
        for a, b in parts:
            ids: dict[bytes, int] = {}
            stretch = [ids.setdefault(w, len(ids)) for w in words[a:b]]
            runs += [(start + a, length, period) for start, length, period in runs_of(stretch, least)]
        found.append(runs)
    return found


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run repeats, joined by one space."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return b" ".join([w for w, gone in zip(words, np.cumsum(edges[:-1]).tolist()) if not gone])


def _judged(texts: list[bytes | None], least: int) -> Iterator[tuple[int, list[Run], bytes]]:
    """Number of words, runs and collapsed text of each text, in chunks of bounded size."""
    waiting: list[list[bytes]] = []
    held = 0
    for k, text in enumerate(texts):
        words = text.split() if text else []
        waiting.append(words)
        held += len(words)
        if held >= CHUNK or k == len(texts) - 1:
            for words, runs in zip(waiting, runs_of_texts(waiting, least)):
                yield len(words), runs, collapsed(words, runs)
            waiting, held = [], 0


def periodic_runs(df: DataFrame, text: str | Column = "text", least: int = LEAST, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``n_words``, ``runs`` (array of start, length and period) and ``collapsed``.

    Words lie between white space (space and U+0009 to U+000D). ``collapsed`` holds the words that lie in no run after its
    first period. Defined results: a null or empty text has no words, no runs and an empty ``collapsed``; every row is judged
    by itself, repeated rows are repeated; a text of any length is judged whole, in one task, with memory in proportion to it;
    columns with the names of the new ones are replaced, other columns pass through; an empty table gives an empty table.
    """
    if least < 2:
        raise ValueError("least must be 2 or more")
    new = ("n_words", "runs", "collapsed")
    columns = [c for c in (df.columns if keep is None else keep) if c not in new]
    source = F.col(f"`{text}`") if isinstance(text, str) else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, rest = [], [], []
            for n, found, kept in _judged(batch.column(len(columns)).to_pylist(), least):
                counts.append(n)
                runs.append([{"start": s, "length": m, "period": p} for s, m, p in found])
                rest.append(kept)
            arrays = [pa.array(counts, pa.int64()), pa.array(runs, _ARROW), pa.array(rest, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *arrays], names=[*places, *new])

    # places instead of names on the way through Python, where a name must not hold a dot
    places = [f"_{i}" for i in range(len(columns))]
    schema = T.StructType(
        [T.StructField(p, df.schema[c].dataType) for p, c in zip(places, columns)]
        + [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    rows = df.select(*[F.col(f"`{c}`").alias(p) for p, c in zip(places, columns)], source.cast("binary").alias("text"))
    return rows.mapInArrow(run, schema).toDF(*columns, *new)


# -- the digest of the query ------------------------------------------------------------


def with_periodic_tails(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with every tenth text (by the CRC-32 of its id) turned periodic from some word on, as the query's contract says."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def turned(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, (a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " "))

    split = F.filter(F.split(F.col(text).cast("string"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    # a lambda's variable is computed once, not for each word
    return df.withColumn(text, F.when(h % 10 == 0, F.transform(F.array(split), turned)[0]).otherwise(F.col(text)))


def digest(found: DataFrame, keep: list[str]) -> DataFrame:
    """The longest run of each row, and hashes of all runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = found.withColumn("best", best).withColumn("listed", listed)
    return rows.select(
        *keep, F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
