"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text recognises all of its substrings. A document is parsed against
each automaton into phrases: the longest match from here on, then the next one from the character that broke it. The
code length of the parse, phrases times the bits that point into the language's text, is least for the language whose
text shares the longest substrings; it is the cross entropy that Ziv-Merhav parsing estimates. The least one wins.

The automata are dense tables over a small alphabet. A batch of texts is cut into lanes of ``LANE`` symbols, and all
lanes advance together, one numpy step per symbol for all languages; every character of every text is parsed, and a lane
border costs each language one phrase at most.

The classifier is fitted on a bounded sample: per language the ``docs_per_language`` labelled documents with the smallest
hashes of their ids, ``chars_per_document`` characters of each, less if the tables would pass ``TABLE_BYTES``.
"""

from __future__ import annotations

import functools
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

LANE = 512
#: Symbols that are parsed at a time.
CHUNK = 4 << 20
TABLE_BYTES = 256 << 20
#: Letters with a symbol of their own at most; rarer ones share a symbol.
LETTERS = 250
SPACE, OTHER, PAD, FIRST = 0, 1, 2, 3
UNDECIDED = "und"


@functools.cache
def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def symbols_of(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Symbols of lower-cased code points; a run of other characters than letters is one space."""
    found = table[points]
    keep = found != SPACE
    keep[1:] |= found[:-1] != SPACE
    return found[keep]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts the substrings of ``text``; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for symbol in text:
        now = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = now
            at = link[at]
        if at >= 0:
            target = moves[at][symbol]
            if length[at] + 1 == length[target]:
                link[now] = target
            else:
                copy = len(moves)
                moves.append(dict(moves[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and moves[at].get(symbol) == target:
                    moves[at][symbol] = copy
                    at = link[at]
                link[target] = link[now] = copy
        last = now
    return moves


@dataclass
class Model:
    """``steps[state * width + symbol]`` holds the next state times ``width``, shifted by two, and the phrases that end here."""

    languages: list[str]
    symbols: np.ndarray  # by code point
    width: int
    steps: np.ndarray
    roots: np.ndarray  # the root's place in ``steps``, by language
    bits: np.ndarray  # of a phrase, by language


def fitted(samples: dict[str, str]) -> Model:
    """The automata of one text per language; at least one language."""
    counts = Counter(ch for text in samples.values() for ch in text.lower() if ch.isalpha())
    common = sorted(ch for ch, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LETTERS])
    width = FIRST + len(common)
    symbols = np.where(letter_table(), OTHER, SPACE).astype(np.uint8)
    for i, ch in enumerate(common):
        symbols[ord(ch)] = FIRST + i
    languages = sorted(samples)
    longest = max(1000, TABLE_BYTES // (len(languages) * 2 * width * 4))
    tables, roots, bits, states = [], [], [], 0
    for language in languages:
        own = symbols_of(code_points(samples[language]), symbols)[:longest].tolist()
        moves = suffix_automaton(own)
        table = np.empty((len(moves), width), np.int64)
        root = np.full(width, states * width << 2 | 1)  # a symbol that the text lacks is a phrase
        for symbol, target in moves[0].items():
            root[symbol] = (states + target) * width << 2
        table[:] = root + 1  # a match ends, the next begins with the symbol
        table[0] = root
        for state, targets in enumerate(moves):
            for symbol, target in targets.items():
                table[state, symbol] = (states + target) * width << 2
        table[:, PAD] = (states + np.arange(len(moves))) * width << 2
        tables.append(table.ravel())
        roots.append(states * width)
        bits.append(np.log2(len(own) + 2))
        states += len(moves)
    if states * width >= 1 << 29:
        raise ValueError("too many states for the tables; lower docs_per_language")
    return Model(languages, symbols, width, np.concatenate(tables).astype(np.int32), np.array(roots, np.int32), np.array(bits))


def phrases(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Phrases that each language needs (rows) for each symbol sequence (columns)."""
    lanes = [max(1, -(-len(t) // LANE)) for t in texts]
    grid = np.full((sum(lanes), LANE), PAD, np.uint8)
    flat, at = grid.reshape(-1), 0
    for text, n in zip(texts, lanes):
        flat[at : at + len(text)] = text
        at += n * LANE
    columns = np.ascontiguousarray(grid.T)
    state = np.repeat(model.roots[:, None], len(grid), axis=1)
    count = np.zeros_like(state)
    step = np.empty_like(state)
    for column in columns:
        np.add(state, column, out=state, casting="unsafe")
        np.take(model.steps, state, out=step, mode="clip")
        np.right_shift(step, 2, out=state)
        step &= 3
        count += step
    count += state != model.roots[:, None]
    starts = np.cumsum([0, *lanes[:-1]])
    return np.add.reduceat(count, starts, axis=1)


def judged(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and confidence of whole texts, in chunks of bounded size."""
    languages, scores = [UNDECIDED] * len(texts), [0.0] * len(texts)
    waiting: list[tuple[int, np.ndarray]] = []
    held = 0

    def settle() -> None:
        if not waiting:
            return
        length = phrases(model, [w for _, w in waiting]) * model.bits[:, None]
        best = np.argmin(length, axis=0)
        sure = 1 / np.exp2(np.maximum(length.min(axis=0) - length, -1000)).sum(axis=0)
        for (i, _), language, score in zip(waiting, best, sure):
            languages[i], scores[i] = model.languages[language], float(score)
        waiting.clear()

    for i, text in enumerate(texts):
        found = symbols_of(code_points(text), model.symbols) if text else ()
        if len(found) and (found != SPACE).any():
            waiting.append((i, found))
            held += max(LANE, len(found))
            if held >= CHUNK:
                settle()
                held = 0
    settle()
    return languages, scores


# -- on Spark ---------------------------------------------------------------------


def remainder(doc_id: str) -> Column:
    """``crc32(id as text) mod 5``, by which documents are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def learn(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_language: int = 100, chars_per_document: int = 240,
) -> Model | None:
    """Fit on labelled documents that are not held out; None if there are none."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & (remainder(doc_id) != 0))
    order = Window.partitionBy("lang").orderBy("h", "id", "text")
    sample = (
        labelled.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(doc_id).cast("string")).alias("h"), F.col(doc_id).alias("id"),
                        F.substring(text, 1, chars_per_document).alias("text"))
        .withColumn("place", F.row_number().over(order)).where(F.col("place") <= docs_per_language)
    )
    texts: dict[str, list[str]] = {}
    for row in sample.orderBy("lang", "place").collect():
        texts.setdefault(row["lang"], []).append(row["text"])
    return fitted({language: "\n".join(parts) for language, parts in texts.items()}) if texts else None


def predict(df: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``lang_pred`` and ``score`` of the whole text.

    Defined results: ``und`` with score 0 for a null text, one without a letter, or without any labelled text to learn
    from; ties go to the first language by name; columns named ``lang_pred`` or ``score`` are replaced; repeated rows
    and extra columns pass through; an empty table gives an empty table.
    """
    columns = [c for c in (keep or df.columns) if c not in ("lang_pred", "score")]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.names.index("_text")).to_pylist()
            languages, scores = judged(model, texts) if model else ([UNDECIDED] * len(texts), [0.0] * len(texts))
            rest = batch.select(columns)
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=[*columns, "lang_pred", "score"])

    schema = T.StructType([df.schema[c] for c in columns] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return df.select(*columns, df[text].cast("string").alias("_text")).mapInArrow(run, schema)
