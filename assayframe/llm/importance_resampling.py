"""Importance resampling of documents towards a target distribution by hashed n-grams.

A text in UTF-8 goes through one 256-byte table that lower-cases A-Z and blanks every byte which is neither a letter, a
digit nor above 0x7F; ``bytes.split`` gives the words. A feature is a run of one to ``SIZE`` words joined by one space, its
bucket the CRC-32 of its bytes modulo the number of buckets: the CRC of a run seeds that of the run one word longer, so
every word is hashed once for each length. Counters per task hold the buckets of the corpus and of the target, and Spark
adds them up; both tables have as many rows as there are buckets. A bucket's gain is a thousandfold logarithm of the
smoothed ratio of its shares, a document's weight the sum over its features. Weights plus Gumbel noise from a hash of the
id, the highest first, draw documents without replacement; their ranks come from a sort by range, not from one window.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayframe.llm.common import settled
from assayframe.plans.ordering import numbered

SIZE = 3
#: Bytes of a text whose words are held at a time.
PIECE = 1 << 20
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes) -> Iterator[tuple[list[bytes], int]]:
    """Words in pieces of bounded size; each comes after the last ``SIZE - 1`` words of the one before, whose number is given."""
    plain, at, carried = text.translate(TABLE), 0, []
    while at < len(plain):
        cut = plain.find(b" ", at + PIECE)
        cut = len(plain) if cut < 0 else cut
        words = carried + plain[at:cut].split()
        yield words, len(carried)
        carried, at = words[1 - SIZE :], cut


def features(words: list[bytes], known: int = 0) -> list[int]:
    """CRC-32 of all runs of one to ``SIZE`` words that end after the first ``known`` words."""
    found: list[int] = []
    hashes = list(map(crc32, words))
    longer = [b" " + w for w in words]
    for size in range(1, SIZE + 1):
        if size > 1:
            hashes = list(map(crc32, longer[size - 1 :], hashes))
        found += hashes[max(known - size + 1, 0) :]
    return found


def buckets_of(text: bytes | None, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Number of words and the buckets of all features of each piece of a text."""
    for words, known in words_of(text) if text else ():
        yield len(words) - known, np.array(features(words, known), np.uint32) % np.uint32(buckets)


def bucket_counts(df: DataFrame, text: str, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                for _, found in buckets_of(value, buckets):
                    counts.update(found.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["bucket", "n"])

    counted = df.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "bucket int, n long")
    total = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket at most
        total[row["bucket"]] = row["n"]
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 * ln(smoothed share in the target / smoothed share in the corpus))`` of every bucket."""
    n = len(corpus)
    s, t = float(corpus.sum()) + n, float(target.sum()) + n
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(corpus, target)], np.int64)


def weighted(df: DataFrame, gain: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            rows = np.zeros((3, batch.num_rows), np.int64)
            for i, value in enumerate(batch.column(1).to_pylist()):
                for n, found in buckets_of(value, len(gain)):
                    rows[:, i] += n, len(found), gain[found].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows)], names=["doc_id", "n_words", "n_features", "weight"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42,
) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of every row of ``docs``; ``rank`` is null unless drawn.

    Of the rows with at least ``least_words`` words the ``percent`` hundredths, rounded down, with the highest scores are
    drawn; ties go to the smaller id. Defined results: a null or empty text has no features and the weight 0 and is not
    drawn (if ``least_words`` is over 0); an empty target or corpus has equal shares in all buckets; a null id counts as
    an empty one for the noise and comes last among ties; rows with one id and one score get successive ranks in any order;
    a text of any length is counted whole; other columns are ignored; an empty table gives an empty result.
    """
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform)))
    scored = settled(weighted(docs, gain, doc_id, text).withColumn("score", score.cast("long")), "importance")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    order = [able.desc(), F.desc("score"), F.asc_nulls_last("doc_id")]
    place = F.col("place")
    return numbered(scored, order, "place").withColumn("rank", F.when(place <= drawn, place)).drop("place")
