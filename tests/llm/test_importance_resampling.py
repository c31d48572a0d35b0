"""Importance resampling against plain counts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from assayframe.llm import importance_resampling as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_rows(docs, target, percent=5, least=20, buckets=10_000):
    found = [(i, *plain_features(t)) for i, t in docs]
    s = Counter(f % buckets for _, _, fs in found for f in fs)
    t = Counter(f % buckets for text in target for f in plain_features(text)[1] for f in [f])
    ss, tt = sum(s.values()) + buckets, sum(t.values()) + buckets
    rows = []
    for i, words, fs in found:
        weight = sum(math.floor(1000 * math.log((t[f % buckets] + 1) * ss / ((s[f % buckets] + 1) * tt))) for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): n + 1 for n, r in enumerate(able[: len(able) * percent // 100])}
    return [(*r, ranks.get(id(r))) for r in rows]


def texts(n, seed):
    r = random.Random(seed)
    words = ["Alpha", "beta", "été", "ÉTÉ", "x1", "日本", "don't", "a_b", "\x00", "-", "Z"]
    return [r.choice([" ", ", ", "\n"]).join(r.choice(words) for _ in range(r.randrange(0, 60))) for _ in range(n)]


def test_pieces_hold_every_feature_once(monkeypatch):
    for piece in (1, 5, 17, 1 << 20):
        monkeypatch.setattr(I, "PIECE", piece)
        for text in texts(40, 1) + ["", " ", "one", "one two", "a " * 300]:
            found = [f for words, known in I.words_of(text.encode()) for f in I.features(words, known)]
            assert sorted(found) == sorted(plain_features(text)[1])


@pytest.mark.parametrize("buckets, percent, least", [(10_000, 5, 20), (7, 50, 0)])
def test_rows_equal_plain_counts(spark, buckets, percent, least):
    docs = list(enumerate(texts(150, 2))) + [(1000, None), (1001, ""), (None, "alpha beta " * 15), (1002, "Alpha " * 50_000)]
    target = texts(9, 3) + [None, ""]
    df = spark.createDataFrame([(i, t, 5, "k", 1.0) for i, t in docs], "doc_id long, text string, rank int, weight string, place double").repartition(4)
    other = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    found = I.resample(df, other, percent=percent, least_words=least, buckets=buckets)
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(plain_rows(docs, target, percent, least, buckets), key=repr)


def test_repeated_rows_get_successive_ranks(spark):
    df = spark.createDataFrame([(7, "alpha beta " * 12)] * 200 + [(8, "x")] * 5, "doc_id long, text string").repartition(5)
    found = I.resample(df, df.limit(0), percent=10).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 21)) and len(found) == 205
    assert len({r["score"] for r in found if r["doc_id"] == 7}) == 1
    assert I.resample(df.limit(0), df).collect() == []
