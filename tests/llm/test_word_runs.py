"""Periodic runs against a search of all periods."""

import hashlib
import random
import zlib

import pytest

from assayframe.llm import word_runs as R


def plain_runs(words, least=12):
    """All maximal stretches of every period, without those that lie in one of a smaller period."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            first = i
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - first >= max(q, least - q):
                found.append((first - q, i - first + q, q))
            i += 1
    inside = lambda r: any(o[2] < r[2] and o[0] <= r[0] and o[0] + o[1] >= r[0] + r[1] for o in found)
    return sorted((r for r in found if not inside(r)), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]


def sequences(n, seed=3):
    r = random.Random(seed)
    for _ in range(n):
        words = [r.randrange(r.choice([1, 2, 3, 6])) for _ in range(r.randrange(80))]
        if words and r.random() < 0.6:
            a, p = r.randrange(len(words)), r.randrange(1, 9)
            words = words[:a] + [words[min(len(words) - 1, a + (i - a) % p)] for i in range(a, len(words))]
        yield words


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_equal_the_search_of_all_periods(least):
    for words in sequences(400):
        assert R.runs_of(words, least) == plain_runs(words, least)


def test_runs_of_special_words():
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 400:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for words in ([0] * 300, fibonacci[-1], [bin(i).count("1") % 2 for i in range(400)], [0, 1] * 100 + [0, 2] * 100):
        assert R.runs_of(words, 2) == plain_runs(words, 2)


@pytest.mark.parametrize("chunk", [1, 50, 1 << 18])
def test_texts_of_a_chunk_do_not_touch(monkeypatch, chunk):
    monkeypatch.setattr(R, "CHUNK", chunk)
    texts = [[str(w).encode() for w in words] for words in sequences(200, seed=4)] + [[], [b"a"] * 11, [b"a"] * 12, [b"a"] * 12]
    found = list(R._judged([b" \n".join(t) for t in texts], 12))
    for words, (n, runs, rest) in zip(texts, found):
        assert (n, runs) == (len(words), plain_runs(words))
        assert rest == b" ".join(plain_collapsed(words, runs))


def test_the_last_ends_are_those_of_the_longest_common_suffixes():
    r = random.Random(8)
    words = [r.randrange(3) for _ in range(120)]
    automaton = R.LinkedAutomaton()
    for i, word in enumerate(words):
        want, longest = [], 0
        for j in range(i - 1, -1, -1):
            same = 0
            while same <= j and words[i - same] == words[j - same]:
                same += 1
            if same > longest:
                want.append((j, same))
                longest = same
        assert sorted(automaton.append(word), key=lambda s: s[1]) == want


def test_operator_on_odd_rows(spark):
    long = "ab cd " * 30_000 + "x " * 40_000 + " ".join(f"w{i}" for i in range(50_000))
    schema = "doc_id long, text string, runs string, n_words int, collapsed int"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 12), (4, "a " * 12), (5, long), (None, "é ü\x0b" * 6), (6, "a b c d")]
    df = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], schema).withColumn("odd name.x", extra()).repartition(3)
    out = R.periodic_runs(df)
    assert out.columns == ["doc_id", "text", "odd name.x", "n_words", "runs", "collapsed"]
    found = sorted((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"] if r["n_words"] < 99 else len(r["collapsed"].split())) for r in out.collect())
    assert found == [
        (0, 12, [(0, 12, 2)], "é ü"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 12, [(0, 12, 1)], "a"), (4, 12, [(0, 12, 1)], "a"),
        (5, 150_000, [(0, 60_000, 2), (60_000, 40_000, 1)], 50_003), (6, 2, [], "a b c d")]
    assert R.periodic_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        R.periodic_runs(df, least=1)


def extra():
    from pyspark.sql import functions as F

    return F.lit("extra")


def test_digest_of_every_row(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randrange(0, 90))) or None) for i in range(150)] + [(None, "a b " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = R.digest(R.periodic_runs(R.with_periodic_tails(df), keep=["doc_id"]), ["doc_id"]).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for row in found:
        words = (texts[row["doc_id"]] or "").split()
        n = len(words)
        h = zlib.crc32(str(row["doc_id"]).encode()) if row["doc_id"] is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want = [len(runs), *(best or [None] * 3), 1000 * best[1] // best[2] if best else None]
        assert [row[c] for c in ("n_runs", "start", "length", "period", "exponent_milli")] == want
        assert row["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(" ".join(plain_collapsed(words, runs)).encode()).hexdigest()
