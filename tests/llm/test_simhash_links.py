"""SimHash fingerprints and components against plain code."""

import random
import re

import numpy as np
import pytest
import xxhash

from assayframe.llm import simhash_links as S


def plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=3):
    """Smallest id reachable, for a list of (id, fingerprint)."""
    label = {i: i for i in range(len(prints))}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= distance:
                label[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(prints))]


def documents():
    r = random.Random(3)
    words = ["Tion", "the", "ÄPFEL", "a", "re", "éa", "st", "on,", "x y", "İs"]
    rows = []
    for i in range(120):
        text = " ".join(r.choice(words) for _ in range(r.randrange(0, 60)))
        rows.append((i, text, "s", "c"))
        if i % 4 == 0:
            rows.append((500 + i, text.upper() if i % 8 else text.replace(" ", "\n\t"), "s", "c"))
    return rows + [(900, None, "s", "c"), (901, "   \n", "s", "c"), (7, rows[8][1], "s", "c"), (7, rows[8][1], "s", "c"), (None, "lone text here now", "s", "c"), (902, "one two " * 4000, "s", "c")]


def test_fingerprints_equal_plain_code(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 37)
    texts = [t for _, t, *_ in documents()]
    found = S.fingerprints_of([None if t is None else t.encode() for t in texts], 3)
    assert found.tolist() == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("bucket", [2048, 3])
def test_components_equal_plain_code(spark, monkeypatch, bucket):
    monkeypatch.setattr(S, "BUCKET", bucket)
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string").repartition(3)
    found = sorted((tuple(r) for r in S.near_copies(df).collect()), key=repr)
    prints = [(i, plain_fingerprint(t)) for i, t, *_ in rows]
    want = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, plain_components(prints))), key=repr)
    assert found == want


def test_links_among_crowded_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 16)
    r = random.Random(4)
    centres = [r.getrandbits(64) for _ in range(4)]
    values = {c for c in centres} | {c ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 7))) for c in centres for _ in range(120)}
    fps = spark.createDataFrame([(S.signed(v),) for v in values], "fp long")
    n, both = S.bit_statistics(fps)
    assert n == len(values) and both[5, 5] == sum(v >> 5 & 1 for v in values)
    buckets = S.buckets(fps, S.allocation(n, both, 3), 3)
    assert buckets.groupBy("mask", "value").count().agg({"count": "max"}).first()[0] <= 16
    found = {r["node"]: r["root"] for r in S.components(S.links(buckets, 3)).collect()}
    order = sorted(S.signed(v) for v in values)
    want = plain_components([(v, v % (1 << 64)) for v in order])
    assert [found.get(v, v) for v in order] == want


@pytest.mark.parametrize("n", [2, 10**4, 10**7, 10**10])
def test_thresholds_fill_the_pigeonhole(n):
    both = np.full((64, 64), n / 4)
    np.fill_diagonal(both, n / 2)
    parts = S.allocation(n, both, 3)
    assert sum(t + 1 for _, t in parts) == 4 and all(t in (0, 1) for _, t in parts)
    bits = [b for p, _ in parts for b in p]
    assert len(bits) == len(set(bits))
    if n == 10**10:  # so many fingerprints need wider keys
        assert max(t for _, t in parts) == 1


def test_correlated_bits_share_a_part():
    n, r = 4000, np.random.default_rng(1)
    bits = r.random((n, 64)) < 0.5
    bits[:, 40] = bits[:, 3]
    bits[:, 17] = ~bits[:, 3]
    both = bits.T.astype(float) @ bits
    assert any({3, 17, 40} <= set(p) for p in S.correlated_parts(n, both, 4))


def test_empty_and_single(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [r["component_id"] for r in S.near_copies(df).collect()] == [1]
    assert S.near_copies(df.limit(0)).collect() == []


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (101, 100)], "a long, b long")
    found = dict(tuple(r) for r in S.components(edges).collect())
    assert found == {i: 0 for i in range(1, 41)} | {101: 100}
