"""Token ids against the library itself, and exact round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import regex

from assayframe.llm import bpe_tokens
from assayframe.llm.queries import RANKS

CODEC = bpe_tokens.codec(RANKS, public_tokenizers.PATTERN)


def by_matches(text):
    ids = []
    for m in regex.finditer(public_tokenizers.PATTERN, text):
        ids += CODEC.library._core_bpe.encode_single_piece(m.group().encode())
    return ids


def texts():
    r = random.Random(2)
    words = ["the", "élan", "12", "don't", "\n\n", "  ", "\t", "naïve", "...", "日本", "🙂", " ", "x_y", "I'll", " "]
    yield from ("", "a", " ", "a  ", "  a", "<|endoftext|>")
    for _ in range(200):
        yield "".join(r.choice(words) + r.choice(["", " ", "\n", "  "]) for _ in range(r.randrange(1, 40)))


def test_ids_equal_the_pattern_matches_encoded_one_by_one():
    for text in texts():
        assert CODEC.encode(text) == by_matches(text) and CODEC.decode(CODEC.encode(text)) == text.encode()


@pytest.mark.parametrize("about", [5, 20, 200])
def test_parts_of_long_texts_are_cut_at_safe_boundaries(about):
    for text in texts():
        parts = list(bpe_tokens.safe_parts(text, about))
        assert "".join(parts) == text and all(parts)
        assert [t for p in parts for t in CODEC.encode(p)] == CODEC.encode(text)


@pytest.mark.parametrize("unit", ["^", " ", "a", "1", "語", "ab ", "\n"])
def test_very_long_texts(unit):
    text = unit * (1_300_000 // len(unit)) + "z"
    ids = CODEC.encode(text)
    assert CODEC.decode(ids) == text.encode()


def test_frames(spark):
    long = "word " * 30_000 + "x" * 120_000
    rows = [(1, "hello wörld", "e"), (2, None, "e"), (3, "", "e"), (1, "hello wörld", "e"), (None, "a", None), (5, long, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = bpe_tokens.encode(df, RANKS, public_tokenizers.PATTERN)
    assert encoded.columns == ["doc_id", "text", "ids"]
    found = bpe_tokens.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert [(r["doc_id"], bytes(r["decoded"])) for r in found] == [(i, (t or "").encode()) for i, t, _ in rows]
    for row in bpe_tokens.digests(encoded, RANKS, public_tokenizers.PATTERN, ["doc_id"]).collect():
        text = next(t for i, t, _ in rows if i == row["doc_id"]) or ""
        ids = CODEC.encode(text)
        assert row["n_tokens"] == len(ids) and row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe_tokens.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []
