"""Cross-parsing against plain parsing, and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from assayframe.llm import language_entropy as L

SF = "/root/testdata/sf0.01"
WORDS = {"aa": ["lorem", "ipsum", "dolor", "sit"], "bb": ["hund", "katze", "über", "maus"], "cc": ["chien", "été", "garçon", "eau"]}


def sentence(r, lang, n=12):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n)) + "."


def documents(n=90):
    r = random.Random(1)
    return [(i, sentence(r, lang), lang, "keep", 1.5) for i in range(n) for lang in [list(WORDS)[i % 3]]]


def plain_phrases(train, text):
    """Phrases of a greedy parse of ``text`` into the longest substrings of ``train``."""
    joined = bytes(train)
    count, at = 0, 0
    while at < len(text):
        size = 0
        while at + size < len(text) and bytes(text[at : at + size + 1]) in joined:
            size += 1
        count, at = count + 1, at + max(size, 1)
    return count


def test_automata_count_the_phrases_of_a_greedy_parse(monkeypatch):
    monkeypatch.setattr(L, "LANE", 1 << 12)
    r = random.Random(2)
    samples = {lang: " ".join(sentence(r, lang) for _ in range(6)) for lang in WORDS}
    model = L.fitted(samples)
    texts = [L.symbols_of(L.code_points(sentence(r, lang, 30) + " wxyz 日本"), model.symbols) for lang in WORDS]
    found = L.phrases(model, texts)
    for row, lang in enumerate(model.languages):
        train = L.symbols_of(L.code_points(samples[lang]), model.symbols).tolist()
        assert found[row].tolist() == [plain_phrases(train, t.tolist()) for t in texts]


def test_automaton_accepts_substrings_only():
    text = [3, 4, 3, 3, 4, 5]
    moves = L.suffix_automaton(text)

    def accepts(word):
        state = 0
        for symbol in word:
            if symbol not in moves[state]:
                return False
            state = moves[state][symbol]
        return True

    for a in range(len(text)):
        for b in range(a + 1, len(text) + 1):
            assert accepts(text[a:b])
    assert not accepts([4, 4]) and not accepts([5, 3])


def test_prediction(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 3000)
    rows = documents()
    odd = [(1000, None, "aa", "k", 0.0), (1001, "", "aa", "k", 0.0), (1002, "12 !? \n", None, "k", 0.0), (None, "hund katze über maus hund", None, "k", 0.0),
           (1003, "chien été " * 40_000, None, "k", 0.0), (1003, "chien été " * 40_000, None, "k", 0.0)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)
    model = L.learn(df)
    assert model.languages == ["aa", "bb", "cc"]
    found = L.predict(df, model)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert all(by_id[i]["lang_pred"] == lang for i, _, lang, *_ in rows)
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert by_id[None]["lang_pred"] == "bb" and by_id[1003]["lang_pred"] == "cc"
    assert all(0 <= r["score"] <= 1 for r in by_id.values())


def test_learns_from_documents_that_are_not_held_out(spark):
    rows = [(i, f"only{'x' * (i + 1)}", "aa") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 0]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert L.learn(df) is None
    assert {r["lang_pred"] for r in L.predict(df, None).collect()} == {"und"}
    assert L.predict(df.limit(0), None).collect() == []


def test_held_out_accuracy(spark):
    from assayframe.llm.queries import QUERIES

    found = {r["doc_id"]: r for r in QUERIES["op1_language_entropy"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(found) == len(docs)
    assert all(found[d["doc_id"]]["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0) for d in docs)
    held = [found[d["doc_id"]]["lang_pred"] == d["lang"] for d in docs if found[d["doc_id"]]["held_out"]]
    assert np.mean(held) >= 0.98
