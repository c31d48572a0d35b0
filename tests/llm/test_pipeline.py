"""The pipeline's stages against plain code, and the registered queries against their SQL."""

import os
import re

import public_tokenizers
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline as C
from assayframe.llm import bpe_tokens, pii_crf, poisson_mix
from assayframe.llm.queries import ORACLES, QUERIES, RANKS
from assayframe.llm.spans import masked
from test_poisson_mix import inverted, uniform
from test_simhash_links import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string, ids string, copy int, gone string"
EXTRA = ("a", "b", "c", 7, "d")


def documents():
    lorem = ["lorem ipsum dolor sit amet", "consectetur adipiscing elit sed", "do eiusmod tempor incididunt"]
    hund = ["der hund und die katze", "das haus über dem fluss", "ein vogel sitzt im baum"]
    rows = []
    for i in range(60):
        words = (lorem if i % 2 else hund)[i % 3]
        rows.append((i, f"{words} nummer{i} {words[::-1]} ende{i}", "la" if i % 2 else "de", f"s{i % 4}", None, *EXTRA))
    rows += [(100 + i, rows[i][1].replace(" ", "  ").upper(), "la" if i % 2 else "de", "s1", 3, *EXTRA) for i in range(0, 20, 3)]
    rows += [(200, "call +1 (771) 555-1655 or a.b@c.de der hund und", None, None, 46, *EXTRA), (201, None, "de", "s0", None, *EXTRA), (202, "12 34", "de", "s0", 5, *EXTRA)]
    return rows + [(None, "die katze ohne nummer", "de", "s0", 0, *EXTRA), rows[4], rows[4]]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_names():
    names = list(entry_point.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names
    assert [n for n, _ in C.STAGES] == ["language_entropy", "simhash_links", "pii_crf", "poisson_mix", "bpe_tokens"]
    assert set(ORACLES) <= set(QUERIES)


def test_stages_equal_plain_code(spark):
    rows = documents()
    df = frame(spark, rows).repartition(3)
    step = {}
    docs = df
    for name, stage in C.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.columns == (df.columns if name != "bpe_tokens" else [c for c in df.columns if c not in ("text", "ids")] + ["ids"])
        step[name] = sorted(map(tuple, docs.collect()), key=repr) if name != "bpe_tokens" else docs.collect()
        docs = spark.createDataFrame(step[name], df.schema) if name != "bpe_tokens" else None
    # 1: all but the texts without a letter stay as they are, the missing label is filled
    want = sorted([r if r[0] != 200 else (*r[:2], "de", *r[3:]) for r in rows if r[1] and re.search("[a-z]", r[1], re.I)], key=repr)
    assert step["language_entropy"] == want
    # 2: one row of every group of near copies
    components = plain_components([(r[0], plain_fingerprint(r[1])) for r in want])
    kept = sorted([r for r in want if r[0] is None] + list({r for r, c in zip(want, components) if r[0] is not None and r[0] == c}), key=repr)
    assert step["simhash_links"] == kept and len(kept) < len(want) - 5
    # 3: personal data is masked
    masked = sorted([r if r[0] != 200 else (200, "call <phone> or <email> der hund und", "de", None, 36, *r[5:]) for r in kept], key=repr)
    assert step["pii_crf"] == masked
    # 4: every document as often as its Poisson count says
    rates = {r["_source"]: r["rate"] for r in poisson_mix.source_rates(frame(spark, masked)).collect()}
    copies = lambda r: inverted(uniform("poisson-42", "" if r[0] is None else str(r[0]), "0"), rates["null" if r[3] is None else f"={r[3]}"])
    assert step["poisson_mix"] == sorted([r for r in masked for _ in range(copies(r))], key=repr)
    # 5: the ids of the texts
    codec = bpe_tokens.codec(RANKS, public_tokenizers.PATTERN)
    found = sorted((r["doc_id"] is None, r["doc_id"], tuple(r["ids"])) for r in step["bpe_tokens"])
    assert found == sorted((r[0] is None, r[0], tuple(codec.encode(r[1]))) for r in step["poisson_mix"])


@pytest.mark.parametrize("name, stage", C.STAGES)
def test_empty_tables(spark, name, stage):
    assert stage(spark, frame(spark, []), SF).collect() == []


def test_clean_documents_stay_as_they_are(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = C.language_stage(spark, docs, SF)
    assert kept.count() == docs.where(docs.text.rlike(r"\p{L}")).count()
    clean = [r for r in docs.collect() if not re.search(r"[0-9@]", r["text"])]
    masked = {tuple(r) for r in C.personal_data_stage(spark, docs, SF).collect()}
    assert {tuple(r) for r in clean} <= masked and len(masked) == docs.distinct().count()
    assert pii_crf.find([r["text"] for r in clean], pii_crf.trained()) == [[]] * len(clean)


def test_rows_with_one_id_are_judged_by_their_own_texts(spark):
    tail = (None, None, None, *EXTRA)
    first, second, third = ("alpha beta gamma delta epsilon", "one two three four five six", "red green blue white black grey")
    rows = [(1, first, *tail), (5, first, *tail), (5, second, *tail), (5, second, *tail), (7, second, *tail), (8, third, *tail), (8, first.upper() + " zeta", *tail)]
    found = [(r["doc_id"], r["text"]) for r in C.near_copy_stage(spark, frame(spark, rows).repartition(3), SF).collect()]
    # the first text of id 5 is a copy of id 1, its second one the smallest of its own group
    assert sorted(found) == [(1, first), (5, second), (8, first.upper() + " zeta"), (8, third)]


def test_short_texts_of_unsure_language_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert [r["doc_id"] for r in C.language_stage(spark, docs, SF).where("doc_id = 4616").collect()] == [4616]


def test_overlapping_personal_data_is_masked_to_its_end(spark):
    text = "4111 1111 1111 1111.jane.doe@example.com and on"
    spans = [("card", 0, 19, True), ("phone", 5, 9, True), ("email", 15, 40, True)]
    df = spark.createDataFrame([(text, spans)], "text string, spans array<struct<kind:string,start:int,end:int,base:boolean>>")
    assert df.select(masked(df.text, df.spans)).first()[0] == "<card><email> and on"


def test_run(spark):
    found = entry_point.queries()["pipeline"](spark, SF)
    assert found.columns == ["doc_id", "lang", "source", "n_chars", "ids"] and found.count() > 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    import duckdb

    from checks.compare import TABLES, canonical

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.columns, df.collect()) == canonical(columns, cursor.fetchall())
