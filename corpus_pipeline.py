"""Cleans the documents of a corpus: language, near copies, personal data, mix of sources, token ids.

Every stage takes the table that its predecessor wrote and returns a table with the columns of ``documents``
(``doc_id, text, lang, source, n_chars``; extra ones pass through), the last one token ids instead of the text. Nulls in
any column, empty tables, repeated rows and clashing names are handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from assayframe.llm import bpe_tokens, language_entropy, pii_crf, poisson_mix, simhash_links, spans
from assayframe.llm.common import joined_by_size, lookup, settled, table
from assayframe.llm.queries import RANKS

#: The columns of documents that the stages know; others travel in one struct, so that their names cannot clash.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")
EXTRA = "extra columns"


def packed(docs: DataFrame) -> DataFrame:
    """The known columns and one struct of the others, if there are any."""
    extra = [F.col(f"`{c}`") for c in docs.columns if c not in KNOWN]
    return docs.select(*[c for c in docs.columns if c in KNOWN], *([F.struct(*extra).alias(EXTRA)] if extra else []))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Of packed rows the given columns, in their order."""
    return rows.select(*[F.col(c) if c in KNOWN else F.col(f"`{EXTRA}`")[c].alias(c) for c in columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, however unsure the language of the others is; a missing label gets the predicted one."""
    judged = language_entropy.predict(packed(docs), language_entropy.learn(docs))
    kept = judged.where(F.col("lang_pred") != language_entropy.UNDECIDED)
    return unpacked(kept.withColumn("lang", F.coalesce("lang", "lang_pred")), docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of near copies by SimHash (three-word shingles, three bits), that with the smallest id.

    Rows count by themselves, not by their ids: of rows with one id and different texts each is judged by its own text, of
    equal rows one stays. Rows without an id stay. The numbers of the rows are written with them, so that they hold for all
    later reads.
    """
    rows = settled(packed(docs).withColumn("row", F.monotonically_increasing_id()), "near-copies")
    groups = simhash_links.near_copies(rows.select("row", "text"), doc_id="row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    members = settled(groups.join(rows.where("doc_id is not null").select("row", "doc_id"), "row"), "near-copies")
    first = F.struct("doc_id", "row")
    kept = settled(members.groupBy("group").agg(F.min(first).alias("kept"), F.count("*").alias("n")).where("n > 1"), "near-copies")
    gone = settled(lookup(members, kept, "group", "inner").where(first != F.col("kept")).select("row"), "near-copies")
    return unpacked(joined_by_size(rows, gone, ["row"], "left_anti"), docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in angle brackets; texts without any stay as they are."""
    found = pii_crf.personal_data(packed(docs))
    hit = F.size("spans") > 0
    masked = found.withColumn("text", F.when(hit, spans.masked(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    return unpacked(masked.withColumn("n_chars", F.when(hit, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))), docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats every document by its Poisson count, in random order."""
    return unpacked(poisson_mix.mix(packed(docs)), docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, instead of the text."""
    keep = [c for c in docs.columns if c not in ("text", "ids")]
    return bpe_tokens.encode(docs, RANKS, public_tokenizers.PATTERN, keep=keep)


STAGES = [
    ("language_entropy", language_stage),
    ("simhash_links", near_copy_stage),
    ("pii_crf", personal_data_stage),
    ("poisson_mix", mix_stage),
    ("bpe_tokens", token_stage),
]

#: SQL can express neither the parse against suffix automata nor the field; the stages are tested against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
