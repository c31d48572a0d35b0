"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from assayframe.llm import (
    attention_scores, bpe_tokens, credential_links, exact_topk, importance_resampling, language_entropy, page_boilerplate, pii_crf, poisson_mix, rotated_bits,
    simhash_links, spans, warc_members, word_runs,
)
from assayframe.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@query("op1_language_entropy")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_entropy.learn(docs)
    held_out = docs.withColumn("held_out", F.coalesce(language_entropy.remainder("doc_id") == 0, F.lit(False)))
    return language_entropy.predict(held_out, model, keep=["doc_id", "held_out"])


@query("op2_page_boilerplate")
def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_boilerplate.extract(table(spark, sf_dir, "pages"))


# A component is finite if it is neither null nor NaN nor infinite.
_VECTORS = """v AS (SELECT vec_id, {cast} AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0{more})"""


@query("op3_exact_topk", "WITH " + _VECTORS.format(cast="list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT))", more="") + """,
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=5, query_every=50)


@query("op4_simhash_links")
def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_links.near_copies(table(spark, sf_dir, "documents"))


@query("op5_pii_crf")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.digest(pii_crf.personal_data(table(spark, sf_dir, "documents"), keep=["doc_id"]), pii_crf.KINDS, ["doc_id"])


@query("op6_rotated_bits", "WITH " + _VECTORS.format(cast="CAST(embedding AS DOUBLE[])", more=" AND len(list_filter(embedding, lambda c: c <> 0)) > 0") + """,
s AS (SELECT q.vec_id AS query_id, c.vec_id,
    sqrt(list_reduce(list_transform(range(1, len(q.x) + 1), lambda i: (q.x[i] - c.x[i]) * (q.x[i] - c.x[i])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def nearest_by_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated_bits.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=10, query_every=100)


@query("op7_poisson_mix", """WITH RECURSIVE d AS (
  SELECT *, coalesce('=' || source, 'null') AS s, coalesce(CAST(doc_id AS VARCHAR), '') AS i, CAST(coalesce(length(text), 0) AS BIGINT) + 1 AS m FROM documents),
z AS (SELECT s, CAST(sum(m) AS DOUBLE) AS size, floor(sqrt(sum(m))) AS w FROM d GROUP BY s),
r AS (SELECT s, (w / (SELECT sum(w) FROM z)) * ((SELECT sum(size) FROM z) / size) AS rate FROM z),
t AS (SELECT s, greatest(ceil(rate / 32), 1) AS parts, rate / greatest(ceil(rate / 32), 1) AS mean FROM r),
c AS (SELECT s, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf FROM t
  UNION ALL SELECT s, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM c WHERE k < ceil(mean + 12 * sqrt(mean) + 30)),
l AS (SELECT s, list(cdf ORDER BY k) AS cdfs FROM c GROUP BY s),
u AS (SELECT d.*, l.cdfs, unnest(range(CAST(t.parts AS BIGINT))) AS part FROM d JOIN t USING (s) JOIN l USING (s)),
n AS (SELECT *, len(list_filter(cdfs, lambda x: x <= CAST(('0x' || substr(md5('poisson-42|' || i || '|' || part), 1, 13)) AS BIGINT) / 4503599627370496.0)) AS one FROM u),
g AS (SELECT doc_id, text, lang, source, n_chars, i, CAST(sum(one) AS INTEGER) AS n_copies FROM n GROUP BY ALL),
e AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM g)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, n_copies, md5('mix-42|' || i || '|' || copy) AS mix_key FROM e""")
def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix.mix(table(spark, sf_dir, "documents"))


@query("op8_warc_members", """WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST(('0x' || substr(h, 1 + 5 * i, 5)) AS INTEGER) >> s) & 31), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS latest FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> latest THEN latest END AS refers_to FROM g""")
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_members.archive_round_trip(table(spark, sf_dir, "pages"))


@query("op9_credential_links")
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.digest(credential_links.secrets(table(spark, sf_dir, "documents"), keep=["doc_id"]), credential_links.BASE, ["doc_id"])


@query("op10_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe_tokens.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, keep=["doc_id"])
    return bpe_tokens.digests(encoded, RANKS, public_tokenizers.PATTERN, ["doc_id"])


# CRC-32 of short ASCII text, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, CAST(length({text}) AS BIGINT) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"""


@query("op11_word_runs", "WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, " + _CRC.format(text="CAST(doc_id AS VARCHAR)") + """ AS h FROM documents),
n AS (SELECT *, CAST(len(w) AS BIGINT) AS n, h // 10 AS g FROM c),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM n),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM p),
t AS (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS w FROM d),
s AS (SELECT doc_id, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o) AS six, lead(w, 5) OVER o IS NOT NULL AS whole
  FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT y.doc_id, y.i, y.i - x.i AS q FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.six = y.six AND x.i < y.i AND x.whole AND y.whole),
e AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM m),
f AS (SELECT doc_id, q, min(i) - q AS start, count(*) + 5 + q AS length FROM e GROUP BY doc_id, q, g HAVING count(*) + 5 >= q AND count(*) + 5 + q >= 12),
r AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.doc_id = f.doc_id AND o.q < f.q AND o.start <= f.start AND o.start + o.length >= f.start + f.length)),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines,
    first(struct_pack(start := start, length := length, q := q) ORDER BY length DESC, start, q) AS best FROM r GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = t.doc_id AND t.i >= r.start + r.q AND t.i < r.start + r.length) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
  CAST(1000 * best.length // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)""")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = word_runs.with_periodic_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return word_runs.digest(word_runs.periodic_runs(docs, keep=["doc_id"]), ["doc_id"])


def _nibble(c: int) -> int:
    for _ in range(4):
        c = c >> 1 ^ 0xEDB88320 * (c & 1)
    return c


# CRC-32 of UTF-8 text, by half bytes, the lower one first.
_CRC_BY_NIBBLES = f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({{text}})) * 2),
  lambda i: CAST(strpos('0123456789ABCDEF', substr(hex(encode({{text}})), CAST(xor(i, 1) AS BIGINT) + 1, 1)) - 1 AS BIGINT))),
  lambda c, b: xor(c >> 4, {[_nibble(i) for i in range(16)]}[CAST(xor(c, b) & 15 AS INTEGER) + 1])))"""

_FEATURES = """{name}w AS (SELECT {id}regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}),
{name}f AS (SELECT {id}len(w) AS words, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])),
  list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])))) AS f FROM {name}w)"""


@query("op12_importance_resampling", "WITH " + _FEATURES.format(name="d", id="doc_id, ", table="documents") + ",\n" + _FEATURES.format(name="b", id="", table="benchmark") + """,
h AS (SELECT f, """ + _CRC_BY_NIBBLES.format(text="f") + """ % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf)),
s AS (SELECT bucket, count(*) AS n FROM df JOIN h USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN h USING (f) GROUP BY bucket),
z AS (SELECT (SELECT count(*) FROM df) + 10000.0::DOUBLE AS s, (SELECT count(*) FROM bf) + 10000.0::DOUBLE AS t),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * z.s / ((coalesce(s.n, 0) + 1)::DOUBLE * z.t))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM h) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), z),
w AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM df JOIN h USING (f) JOIN g USING (bucket) GROUP BY doc_id),
c AS (SELECT doc_id, len(dw.w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    (CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296 AS u FROM dw LEFT JOIN w USING (doc_id)),
r AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln(u))) AS BIGINT) AS score FROM c),
k AS (SELECT *, row_number() OVER (ORDER BY words >= 20 DESC, score DESC, doc_id) AS place, count(*) FILTER (words >= 20) OVER () AS able FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * able // 100 THEN place END AS rank FROM k""")
def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


@query("op13_attention_scores")
def language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_scores.score_texts(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
