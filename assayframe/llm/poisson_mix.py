"""Mixing sources to target weights by Poisson replication; DataFrame functions only.

A source of weight ``w`` and size ``m`` should give the share ``w / sum(w)`` of the mix, so each of its documents is
repeated ``budget * (w / sum(w)) * (total / m)`` times on average. The number of copies of a document is the Poisson
distribution of that mean, inverted at a uniform number hashed from seed and document id, so a retry or another
cluster gives the same mix. A mean above ``PART`` is the sum of equal parts, each with a hash of its own, which keeps
the table of cumulated probabilities short and its first entry above zero. Copies are dealt out by the hash of
(seed, id, copy) and sorted by it within partitions, a uniformly random order over the whole mix.

Sizes are characters, one more for each document. Default weights are the integer square roots of the sizes, which
flattens the mix without dropping small sources.

Defined results: a null source is a source of its own; a null text has no characters; a source that ``weights`` does
not name, or gives a null or negative weight, has weight 0 and leaves the mix; rows with equal ids (a null id counts
as an empty one) get equally many copies; an empty table gives an empty mix; extra columns pass through, those named
``copy``, ``n_copies`` or ``mix_key`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayframe.llm.common import BROADCAST_ROWS, lookup

#: Largest mean that is inverted at once.
PART = 32.0
OWN = ["copy", "n_copies", "mix_key"]


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the parts joined by ``|``."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long").cast("double") / F.lit(2.0**52)


def source_rates(docs: DataFrame, source: str = "source", text: str = "text", weights: DataFrame | None = None, budget: float = 1.0) -> DataFrame:
    """``(_source, n, weight, rate, parts, cdf)``: one row per source, the cumulated probabilities of one part."""
    sizes = docs.groupBy(source_key(source).alias("_source")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce(F.char_length(text), F.lit(0)).cast("long") + 1).alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.floor(F.sqrt("size")).cast("double"))
    else:
        named = weights.select(source_key("source").alias("_source"), F.greatest(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
        weighed = sizes.join(named.groupBy("_source").agg(F.max("weight").alias("weight")), "_source", "left").fillna(0.0, ["weight"])
    whole = weighed.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight")).first()
    all_size, all_weight = whole["all_size"] or 0, whole["all_weight"] or 0.0
    rate = F.when(F.lit(all_weight > 0), F.lit(float(budget)) * ((F.col("weight") / F.lit(all_weight or 1.0)) * (F.lit(float(all_size)) / F.col("size")))).otherwise(0.0)
    rated = weighed.withColumn("rate", rate).withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    longest = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    first = F.exp(-mean)
    table = F.aggregate(
        F.sequence(F.lit(1), longest),
        F.struct(first.alias("p"), F.array(first).alias("cdf")),
        lambda acc, k: F.struct(
            (acc["p"] * mean / k).alias("p"),
            F.array_append(acc["cdf"], F.element_at(acc["cdf"], -1) + acc["p"] * mean / k).alias("cdf")),
        lambda acc: acc["cdf"],
    )
    return rated.select("_source", "n", "weight", "rate", "parts", table.alias("cdf"))


def source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def mix(
    docs: DataFrame, weights: DataFrame | None = None, budget: float = 1.0, seed: int = 42, doc_id: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` with ``copy`` (from 1), ``n_copies`` and ``mix_key``, in random order over all partitions.

    ``weights`` has the columns ``source`` and ``weight``.
    """
    kept = [c for c in docs.columns if c not in OWN]
    rates = source_rates(docs, source, text, weights, budget).cache()
    # the row travels as one struct, so that none of its columns can clash
    keyed = docs.select(
        F.struct(*[F.col(c) for c in kept]).alias("row"), source_key(source).alias("_source"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("own_id"))
    if len(rates.select("_source").take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS:
        rated = keyed.join(F.broadcast(rates.select("_source", "parts", "cdf")), "_source")
    else:
        rated = lookup(keyed, rates.select("_source", "n", "parts", "cdf"), "_source")
    draw = lambda part: uniform(F.lit(f"poisson-{seed}"), F.col("own_id"), part.cast("string"))
    copies = F.aggregate(F.sequence(F.lit(0), F.col("parts") - 1), F.lit(0), lambda n, part: n + _passed(F.col("cdf"), draw(part)))
    counted = rated.withColumn("n_copies", copies).where(F.col("n_copies") > 0)
    copied = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    shuffled = copied.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(f"mix-{seed}"), F.col("own_id"), F.col("copy").cast("string"))))
    return shuffled.select("row", *OWN).repartition("mix_key").sortWithinPartitions("mix_key").select("row.*", *OWN)


def _passed(cdf: Column, u: Column) -> Column:
    """How many cumulated probabilities are at most ``u``: the smallest count whose probability reaches beyond it."""
    return F.aggregate(F.array(u), F.lit(0), lambda n, x: n + F.size(F.filter(cdf, lambda c: c <= x)))
