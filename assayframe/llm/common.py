"""What the operators share: inputs, written intermediate tables, joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayframe.plans.durable import scratch_folder, written

#: A side of at most so many narrow rows is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
#: A key with more than this share of all rows is hot; fewer than ``1 / HOT_SHARE`` such keys can exist.
HOT_SHARE = 0.001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names, which every executor reaches; ``clear_scratch`` deletes it."""
    return scratch_folder(spark, name)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Cuts the lineage: later jobs and retries of lost tasks read the files, whichever executor wrote them.
    """
    return written(df, name)


def lookup(rows: DataFrame, facts: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join ``rows`` with at most one fact per ``key``, where single keys may hold a third of all rows.

    ``facts`` must have the column ``n``: how many of ``rows`` have the key. Keys with more than ``HOT_SHARE``
    of all rows are fewer than a thousand by arithmetic, so they are broadcast at any size of the data; the
    others meet in a shuffle in which no key is large.
    """
    total = facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(1, int(total * HOT_SHARE))
    hot, cold = facts.where(F.col("n") > least), facts.where(F.col("n") <= least)
    fields = [c for c in facts.columns if c not in (key, "n")]
    is_hot = hot.select(key, F.struct(*fields).alias("_hot"), F.lit(True).alias("_is_hot"))
    marked = rows.join(F.broadcast(is_hot), key, "left")
    by_shuffle = marked.where("_is_hot is null").drop("_hot", "_is_hot").join(cold.drop("n"), key, how)
    by_broadcast = marked.where("_is_hot").select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in fields])
    return by_broadcast.unionByName(by_shuffle.select(*by_broadcast.columns))


def joined_by_size(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Broadcast ``facts`` if it has at most ``BROADCAST_ROWS`` rows, else shuffle both sides."""
    few = len(facts.select(keys[0]).limit(BROADCAST_ROWS + 1).take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS
    return rows.join(F.broadcast(facts) if few else facts, keys, how)


def finite_vector(name: str) -> Column:
    """Neither null nor empty, and every component a finite number."""
    bad = F.exists(F.col(name), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(name).isNotNull() & (F.size(name) > 0) & ~F.coalesce(bad, F.lit(True))
