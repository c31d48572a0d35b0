"""Places in a total order without a window over all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayframe.plans.durable import written

PART, PLACE, TIE = "_part", "_place", "_tie"
#: Bits of ``monotonically_increasing_id`` that count the rows of a partition.
_ROW_BITS = 33


def place_in_partition() -> Column:
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))


def range_parts(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` in ranges of ``order``, with the number of a row's range and its place there, from 0; written once.

    Equal rows are told apart by their place in ``df``, so that many of them may fill several ranges; ``df`` must give its
    rows in the same order when it is read again, as files do.
    """
    by = [*order, F.col(TIE)]
    ranged = df.withColumn(TIE, F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    return written(ranged.drop(TIE).withColumns({PART: F.spark_partition_id(), PLACE: place_in_partition()}), "ranges")


def offsets(parts: DataFrame) -> DataFrame:
    """``(_part, _before)``: how many rows lie before each range; one row per range."""
    sizes = sorted(tuple(r) for r in parts.groupBy(PART).agg(F.count("*").alias("n")).collect())
    before = [0, *accumulate(n for _, n in sizes)]
    return small_frame(parts.sparkSession, [(p, b) for (p, _), b in zip(sizes, before)], f"{PART} int, _before long")


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema).coalesce(1)


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """``df`` with the dense number of each row, from 1, in ``order``: one exchange by range, one table of range sizes."""
    parts = range_parts(df, order)
    return parts.join(F.broadcast(offsets(parts)), PART).withColumn(name, F.col("_before") + F.col(PLACE) + 1).drop(PART, PLACE, "_before")
