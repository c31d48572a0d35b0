"""Value counts in long form and top-k per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayframe.plans.wide import unpivot_text


def value_counts(df: DataFrame, views: dict[str, Column]) -> DataFrame:
    """``(column, value, n)`` over the non-null cells of text views.

    Partial aggregation folds hot values on the map side, so a value that fills
    a third of the table costs one shuffled row per task.
    """
    return unpivot_text(df, views).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank.

    The rank filter sits right on the window, so Spark keeps at most ``k`` rows
    of a group per task before the shuffle (WindowGroupLimit).
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
