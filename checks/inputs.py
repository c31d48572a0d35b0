"""Input tables of the checks, including a deterministic dirty view of ``orders``.

The driver tables hold no gaps or dirt, so most checks run on ``dirty_orders``.
The same rules are written once for Spark and once as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DIRTY_COLUMNS = [
    "order_id", "total", "qty_txt", "date_txt", "priority_txt", "email", "phone", "active", "start_date", "end_date", "status",
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dirty row per order, with the order key as ``k``."""
    k = F.col("o_orderkey")

    def every(n: int) -> Column:
        return k % n == 0

    p = F.col("o_orderpriority")
    return read(spark, sf_dir, "orders").select(
        k.alias("k"),
        F.concat(F.lit("TX-"), (k % 14000).cast("string")).alias("order_id"),
        F.when(every(17), None).when(every(101), F.col("o_totalprice") * 50).otherwise(F.col("o_totalprice")).alias("total"),
        F.when(every(23), "invalid").otherwise(F.col("o_custkey").cast("string")).alias("qty_txt"),
        F.when(every(29), "bad-date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_txt"),
        F.when(k % 5 == 0, p).when(k % 5 == 1, F.lower(p)).when(k % 5 == 2, F.upper(p))
        .when(k % 5 == 3, F.concat(F.lit(" "), p)).otherwise(F.substring(p, F.lit(1), F.length(p) - 1)).alias("priority_txt"),
        F.when(every(37), "not-an-email").when(every(41), None)
        .otherwise(F.concat(F.lit("user"), F.col("o_custkey").cast("string"), F.lit("@example.com"))).alias("email"),
        F.when(every(43), "12").otherwise(F.concat(F.lit("+1 555 "), (F.col("o_custkey") + 1000000).cast("string"))).alias("phone"),
        F.when(every(3), "yes").otherwise("no").alias("active"),
        F.col("o_orderdate").alias("start_date"),
        (F.col("o_orderdate") + F.make_dt_interval(((k % 11) - 2).cast("int"))).alias("end_date"),
        F.col("o_orderstatus").alias("status"),
    )


def dirty_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty table with its repeated rows and a unique ``row_id`` that orders them."""
    base = dirty_base(spark, sf_dir)
    first = base.withColumn("row_id", F.col("k") * 2)
    again = base.where(F.col("k") % 50 == 0).withColumn("row_id", F.col("k") * 2 + 1)
    return first.unionByName(again).drop("k")


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty table as a user would see it."""
    return dirty_keyed(spark, sf_dir).drop("row_id")


DIRTY_BASE_SQL = """
  SELECT o_orderkey AS k,
    'TX-' || CAST(o_orderkey % 14000 AS VARCHAR) AS order_id,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS total,
    CASE WHEN o_orderkey % 23 = 0 THEN 'invalid' ELSE CAST(o_custkey AS VARCHAR) END AS qty_txt,
    CASE WHEN o_orderkey % 29 = 0 THEN 'bad-date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_txt,
    CASE o_orderkey % 5 WHEN 0 THEN o_orderpriority WHEN 1 THEN lower(o_orderpriority) WHEN 2 THEN upper(o_orderpriority)
      WHEN 3 THEN ' ' || o_orderpriority ELSE substr(o_orderpriority, 1, length(o_orderpriority) - 1) END AS priority_txt,
    CASE WHEN o_orderkey % 37 = 0 THEN 'not-an-email' WHEN o_orderkey % 41 = 0 THEN NULL
      ELSE 'user' || CAST(o_custkey AS VARCHAR) || '@example.com' END AS email,
    CASE WHEN o_orderkey % 43 = 0 THEN '12' ELSE '+1 555 ' || CAST(1000000 + o_custkey AS VARCHAR) END AS phone,
    CASE WHEN o_orderkey % 3 = 0 THEN 'yes' ELSE 'no' END AS active,
    o_orderdate AS start_date,
    o_orderdate + to_days(CAST((o_orderkey % 11) - 2 AS INTEGER)) AS end_date,
    o_orderstatus AS status
  FROM orders"""

DIRTY_CTES = f"""base AS ({DIRTY_BASE_SQL}),
keyed AS (SELECT * EXCLUDE (k), k * 2 AS row_id FROM base
  UNION ALL SELECT * EXCLUDE (k), k * 2 + 1 AS row_id FROM base WHERE k % 50 = 0),
d AS (SELECT * EXCLUDE (row_id) FROM keyed)"""
