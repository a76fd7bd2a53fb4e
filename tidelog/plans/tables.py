"""The change logs and keyspaces that the queries derive from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.codecs import padded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' last values: an error deletes, everything else puts; five events are a commit, views come from triggers."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("usr/"), padded(F.col("user_id"), 8)).alias("key"), (n + 1).alias("seqno"), (F.floor(n / 5) * 5 + 5).cast("long").alias("commit_seqno"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("kind"), F.round(F.col("value") * 100).cast("long").alias("value"),
        F.when(F.col("event_type") == "view", "trigger").otherwise("user").alias("origin"), "event_type",
    )


EVENT_LOG = """
WITH log AS (SELECT 'usr/' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, event_id + 1 AS seqno, (event_id // 5) * 5 + 5 AS commit_seqno,
  CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS kind, CAST(round(value * 100) AS BIGINT) AS value,
  CASE WHEN event_type = 'view' THEN 'trigger' ELSE 'user' END AS origin, event_type FROM events)
"""


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under 'orders/<8 digits>'."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("orders/"), padded(F.col("o_orderkey"), 8)).alias("key"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.col("o_orderstatus").alias("status"),
    )


ORDERS = """
WITH recs AS (SELECT 'orders/' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS key, o_orderkey AS id, o_custkey AS customer,
  CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderstatus AS status FROM orders)
"""
