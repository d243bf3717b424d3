"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> Column:
    """Unix seconds of a timestamp as written, whatever the session's zone."""
    return F.expr(f"cast(datediff({ts}, date'1970-01-01') as bigint) * 86400 + hour({ts}) * 3600 + minute({ts}) * 60 + second({ts})")


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits, parts as paths, suppliers as authors; a tenth of the
    lines are binary touches (no counts)."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    dated = orders.select(F.col("o_orderkey").alias("oid"), seconds("o_orderdate").alias("committed_at"))
    binary = F.col("l_partkey") % 10 == 0
    rows = lines.select(
        F.col("l_orderkey").alias("oid"),
        F.col("l_suppkey").alias("author_key"),
        F.col("l_partkey").alias("path"),
        F.when(~binary, F.col("l_quantity").cast("long")).alias("added"),
        F.when(~binary, F.col("l_linenumber").cast("long")).alias("deleted"),
    )
    return rows.join(dated, "oid")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as results: event type is the metric, the user's third the regime;
    purchases are flags, every 11th event an absence."""
    e = table(spark, sf_dir, "events")
    absent, flag = F.col("event_id") % 11 == 0, F.col("event_type") == "purchase"
    return e.select(
        "event_id",
        F.col("event_type").alias("metric_id"),
        F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("regime_label"),
        F.when(absent, "text").when(flag, "flag").otherwise("ratio").alias("kind"),
        F.when(~absent & ~flag, F.col("value")).alias("number"),
        F.when(~absent & flag, F.col("value") > 50).alias("flag"),
    )


TOUCHES_SQL = """touches AS (SELECT l_orderkey AS oid, l_suppkey AS author_key, l_partkey AS path, epoch(o_orderdate)::BIGINT AS committed_at,
  CASE WHEN l_partkey % 10 <> 0 THEN l_quantity::BIGINT END AS added, CASE WHEN l_partkey % 10 <> 0 THEN l_linenumber::BIGINT END AS deleted
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

RESULTS_SQL = """results AS (SELECT event_id, event_type AS metric_id, 'r' || (user_id % 3)::VARCHAR AS regime_label,
  CASE WHEN event_id % 11 = 0 THEN 'text' WHEN event_type = 'purchase' THEN 'flag' ELSE 'ratio' END AS kind,
  CASE WHEN event_id % 11 <> 0 AND event_type <> 'purchase' THEN value END AS number,
  CASE WHEN event_id % 11 <> 0 AND event_type = 'purchase' THEN value > 50 END AS flag FROM events)"""
