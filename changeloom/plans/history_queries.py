"""Queries of the history family."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.operators import history, ledger
from changeloom.plans.inputs import TOUCHES_SQL, seconds, table, touches

WINDOW = 365


def churn_by_path(spark, d):
    t = touches(spark, d)
    anchor = t.agg(F.max("committed_at").alias("anchor"))  # one row
    inside = history.in_window(t.join(F.broadcast(anchor), F.lit(True)), F.col("anchor"), WINDOW)
    paths = table(spark, d, "part").select(F.col("p_partkey").alias("path"))
    out = history.path_history(inside, paths).join(F.broadcast(anchor), F.lit(True))
    return out.withColumn("age_days", history.age_days(F.col("anchor"), F.col("last_at"))).drop("anchor")


def ownership_entropy(spark, d):
    return history.ownership_entropy(touches(spark, d))


def hotspot(spark, d):
    h = history.path_history(touches(spark, d)).select("path", "commits")
    return history.hotspots(h, table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("complexity")))


def change_coupling(spark, d):
    t = touches(spark, d).select("oid", "path")
    return history.coupled_absent(t.withColumn("path", F.col("path") % 60), t.filter("path % 60 < 15").select((F.col("path") % 60).alias("path")), max_paths=6)


def landing_time(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("line"), seconds("ts").alias("committed_at"), "event_type")
    landed = history.landing_times(e.filter("event_type <> 'view'"))
    records = table(spark, d, "customer").select(F.col("c_custkey").alias("line"))
    return ledger.stamped(records, landed).withColumn("undated", F.col("landed_at").isNull())


def p95_quantity(spark, d):
    return ledger.p95(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])


QUERIES = {f.__name__: f for f in (churn_by_path, ownership_entropy, hotspot, change_coupling, landing_time, p95_quantity)}
ORACLES = {
    "churn_by_path": f"""
WITH {TOUCHES_SQL}, a AS (SELECT max(committed_at) AS anchor FROM touches),
h AS (SELECT path, count(*) AS commits, coalesce(sum(added + deleted), 0)::BIGINT AS churn_lines, count(added) AS text_touches, count(*) - count(added) AS binary_touches, max(committed_at) AS last_at
  FROM touches, a WHERE committed_at >= anchor - {WINDOW} * 86400 GROUP BY path)
SELECT p_partkey AS path, coalesce(commits, 0) AS commits, coalesce(churn_lines, 0) AS churn_lines, coalesce(text_touches, 0) AS text_touches, coalesce(binary_touches, 0) AS binary_touches, last_at,
  greatest(0, (anchor - last_at) // 86400) * (CASE WHEN last_at IS NULL THEN NULL ELSE 1 END) AS age_days
FROM part CROSS JOIN a LEFT JOIN h ON path = p_partkey""",
    "ownership_entropy": f"""
WITH {TOUCHES_SQL}, c AS (SELECT path, author_key, count(*) AS n FROM touches GROUP BY ALL), t AS (SELECT path, sum(n)::BIGINT AS touches, count(*) AS owners FROM c GROUP BY path)
SELECT path, t.touches, t.owners, round(greatest(0, -sum(n / t.touches * log2(n / t.touches))), 6) AS entropy FROM c JOIN t USING (path) GROUP BY path, t.touches, t.owners""",
    "hotspot": f"""
WITH {TOUCHES_SQL} SELECT path, count(*) AS commits, max(CASE WHEN p_size > 10 THEN p_size END) AS complexity, count(*) * max(CASE WHEN p_size > 10 THEN p_size END) AS hotspot
FROM touches JOIN part ON p_partkey = path GROUP BY path""",
    "change_coupling": """
WITH t AS (SELECT DISTINCT l_orderkey AS oid, l_partkey % 60 AS path FROM lineitem),
s AS (SELECT * FROM t WHERE oid IN (SELECT oid FROM t GROUP BY oid HAVING count(*) <= 6)),
e AS (SELECT path, count(*) AS n FROM s WHERE path < 15 GROUP BY path),
p AS (SELECT a.path AS target, b.path AS partner, count(*) AS k FROM s a JOIN s b USING (oid) WHERE a.path < 15 AND b.path >= 15 GROUP BY ALL HAVING count(*) >= 3)
SELECT w.path AS target, (SELECT count(*) FROM p JOIN e ON e.path = p.target WHERE p.target = w.path AND 2 * k >= n) AS coupled_absent
FROM (SELECT DISTINCT path FROM t WHERE path < 15) w""",
    "landing_time": """
SELECT c_custkey AS line, min(floor(epoch(ts))::BIGINT) AS landed_at, min(ts) IS NULL AS undated
FROM customer LEFT JOIN events ON user_id = c_custkey AND event_type <> 'view' GROUP BY c_custkey""",
    "p95_quantity": """
SELECT l_returnflag, l_linestatus, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY ALL""",
}
