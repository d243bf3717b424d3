"""Queries of the ledger family."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.operators import evidence, ledger, ordering
from changeloom.plans.inputs import RESULTS_SQL, results, seconds, table

SINCE, UNTIL = 1704672000, 1705881600  # 2024-01-08 and 2024-01-22, both included


def ledger_slice(spark, d):
    e = table(spark, d, "events").select(F.nullif("event_type", F.lit("view")).alias("source"), F.concat(F.lit("v"), (F.col("user_id") % 4).cast("string")).alias("verdict"))
    return ledger.slice_by(e, "source")


def dimension_filter(spark, d):
    e = table(spark, d, "events").select("event_id", F.nullif("event_type", F.lit("view")).alias("source"))
    return ledger.where(e, "source=(unrecorded)").select("event_id")


def distribution_by_regime(spark, d):
    return ledger.distribution(results(spark, d), across_regimes=True)


def cluster_warning(spark, d):
    lines = table(spark, d, "lineitem")
    values = lines.select(F.lit("quantity").alias("metric_id"), F.col("l_returnflag").alias("regime_label"), F.lit("count").alias("kind"), F.when(F.col("l_quantity") > 30, 30.0 - F.col("l_linenumber") % 3 - 1).otherwise(F.col("l_quantity")).alias("number"))
    rungs = spark.createDataFrame([("quantity", "count", 10.0), ("quantity", "count", 30.0), ("quantity", "count", 45.0)], "metric_id string, kind string, at double")
    return ledger.clustering(values, rungs, min_share=0.3)


def report_window(spark, d):
    e = table(spark, d, "events").select(
        F.when(F.col("event_id") % 13 != 0, seconds("ts")).alias("stamp"),
        (F.col("event_type") != "view").alias("self_report"),
        F.col("user_id").alias("head_oid"),
        (F.col("value") > 60).alias("med_plus"),
        (F.col("value") > 95).alias("escalated"),
    )
    return ledger.report_window(e, F.lit(SINCE), F.lit(UNTIL))


def split_families(spark, d):
    r = results(spark, d).select(F.col("metric_id").alias("family"), F.when(F.col("metric_id") == "click", F.lit("r0")).otherwise(F.col("regime_label")).alias("regime_label"))
    return ledger.split_families(r)


def cat_sort_uniq(spark, d):
    c = table(spark, d, "conversations").select(F.col("text").alias("line"))
    return ledger.merge_lines(c, c.union(table(spark, d, "region").select(F.col("r_name"))))


def squash_migrate(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return ledger.migrate(c.filter("turn % 2 = 0"), c.filter("conv_id % 3 = 0"), ["conv_id", "turn"])


def worst_of(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.floor(F.col("value") / 10).cast("long").alias("rank"))
    return ledger.worst_of(e, ["user_id"], "rank", "event_id")


def expiry_stagger(spark, d):
    return evidence.expiring(table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("expiry")), 18)


def topk_findings(spark, d):
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("low")
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("record"),
        severity.alias("severity"),
        F.when(F.col("o_orderstatus") == "O", "diff-actionable").otherwise("context-informational").alias("metric_class"),
        F.date_format("o_orderdate", "yyyy-MM").alias("metric_id"),
        F.col("o_orderkey").alias("scope_label"),
    )
    return ordering.top_of_each(o, ["record"], ordering.worst_first(o), 3).withColumn("rank", F.col("rank").cast("long"))


def bounded_bytes(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    out = ordering.byte_prefix(c, ["conv_id"], [F.col("turn")], "text", 300)
    return out.select("conv_id", "turn", F.col("running_bytes"))


QUERIES = {
    f.__name__: f
    for f in (ledger_slice, dimension_filter, distribution_by_regime, cluster_warning, report_window, split_families, cat_sort_uniq, squash_migrate, worst_of, expiry_stagger, topk_findings, bounded_bytes)
}
_SUMMARY = """count(CASE WHEN kind = 'ratio' THEN number END) AS numeric, min(number) AS min, max(number) AS max, round(avg(number), 6) AS mean,
  count(*) FILTER (WHERE kind = 'flag' AND flag) AS fired, count(*) FILTER (WHERE kind = 'flag' AND NOT flag) AS unfired, count(*) FILTER (WHERE kind = 'text') AS absent"""
ORACLES = {
    "ledger_slice": "SELECT CASE WHEN event_type = 'view' THEN '(unrecorded)' ELSE event_type END AS value, 'v' || (user_id % 4) AS verdict, count(*) AS records FROM events GROUP BY ALL",
    "dimension_filter": "SELECT event_id FROM events WHERE event_type = 'view'",
    "distribution_by_regime": f"""
WITH {RESULTS_SQL}, n AS (SELECT metric_id, count(DISTINCT regime_label) AS regimes FROM results GROUP BY metric_id)
SELECT metric_id, regime_label, {_SUMMARY}, any_value(regimes) AS regimes, regime_label IS NULL AS mixed
FROM results JOIN n USING (metric_id) GROUP BY GROUPING SETS ((metric_id, regime_label), (metric_id)) HAVING regime_label IS NOT NULL OR any_value(regimes) > 1""",
    "cluster_warning": """
WITH v AS (SELECT l_returnflag AS regime_label, CASE WHEN l_quantity > 30 THEN 30.0 - l_linenumber % 3 - 1 ELSE l_quantity END AS number FROM lineitem),
r("at", lo) AS (VALUES (10.0::DOUBLE, 9.0::DOUBLE), (30.0, 27.0), (45.0, 40.5))
SELECT 'quantity' AS metric_id, regime_label, "at", count(*) FILTER (WHERE number >= lo AND number < "at") AS in_band, count(*) AS total
FROM v, r WHERE number <> 0 GROUP BY regime_label, "at" HAVING count(*) FILTER (WHERE number >= lo AND number < "at") >= greatest(5, 0.3 * count(*))""",
    "report_window": f"""
WITH e AS (SELECT CASE WHEN event_id % 13 <> 0 THEN floor(epoch(ts))::BIGINT END AS stamp, event_type <> 'view' AS own, user_id, value FROM events),
i AS (SELECT * FROM e WHERE own AND stamp BETWEEN {SINCE} AND {UNTIL}),
x AS (SELECT (SELECT count(*) FROM i) AS in_window, (SELECT count(*) FROM e WHERE own AND stamp IS NULL) AS undated, (SELECT count(*) FROM e WHERE NOT own) AS non_self,
  (SELECT count(DISTINCT user_id) FROM i) AS changes, (SELECT count(DISTINCT user_id) FROM i WHERE value > 60) AS med_plus_changes, (SELECT count(*) FROM i WHERE value > 95) AS escalations)
SELECT *, round(escalations / (({UNTIL} - {SINCE}) / 86400.0 / 7.0), 6) AS escalations_per_week, round(med_plus_changes / nullif(changes, 0), 6) AS med_plus_rate FROM x""",
    "split_families": "SELECT event_type AS family, count(DISTINCT user_id % 3) AS regimes FROM events WHERE event_type <> 'click' GROUP BY event_type HAVING count(DISTINCT user_id % 3) > 1",
    "cat_sort_uniq": "SELECT text AS line FROM conversations UNION SELECT r_name FROM region",
    "squash_migrate": "SELECT conv_id, turn, length(text) AS size FROM conversations WHERE turn % 2 = 0 OR conv_id % 3 = 0",
    "worst_of": "SELECT user_id, event_id, floor(value / 10)::BIGINT AS rank FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY floor(value / 10) DESC, event_id) = 1",
    "expiry_stagger": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS claims FROM orders GROUP BY month HAVING count(*) > 18",
    "topk_findings": """
WITH o AS (SELECT o_custkey AS record, o_orderkey AS scope_label, strftime(o_orderdate, '%Y-%m') AS metric_id, CASE WHEN o_orderstatus = 'O' THEN 'diff-actionable' ELSE 'context-informational' END AS metric_class,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS severity, least(4, left(o_orderpriority, 1)::INT) AS k FROM orders)
SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY record ORDER BY k, metric_class = 'context-informational', metric_id, scope_label) AS rank FROM o QUALIFY rank <= 3""",
    "bounded_bytes": "SELECT conv_id, turn, (sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS running_bytes FROM conversations QUALIFY running_bytes <= 300",
}
