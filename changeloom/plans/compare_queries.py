"""Queries of the comparison and registry families."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.operators import compare, evidence
from changeloom.plans.inputs import table

#: Two legs of the same measurements with drift between them: the report lacks
#: every 17th order, the recomputation every 19th; digests differ at every 23rd,
#: regimes at every 29th customer. Scope is null for finished orders.
LEGS_SQL = """o AS (SELECT o_custkey AS record, o_orderpriority AS metric_id, CASE WHEN o_orderstatus <> 'F' THEN o_orderkey::VARCHAR END AS scope, o_orderkey, o_custkey FROM orders),
r AS (SELECT record, metric_id, scope, min_by(CASE WHEN o_orderkey % 23 = 0 THEN 'x' ELSE 'd' END || o_orderkey, o_orderkey) AS digest, CASE WHEN record % 29 = 0 THEN 'old' ELSE 'now' END AS regime FROM o WHERE o_orderkey % 17 <> 0 GROUP BY ALL),
v AS (SELECT record, metric_id, scope, min_by('d' || o_orderkey, o_orderkey) AS digest, 'now' AS regime, (min(o_orderkey) % 31 <> 0) AS deterministic FROM o WHERE o_orderkey % 19 <> 0 GROUP BY ALL)"""


def _legs(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("record"),
        F.col("o_orderpriority").alias("metric_id"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey").cast("string")).alias("scope"),
        "o_orderkey",
    )
    key = ["record", "metric_id", "scope"]
    said = F.concat(F.when(F.col("o_orderkey") % 23 == 0, "x").otherwise("d"), F.col("o_orderkey").cast("string"))
    old = F.when(F.col("record") % 29 == 0, "old").otherwise("now")
    report = compare.first_of_key(o.filter("o_orderkey % 17 <> 0").select(*key, "o_orderkey", said.alias("digest"), old.alias("regime"), F.lit(True).alias("deterministic")), key, "o_orderkey")
    again = o.filter("o_orderkey % 19 <> 0").select(*key, "o_orderkey", F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("digest"), F.lit("now").alias("regime"), (F.col("o_orderkey") % 31 != 0).alias("deterministic"))
    return report, compare.first_of_key(again, key, "o_orderkey"), key


def digest_pairing(spark, d):
    report, again, key = _legs(spark, d)
    return compare.paired(report, again, key).select(*[F.col(f"v_{c}").alias(c) for c in key], (F.col("r_digest") == F.col("v_digest")).alias("equal"))


def unpaired_ids(spark, d):
    report, again, key = _legs(spark, d)
    return compare.unpaired(report, again, key, "record")


def recompute_unwitnessed(spark, d):
    report, again, key = _legs(spark, d)
    return compare.unwitnessed(report, again, key).select("v.record", "v.metric_id", "v.scope")


def attestation(spark, d):
    report, again, _ = _legs(spark, d)
    facts = compare.compare_records(report, again, "record", ["metric_id", "scope"])
    relation = F.when(F.col("record") % 13 == 0, "ancestor").when(F.col("record") % 37 == 0, "not-ancestor").otherwise("equal")
    no, yes = F.lit(False), F.lit(True)
    return facts.select(
        "record",
        compare.classify(F.col("record") % 41 == 0, F.col("record") % 43 != 0, no, relation, yes, F.col("regime_equal"), F.col("mismatched"), F.col("pairs"), F.col("missing")).alias("attestation"),
    )


_ATTESTATION_SQL = f"""WITH {LEGS_SQL}, p AS (SELECT v.record, v.deterministic, r.digest AS rd, v.digest AS vd, r.regime AS rr FROM v LEFT JOIN r ON v.record = r.record AND v.metric_id = r.metric_id AND v.scope IS NOT DISTINCT FROM r.scope),
f AS (SELECT record, count(rd) AS pairs, coalesce(bool_and(rr = 'now'), true) AS same, count(*) FILTER (WHERE deterministic AND rd <> vd) AS mismatched, count(*) FILTER (WHERE deterministic AND rd IS NULL) AS missing FROM p GROUP BY record),
t AS (SELECT record, CASE WHEN record % 41 = 0 THEN 'unwitnessed-uncommitted' WHEN record % 43 = 0 THEN 'unwitnessed' WHEN record % 13 = 0 THEN 'unwitnessed-base-mismatch' WHEN record % 37 = 0 THEN 'divergent'
  WHEN NOT same THEN 'unwitnessed-version-skew' WHEN mismatched > 0 THEN 'divergent' WHEN pairs = 0 OR missing > 0 THEN 'unwitnessed' ELSE 'confirmed' END AS attestation FROM f)"""


def decided_heads(spark, d):
    heads = attestation(spark, d).select((F.col("record") % 20).alias("head_oid"), "attestation", F.col("record").alias("ordinal"))
    return compare.decide(heads, skews=8)


def n_leg_compare(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("low"))
    base = lines.select(F.col("l_orderkey").alias("metric_id"), F.when(F.col("low") == 1, F.col("n")).alias("scope"), F.concat(F.lit("h"), F.col("n").cast("string")).alias("digest"))
    odd = base.withColumn("digest", F.when(F.col("metric_id") % 50 == 0, "other").otherwise(F.col("digest")))
    return compare.n_legs({"linux": base, "macos": odd.filter("metric_id % 70 <> 0"), "windows": base}, ["metric_id", "scope"])


def evidence_join(spark, d):
    results = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("metric_id"))
    metrics = table(spark, d, "nation").select(F.col("n_nationkey").alias("metric_id"), F.col("n_regionkey").alias("claim_id"))
    claims = table(spark, d, "region").filter("r_regionkey <> 3").select(
        F.col("r_regionkey").alias("claim_id"),
        F.substring("r_name", 1, 1).alias("tier"),
        F.col("r_name").alias("citation"),
        F.array(F.lit("defects")).alias("does_not_predict"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("r_regionkey") * 100).alias("expiry"),
    )
    return evidence.resolve(results, metrics, claims, F.lit("2024-06-01").cast("date")).select("c_custkey", "tier", "citation", "stale")


def registry_integrity(spark, d):
    metrics = table(spark, d, "nation").select((F.col("n_nationkey") % 22).alias("metric_id"), F.concat(F.lit("claim-"), F.col("n_regionkey").cast("string")).alias("claim_id"))
    claims = table(spark, d, "customer").select(F.concat(F.lit("claim-"), (F.col("c_custkey") % 40 + 2).cast("string")).alias("claim_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")).alias("expiry")).filter("claim_id <> 'claim-4'")
    return evidence.integrity(metrics, claims, F.lit("2024-02-01").cast("date"), budget=100, a_month=20)


def engine_conformance(spark, d):
    p = table(spark, d, "part")
    declared = p.filter("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("metric_id"), F.col("p_brand").alias("class"), (F.col("p_size") > 10).alias("deterministic"))
    known = p.filter("p_partkey % 8 <> 0").select(F.col("p_partkey").alias("metric_id"), F.when(F.col("p_partkey") % 15 == 0, "other").otherwise(F.col("p_brand")).alias("class"), (F.col("p_size") > 12).alias("deterministic"))
    return evidence.conformance(declared, known, ["class", "deterministic"])


def engine_accounting(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("engine_id"))
    return evidence.accounting(s.filter("engine_id % 7 <> 0"), s.filter("engine_id % 3 <> 0"), s.filter("engine_id % 5 = 0"))


def confusion_matrix(spark, d):
    labels = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id", "text", "n_chars")
    both = labels.join(docs, "doc_id")
    cases = both.select(F.col("doc_id").alias("id"), F.array_compact(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "poor"))).alias("expect"))
    detectors = spark.createDataFrame([("toxic",), ("poor",), ("never",)], "signal string")
    fired = both.filter(F.contains("text", F.lit("idiot"))).select(F.col("doc_id").alias("id"), F.lit("toxic").alias("signal"))
    fired = fired.union(both.filter("n_chars < 600").select("doc_id", F.lit("poor")))
    return evidence.confusion(cases, detectors, fired)


QUERIES = {
    f.__name__: f
    for f in (digest_pairing, unpaired_ids, recompute_unwitnessed, attestation, decided_heads, n_leg_compare, evidence_join, registry_integrity, engine_conformance, engine_accounting, confusion_matrix)
}
ORACLES = {
    "digest_pairing": f"WITH {LEGS_SQL} SELECT v.record, v.metric_id, v.scope, r.digest = v.digest AS equal FROM r JOIN v ON v.record = r.record AND v.metric_id = r.metric_id AND v.scope IS NOT DISTINCT FROM r.scope",
    "unpaired_ids": f"WITH {LEGS_SQL} SELECT DISTINCT record FROM ((SELECT record, metric_id, scope FROM r EXCEPT SELECT record, metric_id, scope FROM v) UNION ALL (SELECT record, metric_id, scope FROM v EXCEPT SELECT record, metric_id, scope FROM r))",
    "recompute_unwitnessed": f"WITH {LEGS_SQL} SELECT record, metric_id, scope FROM v WHERE deterministic EXCEPT SELECT record, metric_id, scope FROM r",
    "attestation": f"{_ATTESTATION_SQL} SELECT record, attestation FROM t",
    "decided_heads": f"""{_ATTESTATION_SQL}, k(attestation, rank) AS (VALUES ('confirmed', 0), ('unwitnessed', 2), ('unwitnessed-version-skew', 3), ('unwitnessed-base-mismatch', 4), ('unwitnessed-uncommitted', 5), ('divergent', 6)),
g AS (SELECT record % 20 AS head_oid, arg_max(attestation, rank) AS attestation, count(*) FILTER (WHERE attestation IN ('unwitnessed-version-skew', 'unwitnessed-base-mismatch')) >= 8 AS escalated FROM t JOIN k USING (attestation) GROUP BY 1)
SELECT *, CASE WHEN attestation = 'divergent' THEN 'block' WHEN escalated THEN 'escalate_to_human' WHEN attestation LIKE 'confirmed%' THEN 'pass' ELSE 'advise' END AS verdict FROM g""",
    "n_leg_compare": """
WITH b AS (SELECT l_orderkey AS metric_id, CASE WHEN min(l_linenumber) = 1 THEN count(*) END AS scope FROM lineitem GROUP BY l_orderkey)
SELECT metric_id, scope, CASE WHEN metric_id % 70 = 0 THEN 2 ELSE 3 END::BIGINT AS present, CASE WHEN metric_id % 50 = 0 AND metric_id % 70 <> 0 THEN 2 ELSE 1 END::BIGINT AS digests, metric_id % 70 <> 0 AND metric_id % 50 <> 0 AS agreed FROM b""",
    "evidence_join": "SELECT c_custkey, left(r_name, 1) AS tier, r_name AS citation, DATE '2024-06-01' > DATE '2024-01-01' + r_regionkey * 100 AS stale FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey <> 3",
    "registry_integrity": """
WITH m AS (SELECT n_nationkey % 22 AS metric_id, 'claim-' || n_regionkey AS claim_id FROM nation), c AS (SELECT 'claim-' || (c_custkey % 40 + 2) AS claim_id, DATE '2024-01-01' + (c_custkey % 300)::INT AS expiry FROM customer WHERE c_custkey % 40 + 2 <> 4)
SELECT 'registry.unmapped-metric' AS code, metric_id::VARCHAR AS subject, true AS fatal FROM m WHERE claim_id NOT IN (SELECT claim_id FROM c)
UNION ALL SELECT 'registry.unused-claim', claim_id, false FROM c WHERE claim_id NOT IN (SELECT claim_id FROM m)
UNION ALL SELECT 'registry.duplicate-metric', metric_id::VARCHAR, true FROM m GROUP BY metric_id HAVING count(*) > 1
UNION ALL SELECT 'registry.duplicate-claim', claim_id, true FROM c GROUP BY claim_id HAVING count(*) > 1
UNION ALL SELECT 'registry.stale-claim', claim_id, false FROM c WHERE DATE '2024-02-01' > expiry
UNION ALL SELECT 'registry.expiry-stagger', strftime(expiry, '%Y-%m'), false FROM c GROUP BY strftime(expiry, '%Y-%m') HAVING count(*) > 20
UNION ALL SELECT 'registry.claim-budget', count(*)::VARCHAR, true FROM c HAVING count(*) > 100""",
    "engine_conformance": """
WITH a AS (SELECT p_partkey AS metric_id, p_brand AS class, p_size > 10 AS det FROM part WHERE p_partkey % 9 <> 0), b AS (SELECT p_partkey AS metric_id, CASE WHEN p_partkey % 15 = 0 THEN 'other' ELSE p_brand END AS class, p_size > 12 AS det FROM part WHERE p_partkey % 8 <> 0)
SELECT coalesce(a.metric_id, b.metric_id) AS metric_id, a.metric_id IS NOT NULL AS in_engine, b.metric_id IS NOT NULL AS in_registry, a.metric_id IS NOT NULL AND b.metric_id IS NOT NULL AS differs
FROM a FULL JOIN b ON a.metric_id = b.metric_id WHERE a.metric_id IS NULL OR b.metric_id IS NULL OR a.class <> b.class OR a.det <> b.det""",
    "engine_accounting": "SELECT c_custkey AS engine_id, c_custkey % 7 <> 0 AS expected, ((c_custkey % 3 <> 0)::INT + (c_custkey % 5 = 0)::INT)::BIGINT AS times FROM customer WHERE (c_custkey % 7 <> 0 OR c_custkey % 3 <> 0 OR c_custkey % 5 = 0) AND NOT (c_custkey % 7 <> 0 AND (c_custkey % 3 <> 0)::INT + (c_custkey % 5 = 0)::INT = 1)",
    "confusion_matrix": """
WITH b AS (SELECT doc_id, toxic = 1 AS t, quality = 0 AS p, contains(text, 'idiot') AS ht, n_chars < 600 AS hp FROM labels JOIN documents USING (doc_id)),
g AS (SELECT 'toxic' AS signal, coalesce(t, false) AS want, ht AS hit, coalesce(t, false) OR coalesce(p, false) AS adv FROM b UNION ALL SELECT 'poor', coalesce(p, false), hp, coalesce(t, false) OR coalesce(p, false) FROM b UNION ALL SELECT 'never', false, false, coalesce(t, false) OR coalesce(p, false) FROM b),
c AS (SELECT signal, count(*) FILTER (WHERE want AND hit) AS tp, count(*) FILTER (WHERE NOT adv AND hit) AS fp, count(*) FILTER (WHERE want AND NOT hit) AS fn, count(*) FILTER (WHERE NOT adv AND NOT hit) AS tn, count(*) FILTER (WHERE adv AND NOT want AND hit) AS cross_fires FROM g GROUP BY signal)
SELECT *, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall FROM c""",
}
