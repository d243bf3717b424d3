"""Queries of the change-set, rule, clone and detector families."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.functions import canonical, scalars
from changeloom.operators import changes, clones, detectors, ordering, rules
from changeloom.plans.inputs import table
from changeloom.streaming import iteration

MARKERS = ["token =", "licensed under", "@mail"]


def excluded_paths(spark, d):
    kept, withheld = changes.split_excluded(table(spark, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path")), ["site1.example.com/**", "site2.example.com"])
    return kept.withColumn("kept", F.lit(True)).union(withheld.withColumn("kept", F.lit(False)))


def overlay_merge(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("path"), F.col("c_mktsegment").alias("seg"))
    committed = c.filter("path % 2 = 0").select("path", F.when(F.col("path") % 6 != 0, F.col("seg")).alias("base_oid"), F.when(F.col("path") % 8 != 0, F.concat(F.lit("c"), F.col("seg"))).alias("head_oid"))
    dirty = c.filter("path % 3 = 0").select("path", F.when(F.col("path") % 5 != 0, F.col("seg")).alias("base_oid"), F.when(F.col("path") % 4 != 0, F.concat(F.lit("d"), F.col("seg"))).alias("head_oid"))
    return changes.overlay(committed, dirty)


def key_moves(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.explode(F.create_map(F.lit("brand"), "p_brand", F.lit("size"), F.col("p_size").cast("string"))).alias("key", "value"))
    head = p.filter("p_partkey % 5 <> 0 OR key = 'size'").withColumn("value", F.when(F.col("p_partkey") % 3 == 0, F.concat("value", F.lit("!"))).when(F.col("p_partkey") % 7 != 0, F.col("value")))
    return changes.key_moves(p, head, ["p_partkey", "key"])


def value_labels(spark, d):
    e = table(spark, d, "events")
    kind = F.element_at(F.array(*map(F.lit, ("integer", "count", "duration", "flag", "text"))), (F.col("event_id") % 5 + 1).cast("int"))
    value = F.struct(kind.alias("kind"), (F.col("event_id") % 301 - 150).alias("value_long"), F.lit(0.5).alias("value_double"), (F.col("user_id") % 2 == 0).alias("value_bool"), F.col("event_type").alias("value_text"))
    span = F.when(F.col("event_id") % 4 == 0, F.struct(F.col("user_id").alias("start")))
    scope = F.struct(F.lit("change").alias("kind"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("path"), F.when(F.col("event_id") % 2 == 0, F.lit("f")).alias("symbol"), span.alias("line_span"))
    rows = e.withColumns({"v": value, "s": scope})
    return rows.select("event_id", scalars.value_label(F.col("v")).alias("value_label"), scalars.scope_label(F.col("s")).alias("scope_label"))


def regime_labels(spark, d):
    c, null = table(spark, d, "customer"), lambda t: F.lit(None).cast(t)
    family = F.element_at(F.array(*map(F.lit, ("process", "tamper", "clones", "static"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    text = F.col("c_nationkey").cast("string")
    grammars = F.create_map(F.lit("rust"), text, F.lit("python"), F.col("c_mktsegment"))
    fields = dict(
        family=family, engine_version=F.lit("2"), spec_revision=text, grammars=grammars, algorithm=F.lit("hash"), min_tokens=F.col("c_nationkey"), window_tokens=F.lit(25), normalization_revision=text,
        detector_set_revision=text, rule_pack_version=F.col("c_mktsegment"), git_version=text, history_window_days=F.lit(365), parser_versions=null("map<string,string>"), command=null("string"), sandbox=null("string"),
    )
    return c.select("c_custkey", scalars.regime_label(F.struct(*[x.alias(n) for n, x in fields.items()])).alias("label"))


def base_head_delta(spark, d):
    p = table(spark, d, "part")
    head = p.select((F.col("p_partkey") + 1000).alias("path"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).alias("old_path"), F.when(F.col("p_partkey") % 10 == 0, "other").otherwise(F.col("p_brand")).alias("language"), (F.col("p_size") * 2).alias("value"))
    base = p.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("language"), F.col("p_size").alias("value"))
    return changes.deltas(head, base)


def suffix_match_join(spark, d):
    urls = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("covered_path"))
    last = F.element_at(F.split("covered_path", "/"), -1)
    two = F.concat_ws("/", F.slice(F.split("covered_path", "/"), F.size(F.split("covered_path", "/")) - 1, 2))
    wanted = urls.select(F.when(F.col("page_id") % 3 == 0, last).when(F.col("page_id") % 3 == 1, two).otherwise(F.col("covered_path")).alias("path")).filter("path <> ''").distinct()
    return changes.match_paths(wanted, urls.select("covered_path"))


def uncovered_lines(spark, d):
    l = table(spark, d, "lineitem")
    reports = l.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), F.when(F.col("l_quantity") < 20, 0).otherwise(1).alias("hits"), (F.col("l_orderkey") % 3).alias("priority"))
    other = reports.filter("path % 4 = 0").withColumn("hits", F.lit(0)).withColumn("priority", F.lit(1).cast("long"))
    touched = l.filter("l_linenumber < 4").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line")).union(l.select("l_orderkey", F.lit(99)))
    return changes.uncovered_lines(touched, reports.union(other).groupBy("path", "line", "priority").agg(F.max("hits").alias("hits")))


def multiset_gain(spark, d):
    docs = table(spark, d, "documents")
    lines = docs.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("at", "said"))
    base, head = lines.filter("doc_id % 2 = 0"), lines.filter("doc_id % 2 = 1")
    return changes.multiset_gain(base, head, ["source", "said"], ["doc_id", "at"]).select("source", "doc_id", "at")


def multiset_difference(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("said"))
    gone, new = changes.multiset_difference(lines.filter("doc_id % 2 = 0").select("said"), lines.filter("doc_id % 2 = 1").select("said"))
    return gone.withColumn("side", F.lit("base")).union(new.withColumn("side", F.lit("head")))


def recursive_diff(spark, d):
    e = table(spark, d, "events").select("event_id", "props")
    after = e.filter("event_id % 5 <> 0").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"z": {"y": [1, 2]}, "k": 7, "gone": null}'))).otherwise(F.col("props")).alias("props"))
    return changes.json_diff(e.filter("event_id % 7 <> 0"), after, "props", ["event_id"])


def policy_direction(spark, d):
    fields = ["severity.block_on_tamper", "loop.iteration_cap", "sandbox.test_timeout_ms", "severity.max_severity_for_c_tier", "agent.bytes_per_token", "unknown.field"]
    o = table(spark, d, "orders").select("o_orderkey", F.get(F.array(*map(F.lit, fields)), (F.col("o_orderkey") % 6).cast("int")).alias("field"), (F.col("o_custkey") % 5).alias("x"), (F.col("o_orderkey") % 3).alias("y"))
    steps = F.array(*[F.lit(f'"{s}"') for s in ("critical", "high", "medium", "low", "info")])
    said = lambda c: F.when(F.col("field").startswith("severity.block"), F.when(c % 2 == 0, "true").otherwise("false")).when(F.col("field") == "severity.max_severity_for_c_tier", F.get(steps, c.cast("int"))).otherwise(c.cast("string"))
    return o.select("o_orderkey", changes.direction(F.col("field"), said(F.col("x")), said(F.col("y"))).alias("direction"))


def severity_ladder(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.lit("process.churn-lines").alias("metric_id"), (F.col("o_totalprice") / 50).alias("value"))
    by_join = rules.severities(o, rules.ladder_table(spark))
    case = rules.severity_case(F.col("value"), rules.LADDERS["process.churn-lines"])
    return by_join.select("o_orderkey", "severity", (F.col("severity") == case).alias("agree"))


def _results(spark, d):
    """Order lines as results of their order's record."""
    l = table(spark, d, "lineitem")
    family = F.when(F.col("l_partkey") % 40 == 0, "tamper").when(F.col("l_partkey") % 90 == 1, "tests").otherwise("process")
    l = l.withColumn("family", family)
    metric = F.when(F.col("family") == "tamper", F.when(F.col("l_linenumber") > 3, "tamper.threshold-config-edit").otherwise("tamper.test-removal")).when(F.col("family") == "tests", "tests.suite-failure").otherwise("process.hotspot")
    severity = F.when(F.col("l_quantity") >= 48, "high").when(F.col("l_quantity") >= 44, "medium").when(F.col("l_quantity") >= 30, "low").otherwise("info")
    return l.select(
        F.col("l_orderkey").alias("record"),
        F.col("l_linenumber").alias("line"),
        "family",
        metric.alias("metric_id"),
        F.when(F.col("family") == "process", "count").otherwise("flag").alias("kind"),
        F.when(F.col("family") != "process", F.col("l_quantity") > 10).alias("flag"),
        severity.alias("severity"),
        F.when(F.col("l_returnflag") == "R", "partial").otherwise("complete").alias("completeness"),
        F.when(F.col("l_linestatus") == "O", "A").otherwise("C").alias("tier"),
        F.when(F.col("l_suppkey") % 3 == 0, "context-informational").otherwise("diff-actionable").alias("metric_class"),
        (F.col("l_orderkey") % 9 == 0).alias("over_cap"),
        (F.col("l_orderkey") % 2 == 0).alias("justified"),
    )


_RESULTS_SQL = """f AS (SELECT *, CASE WHEN l_partkey % 40 = 0 THEN 'tamper' WHEN l_partkey % 90 = 1 THEN 'tests' ELSE 'process' END AS family FROM lineitem),
x AS (SELECT l_orderkey AS record, l_linenumber AS line, family, l_linenumber > 3 AS edit, family <> 'process' AND l_quantity > 10 AS flag,
 CASE WHEN l_quantity >= 48 THEN 3 WHEN l_quantity >= 44 THEN 2 WHEN l_quantity >= 30 THEN 1 ELSE 0 END AS rank,
 CASE WHEN l_returnflag = 'R' OR l_linestatus <> 'O' OR l_suppkey % 3 = 0 THEN 1 ELSE 4 END AS top, l_returnflag = 'R' AS part, l_suppkey % 3 <> 0 AS act FROM f)"""


def severity_clamp(spark, d):
    return rules.clamp(_results(spark, d), rules.Policy()).select("record", "line", "severity")


def verdict(spark, d):
    clamped = rules.clamp(_results(spark, d), rules.Policy())
    out = rules.verdicts(clamped, ["record"], rules.Policy(), escalated=F.col("over_cap"), justified=F.col("justified"))
    return out.select("record", "verdict", F.array_join("reasons", ",").alias("reasons"), "countable")


def weakest_completeness(spark, d):
    return rules.weakest(_results(spark, d), ["record"])


def fired_signals(spark, d):
    out = rules.fired_signals(_results(spark, d), ["record"], list(detectors.DETECTORS))
    return out.select("record", F.array_join("signals", ",").alias("signals"))


def _streams(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("file"), F.split(F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\x0B\f\r]+", " ")), " ").alias("symbols"))


def ngram_clones(spark, d):
    """Words duplicated in runs of 50 words or more, by document."""
    return clones.duplicated_tokens(_streams(spark, d))


def clone_summary(spark, d):
    return clones.clone_summary(_streams(spark, d))


def longest_run(spark, d):
    e = table(spark, d, "events").select("user_id", F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("day"))
    return clones.longest_run(e, ["user_id"], "day")


def nearest_neighbours(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id")
    return clones.brackets(e, ["user_id"], "event_id")


def suppression_density(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    marked = detectors.marked_lines(docs, "text", MARKERS).groupBy("source").agg(F.count(F.lit(1)).alias("markers"))
    lines = docs.groupBy("source").agg(F.sum(detectors.code_lines(F.col("text"))).alias("lines"))
    return lines.join(marked, "source", "left").fillna({"markers": 0}).withColumn("density", detectors.density(F.col("markers"), F.col("lines")))


def iteration_state(spark, d):
    e = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("branch"),
        F.col("event_id").alias("seq"),
        F.floor(F.col("value") / 20).cast("string").alias("change"),
        F.when(F.col("event_type") == "purchase", "finished").when(F.col("event_type") == "view", "inconclusive").otherwise("countable").alias("outcome"),
    )
    return iteration.iterate(e).select("branch", "seq", "count", "escalated")


def seal_roundtrip(spark, d):
    r = table(spark, d, "region").select(F.col("r_name").alias("metric_id"), F.struct(F.lit("path").alias("kind"), F.col("r_regionkey").alias("value"), F.lit(None).cast("string").alias("blob_oid")).alias("scope"), F.lit("complete").alias("completeness"))
    sealed = canonical.seal(r)
    return sealed.select("metric_id", "digest").join(canonical.broken_seals(sealed).select("metric_id"), "metric_id", "left_anti")


def quantized_ratios(spark, d):
    l = table(spark, d, "lineitem")
    return l.select("l_orderkey", "l_linenumber", scalars.quantize_ratio(F.col("l_extendedprice") / 7 / 65536).alias("ratio"), scalars.severity_rank(F.lit("high")).alias("rank"))


def path_predicates(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(F.regexp_replace("url", "^https?://[^/]*/?", ""), F.when(F.col("page_id") % 4 == 0, "/tests/a.py").when(F.col("page_id") % 4 == 1, "/x.spec.ts").when(F.col("page_id") % 4 == 2, "/data/t.json").otherwise("/main.rs")).alias("path"))
    return p.select("page_id", scalars.is_test_path(F.col("path")).alias("test"), scalars.is_data_path(F.col("path")).alias("data"), scalars.language_of(F.col("path")).alias("language"), scalars.language_of(F.col("path"), clones=True).alias("clone_language"))


def strict_parses(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), (F.col("o_orderkey") % 4).alias("k"))
    text = F.when(F.col("k") == 0, F.concat("day", F.lit("T01:02:03Z"))).when(F.col("k") == 1, F.concat("day", F.lit(" 01:02:03Z"))).when(F.col("k") == 2, F.concat("day", F.lit("T25:00:00Z"))).otherwise(F.col("day"))
    return o.select("o_orderkey", scalars.strict_stamp(text).alias("stamp"), scalars.strict_date(text).alias("date"))


def utf8_truncation(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length(scalars.truncate_bytes(F.col("text"), 61)).cast("long").alias("bytes"), scalars.truncate_bytes(F.col("text"), 61).alias("said"))


def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", scalars.html_escape(F.col("html")).alias("safe"))


def agent_profile(spark, d):
    r = _results(spark, d).select("record", "severity", "metric_id", F.concat(F.col("family"), F.lit(":"), F.col("line").cast("string")).alias("scope_label"), F.col("line").alias("ordinal"))
    reasons = r.filter("severity = 'high'").select("record", "severity", F.col("metric_id").alias("code"), F.lit("stops").alias("message"), "ordinal")
    return ordering.agent_profile(r, reasons, "record", budget=300).select("record", "part", F.col("rank").cast("long").alias("rank"), "line", "running_bytes")


QUERIES = {
    f.__name__: f
    for f in (
        excluded_paths,
        key_moves,
        value_labels,
        regime_labels,
        overlay_merge,
        base_head_delta,
        suffix_match_join,
        uncovered_lines,
        multiset_gain,
        multiset_difference,
        recursive_diff,
        policy_direction,
        severity_ladder,
        severity_clamp,
        verdict,
        weakest_completeness,
        fired_signals,
        ngram_clones,
        clone_summary,
        longest_run,
        nearest_neighbours,
        suppression_density,
        iteration_state,
        seal_roundtrip,
        quantized_ratios,
        path_predicates,
        strict_parses,
        utf8_truncation,
        html_escape,
        agent_profile,
    )
}
_NAMES = "['info', 'low', 'medium', 'high', 'critical']"
ORACLES = {
    "key_moves": """
WITH p AS (SELECT p_partkey, 'brand' AS key, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part),
h AS (SELECT p_partkey, key, CASE WHEN p_partkey % 3 = 0 THEN value || '!' WHEN p_partkey % 7 <> 0 THEN value END AS after FROM p WHERE p_partkey % 5 <> 0 OR key = 'size')
SELECT p.p_partkey, p.key, value AS before, after FROM p LEFT JOIN h ON h.p_partkey = p.p_partkey AND h.key = p.key WHERE value IS DISTINCT FROM after""",
    "value_labels": """
WITH e AS (SELECT *, event_id % 301 - 150 AS n FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN CASE WHEN n > 0 THEN '+' ELSE '' END || n::VARCHAR WHEN 1 THEN n::VARCHAR WHEN 2 THEN n::VARCHAR || 'ms'
  WHEN 3 THEN CASE WHEN user_id % 2 = 0 THEN 'fired' ELSE 'not fired' END ELSE event_type END AS value_label,
  CASE WHEN event_id % 3 = 0 THEN 'change' ELSE event_type || CASE WHEN event_id % 2 = 0 THEN '::f' ELSE '' END || CASE WHEN event_id % 4 = 0 THEN ':' || user_id::VARCHAR ELSE '' END END AS scope_label FROM e""",
    "regime_labels": """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'process v2 git ' || c_nationkey::VARCHAR || ' window 365d'
  WHEN 1 THEN 'tamper v2 detectors ' || c_nationkey::VARCHAR || ' rules ' || c_mktsegment
  WHEN 2 THEN 'clones v2 hash min-tokens ' || c_nationkey::VARCHAR || ' window 25 normalization ' || c_nationkey::VARCHAR
  ELSE 'static v2 spec ' || c_nationkey::VARCHAR || ' grammars [python=' || c_mktsegment || ',rust=' || c_nationkey::VARCHAR || ']' END AS label FROM customer""",
    "excluded_paths": "SELECT p AS path, NOT (p = 'site1.example.com' OR starts_with(p, 'site1.example.com/') OR p = 'site2.example.com') AS kept FROM (SELECT regexp_replace(url, '^https?://', '') AS p FROM pages)",
    "overlay_merge": """
WITH a AS (SELECT c_custkey AS path, CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS b, CASE WHEN c_custkey % 8 <> 0 THEN 'c' || c_mktsegment END AS h FROM customer WHERE c_custkey % 2 = 0),
z AS (SELECT c_custkey AS path, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS b, CASE WHEN c_custkey % 4 <> 0 THEN 'd' || c_mktsegment END AS h FROM customer WHERE c_custkey % 3 = 0),
m AS (SELECT coalesce(a.path, z.path) AS path, CASE WHEN a.path IS NOT NULL THEN a.b ELSE z.b END AS base_oid, CASE WHEN z.path IS NOT NULL THEN z.h ELSE a.h END AS head_oid FROM a FULL JOIN z ON a.path = z.path)
SELECT *, CASE WHEN base_oid IS NULL THEN 'added' WHEN head_oid IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM m WHERE base_oid IS NOT NULL OR head_oid IS NOT NULL""",
    "base_head_delta": """
SELECT p_partkey + 1000 AS path, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS old_path, CASE WHEN p_partkey % 10 = 0 THEN 'other' ELSE p_brand END AS language, p_size * 2 AS value,
 p_size * 2 - (SELECT b.p_size FROM part b WHERE b.p_partkey % 3 <> 0 AND b.p_partkey = CASE WHEN h.p_partkey % 2 = 0 THEN h.p_partkey ELSE h.p_partkey + 1000 END AND b.p_brand = CASE WHEN h.p_partkey % 10 = 0 THEN 'other' ELSE h.p_brand END) AS delta FROM part h""",
    "suffix_match_join": """
WITH u AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS c FROM pages), s AS (SELECT page_id, c, string_split(c, '/') AS q FROM u),
w AS (SELECT DISTINCT CASE page_id % 3 WHEN 0 THEN q[-1] WHEN 1 THEN array_to_string(q[greatest(1, len(q) - 1):], '/') ELSE c END AS path FROM s), k AS (SELECT DISTINCT c FROM u)
SELECT path, coalesce((SELECT c FROM k WHERE c = path), CASE WHEN (SELECT count(*) FROM k WHERE ends_with(c, '/' || path)) = 1 THEN (SELECT min(c) FROM k WHERE ends_with(c, '/' || path)) END) AS covered_path FROM w WHERE path <> ''""",
    "uncovered_lines": """
WITH a AS (SELECT l_orderkey AS path, l_linenumber AS line, CASE WHEN l_quantity < 20 THEN 0 ELSE 1 END AS hits, l_orderkey % 3 AS pr FROM lineitem),
r AS (SELECT path, line, pr, max(hits) AS hits FROM (SELECT * FROM a UNION ALL SELECT path, line, 0, 1 FROM a WHERE path % 4 = 0) GROUP BY ALL),
c AS (SELECT * FROM r QUALIFY pr = min(pr) OVER (PARTITION BY path)), t AS (SELECT DISTINCT l_orderkey AS path, l_linenumber AS line FROM lineitem WHERE l_linenumber < 4)
SELECT path, count(*) AS covered_changes, count(*) FILTER (WHERE hits = 0) AS uncovered FROM t JOIN c USING (path, line) GROUP BY path""",
    "multiset_gain": r"""
WITH q AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS said, unnest(range(len(string_split(text, chr(10))))) AS "at" FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY source, said ORDER BY doc_id, "at") AS k FROM q WHERE doc_id % 2 = 1), b AS (SELECT source, said, count(*) AS had FROM q WHERE doc_id % 2 = 0 GROUP BY ALL)
SELECT n.source, n.doc_id, n."at"::INT AS "at" FROM n LEFT JOIN b ON n.source = b.source AND n.said = b.said WHERE k > coalesce(had, 0)""",
    "multiset_difference": """
WITH q AS (SELECT doc_id % 2 AS side, unnest(string_split(text, chr(10))) AS said FROM documents)
SELECT said, 'base' AS side FROM (SELECT said FROM q WHERE side = 0 EXCEPT ALL SELECT said FROM q WHERE side = 1) UNION ALL SELECT said, 'head' FROM (SELECT said FROM q WHERE side = 1 EXCEPT ALL SELECT said FROM q WHERE side = 0)""",
    "recursive_diff": """
WITH a AS (SELECT event_id, 'k' AS field, json_extract(props, '$.k')::VARCHAR AS v FROM events WHERE event_id % 7 <> 0),
b AS (SELECT event_id, 'k' AS field, CASE WHEN event_id % 3 = 0 THEN '7' ELSE json_extract(props, '$.k')::VARCHAR END AS v FROM events WHERE event_id % 5 <> 0
 UNION ALL SELECT event_id, 'z.y', '[1,2]' FROM events WHERE event_id % 15 IN (3, 6, 9, 12) UNION ALL SELECT event_id, 'gone', 'null' FROM events WHERE event_id % 15 IN (3, 6, 9, 12))
SELECT coalesce(a.event_id, b.event_id) AS event_id, coalesce(a.field, b.field) AS field, a.v AS before, b.v AS after FROM a FULL JOIN b ON a.event_id = b.event_id AND a.field = b.field WHERE a.v IS DISTINCT FROM b.v""",
    "policy_direction": """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CASE WHEN o_custkey % 5 % 2 = 0 AND o_orderkey % 3 % 2 = 1 THEN 'loosening' WHEN o_custkey % 5 % 2 = 1 AND o_orderkey % 3 % 2 = 0 THEN 'tightening' ELSE 'unclassified' END
 WHEN 2 THEN CASE WHEN o_orderkey % 3 < o_custkey % 5 THEN 'loosening' WHEN o_orderkey % 3 > o_custkey % 5 THEN 'tightening' ELSE 'unclassified' END
 WHEN 4 THEN 'neutral' WHEN 5 THEN 'unclassified' ELSE CASE WHEN o_orderkey % 3 > o_custkey % 5 THEN 'loosening' WHEN o_orderkey % 3 < o_custkey % 5 THEN 'tightening' ELSE 'unclassified' END END AS direction FROM orders""",
    "severity_ladder": "SELECT o_orderkey, CASE WHEN o_totalprice / 50 >= 5000 THEN 'high' WHEN o_totalprice / 50 >= 2000 THEN 'medium' WHEN o_totalprice / 50 >= 500 THEN 'low' ELSE 'info' END AS severity, true AS agree FROM orders",
    "severity_clamp": f"WITH {_RESULTS_SQL} SELECT record, line, {_NAMES}[least(rank, top) + 1] AS severity FROM x",
    "verdict": f"""
WITH {_RESULTS_SQL}, y AS (SELECT record, family = 'tamper' AND flag AND NOT (edit AND record % 2 = 0) AS ts, family = 'tests' AND flag AS tf, NOT flag AND least(rank, top) >= 2 AS mp,
 (NOT flag AND least(rank, top) = 1) OR (family = 'tamper' AND flag AND edit AND record % 2 = 0) AS fa, CASE WHEN family = 'tamper' AND flag THEN NOT (edit AND record % 2 = 0) ELSE least(rank, top) > 0 END AND act AS cn FROM x),
g AS (SELECT record, bool_or(ts) AS ts, bool_or(tf) AS tf, bool_or(mp) AS mp, bool_or(fa) AS fa, bool_or(cn) AS countable FROM y GROUP BY record)
SELECT record, CASE WHEN record % 9 = 0 AND countable THEN 'escalate_to_human' WHEN ts OR tf OR mp THEN 'block' WHEN fa THEN 'advise' ELSE 'pass' END AS verdict,
 concat_ws(',', CASE WHEN ts THEN 'tamper-signal' END, CASE WHEN tf THEN 'test-failure' END, CASE WHEN mp THEN 'severity-med-plus' END, CASE WHEN fa THEN 'finding-advisory' END) AS reasons, countable FROM g""",
    "weakest_completeness": f"WITH {_RESULTS_SQL} SELECT record, CASE WHEN bool_or(part) THEN 'partial' ELSE 'complete' END AS completeness FROM x GROUP BY record",
    "fired_signals": f"WITH {_RESULTS_SQL} SELECT record, concat_ws(',', CASE WHEN bool_or(NOT edit) THEN 'test-removal' END, CASE WHEN bool_or(edit) THEN 'threshold-config-edit' END) AS signals FROM x WHERE family = 'tamper' AND flag GROUP BY record",
    "ngram_clones": r"""
WITH q AS (SELECT doc_id AS file, string_split(trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g')), ' ') AS w FROM documents),
g AS (SELECT file, unnest(range(len(w) - 49)) AS pos, w FROM q WHERE len(w) >= 50), k AS (SELECT file, pos, array_to_string(w[pos + 1 : pos + 50], ' ') AS s FROM g),
t AS (SELECT s, min(file) AS f1, max(file) AS f2, min(pos) AS p1, max(pos) AS p2 FROM k GROUP BY s HAVING count(*) > 1),
h AS (SELECT file, pos FROM k JOIN t USING (s) WHERE f1 <> f2 OR pos - p1 >= 50 OR p2 - pos >= 50),
c AS (SELECT file, pos, least(50, coalesce(lead(pos) OVER (PARTITION BY file ORDER BY pos) - pos, 50)) AS fresh FROM h)
SELECT file, sum(fresh)::BIGINT AS duplicated FROM c GROUP BY file""",
    "longest_run": """
WITH e AS (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS day FROM events), i AS (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM e),
r AS (SELECT user_id, min(day) AS start, count(*) AS length FROM i GROUP BY user_id, g)
SELECT user_id, start::INT AS start, length FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start) = 1""",
    "nearest_neighbours": "SELECT user_id, event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "suppression_density": """
WITH q AS (SELECT source, unnest(string_split(text, chr(10))) AS l FROM documents), m AS (SELECT source, count(*) FILTER (WHERE contains(lower(l), 'token =') OR contains(lower(l), 'licensed under') OR contains(lower(l), '@mail')) AS markers, count(*) FILTER (WHERE trim(l) <> '') AS lines FROM q GROUP BY source)
SELECT source, lines, markers, markers * 1000 // lines AS density FROM m""",
    "iteration_state": """
WITH e AS (SELECT user_id::VARCHAR AS branch, event_id AS seq, floor(value / 20)::BIGINT AS change, event_type FROM events),
s AS (SELECT *, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY branch ORDER BY seq) AS part FROM e),
c AS (SELECT branch, seq, part, change IS DISTINCT FROM lag(change) OVER (PARTITION BY branch, part ORDER BY seq) AS new FROM s WHERE event_type NOT IN ('purchase', 'view')),
n AS (SELECT s.branch, s.seq, coalesce(count(*) FILTER (WHERE c.new) OVER (PARTITION BY s.branch, s.part ORDER BY s.seq), 0) AS count FROM s LEFT JOIN c ON c.branch = s.branch AND c.seq = s.seq)
SELECT branch, seq, count, count > 3 AS escalated FROM n""",
    "seal_roundtrip": """SELECT r_name AS metric_id, sha256('{"completeness":"complete","metric_id":"' || r_name || '","scope":{"blob_oid":null,"kind":"path","value":' || r_regionkey || '}}') AS digest FROM region""",
    "quantized_ratios": "SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7 / 65536 * 1e6, 0) / 1e6 AS ratio, 3 AS rank FROM lineitem",
    "path_predicates": """
WITH p AS (SELECT page_id, lower(regexp_replace(url, '^https?://[^/]*/?', '') || CASE page_id % 4 WHEN 0 THEN '/tests/a.py' WHEN 1 THEN '/x.spec.ts' WHEN 2 THEN '/data/t.json' ELSE '/main.rs' END) AS p FROM pages)
SELECT page_id, page_id % 4 < 2 OR list_has_any(string_split(p, '/'), ['test', 'tests', '__tests__', 'spec', 'specs', 'e2e', 'testing']) AS test,
 page_id % 4 = 2 OR regexp_matches('/' || p, '/(data|fixtures?|locales?|i18n|seeds?|generated|__generated__|snapshots|__snapshots__|migrations)/') AS data,
 CASE page_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 3 THEN 'rust' END AS language, CASE page_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' END AS clone_language FROM p""",
    "strict_parses": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN epoch(o_orderdate::DATE)::BIGINT + 3723 END AS stamp, CASE WHEN o_orderkey % 4 = 3 THEN o_orderdate::DATE END AS date FROM orders",
    "utf8_truncation": """
WITH c AS (SELECT doc_id, text, unnest(range(1, 62)) AS k FROM documents), s AS (SELECT doc_id, left(text, k::INT) AS said FROM c WHERE strlen(left(text, k::INT)) <= 61)
SELECT doc_id, strlen(max_by(said, strlen(said))) AS bytes, max_by(said, strlen(said)) AS said FROM s GROUP BY doc_id""",
    "html_escape": """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS safe FROM pages""",
    "agent_profile": f"""
WITH {_RESULTS_SQL}, r AS (SELECT record, line, rank, family, CASE family WHEN 'tamper' THEN CASE WHEN edit THEN 'tamper.threshold-config-edit' ELSE 'tamper.test-removal' END WHEN 'tests' THEN 'tests.suite-failure' ELSE 'process.hotspot' END AS metric FROM x),
a AS (SELECT record, 0 AS part, rank AS sev, metric AS name, 'stops' AS said, line FROM r WHERE rank = 3 UNION ALL SELECT record, 1, rank, metric, family || ':' || line, line FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY record, part ORDER BY sev DESC, name, line) AS rank FROM a),
k AS (SELECT record, part, rank, '{{"severity":"' || {_NAMES}[sev + 1] || '","name":"' || name || '","said":"' || said || '"}}' AS line FROM n WHERE rank <= CASE part WHEN 0 THEN 20 ELSE 12 END)
SELECT *, (sum(strlen(line)) OVER (PARTITION BY record ORDER BY part, rank ROWS UNBOUNDED PRECEDING))::BIGINT AS running_bytes FROM k QUALIFY running_bytes <= 300""",
}
