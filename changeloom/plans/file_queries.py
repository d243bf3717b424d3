"""Queries that write files out of the tables' rows and run the scans, parsers and
detectors over them, with SQL that counts the same things from the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changeloom.functions import scalars
from changeloom.operators import changes, clones, compare, configs, detectors, evidence, ledger, rules, sourcecode
from changeloom.plans.inputs import table
from changeloom.sources import coverage, git


def _pick(choices: list[str], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (key % len(choices) + 1).cast("int"))


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _bytes(*parts) -> Column:
    return _text(*parts).cast("binary")


# Scans ---------------------------------------------------------------------------


def lcov_lines(spark, d):
    line = F.col("l_linenumber")
    more = F.when(F.col("l_suppkey") % 7 == 0, _text("DA:", line, ",1,x\n")).otherwise("")
    bad = F.when(F.col("l_orderkey") % 10 == 0, "DA:x,1\n").otherwise("")
    part = _text("SF:./src/p", F.col("l_partkey") % 50, ".py\nDA:", line, ",", F.col("l_quantity").cast("long"), "\n", more, bad, "end_of_record\n")
    reports = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("report")).agg(F.array_join(F.collect_list(part), "").alias("text"))
    return coverage.lcov(reports)


def cobertura_lines(spark, d):
    entry = _text('<line number="', F.col("l_linenumber"), '" hits="', F.col("l_quantity").cast("long"), '"/>')
    file = _text('<class filename="p', F.col("l_partkey") % 50, '.py"><lines>', entry, "</lines></class>")
    text = F.concat(F.lit("<coverage><sources><source>src</source></sources>"), F.array_join(F.collect_list(file), ""), F.lit("</coverage>"))
    reports = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("report")).agg(text.alias("text"))
    return coverage.cobertura(reports)


def hunk_scan(spark, d):
    count = F.when(F.col("l_suppkey") % 3 != 0, _text(",", F.col("l_quantity").cast("long") % 4)).otherwise("")
    diff = _text("--- a/x\n+++ b/x\n@@ -1,2 +", F.col("l_linenumber") * 10, count, " @@ def f():\n+x\n")
    return git.hunk_lines(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), diff.alias("diff")))


def author_keys(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", scalars.author_key(F.col("c_name"), _text(F.col("c_custkey"), "@example.org")).alias("author_key"))


def trailer_scan(spark, d):
    c, digest = table(spark, d, "customer"), F.sha2("c_name", 256)
    second = F.when(F.col("c_custkey") % 7 == 0, _text("Seal: ", F.sha2("c_mktsegment", 256), " \t\n")).otherwise("Seal: abc\n")
    first = F.when(F.col("c_custkey") % 5 == 0, "see Seal: ").otherwise("Seal: ")
    message = F.concat(F.lit("Change\n\n"), first, F.upper(digest), F.lit("\n"), second)
    return ledger.trailer_digests(c.select("c_custkey", message.alias("message")), "Seal").select("c_custkey", "digest")


def path_forms(spark, d):
    p = table(spark, d, "part")
    path = F.concat(_pick(["./", "././", "", ".", "a/./"], F.col("p_partkey")), _text("src\\p", F.col("p_size"), "/x.py"))
    marked = F.concat(F.when(F.col("p_partkey") % 2 == 0, "\ufeff").otherwise(""), F.col("p_brand"))
    return p.select("p_partkey", scalars.normalize_path(path).alias("path"), scalars.strip_bom(marked).alias("text"))


def readable_changes(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    base, head = F.when(k % 6 != 0, _bytes(F.col("p_size"))), F.when(k % 4 != 0, _bytes(F.col("p_size") + (k % 3)))
    mode = F.when(k % 10 == 0, "160000").otherwise("100644")
    oid = F.when(k % 9 == 0, "0" * 40).otherwise(F.sha1(_bytes(k)))
    files = p.select("p_partkey", base.alias("base"), head.alias("head"), mode.alias("new_mode"), oid.alias("new_oid"))
    return changes.readable(changes.changed_content(files)).select("p_partkey", F.col("base").isNull().alias("added"), F.col("head").isNull().alias("deleted"))


# Settings ------------------------------------------------------------------------

#: Names, whether each may hold a threshold, and whether it may hold exclusions.
ROSTER = [
    ("tsconfig.json", True, False), ("tsconfig.build.json", True, False), ("tsconfig.build.ts", False, False), (".eslintrc", True, False),
    (".eslintrc.json", True, False), ("pyproject.toml", True, True), ("setup.cfg", True, True), ("setup.py", False, False), ("tox.ini", True, True),
    ("main.py", False, False), ("codecov.yml", True, True), ("nyc.config.js", False, True), ("PACKAGE.JSON", True, True),
]


def config_roster(spark, d):
    path = _text("d", F.col("p_size"), "/", _pick([n for n, *_ in ROSTER], F.col("p_partkey")))
    rows = table(spark, d, "part").select("p_partkey", path.alias("path"))
    return rows.select("p_partkey", configs.is_threshold_config(F.col("path")).alias("threshold"), configs.is_coverage_config(F.col("path")).alias("coverage"))


def config_settings(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    ini = _bytes("# kept = 0\n[coverage:report]\nfail_under = ", size, "\nshow = x\nfail_under = ", size + 1, "\n")
    one_line = _bytes('{ "compilerOptions": { "strict": true, "target": "es', size, '" } }\n')
    files = table(spark, d, "part").select(_text("p", k, F.when(k % 2 == 0, "/setup.cfg").otherwise("/tsconfig.json")).alias("path"), F.when(k % 2 == 0, ini).otherwise(one_line).alias("base"), F.when(k % 4 == 0, ini).alias("head"))
    return configs.settings(files)


def config_exclusions(spark, d):
    k = F.col("p_partkey")
    base = _bytes("[run]\nomit =\n    build/*\n    gen", F.col("p_size"), "/*\nbranch = true\n")
    head = F.when(k % 3 == 0, _bytes("omit = build/*, dist/*\n"))
    return configs.exclusions(table(spark, d, "part").select(_text("p", k, "/.coveragerc").alias("path"), base.alias("base"), head.alias("head")))


#: key, and its moves by whether the value falls or rises from its base of 5.
BOUND_KEYS = ["rules.complexity", "report.branches", "max_severity", "build.title"]


def config_bounds(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    after = _pick(["4", "5", "'6'", "1_0", "7%", "x"], F.col("o_custkey"))
    move = configs.bound(F.lit("shared"), _pick(BOUND_KEYS, k), F.lit("5"), after)
    flag = configs.bound(F.lit("shared"), _pick(["compilerOptions.strict", "skipLibCheck"], k), _pick(["true", "off"], F.col("o_custkey")), _pick(["false", "yes", "maybe"], F.col("o_custkey")))
    word = configs.bound(_pick(["eslint", "shared"], k), F.lit("no-var"), F.lit("warn"), _pick(["off", "2", "error", "Warn"], F.col("o_custkey")))
    return o.select("o_orderkey", configs.number(after).alias("number"), move.alias("move"), flag.alias("flag"), word.alias("word"))


def pattern_breadth(spark, d):
    added, removed = _pick(["**", "src/**", "src/a/*", "src/a/b.py", "lib/*"], F.col("p_partkey")), _pick(["src/a/b.py", "src/a/**", "src/x.py", "other/y.py"], F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", configs.broader(added, removed).alias("broader"))


# Evidence and rules --------------------------------------------------------------


def stale_citations(spark, d):
    results = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("claim_id"), F.when(F.col("l_quantity") > 49, "low").otherwise("info").alias("severity"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey") % 90 == 1).alias("flag"))
    return evidence.cited_stale(results, table(spark, d, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("claim_id")))


def contradictions(spark, d):
    unread = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.col("o_clerk"))).otherwise(F.array().cast("array<string>"))
    o = table(spark, d, "orders").withColumn("o_clerk", _text("p", F.col("o_custkey")))
    records = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "pass").otherwise("advise").alias("verdict"), unread.alias("unreadable_paths"))
    finished, countable = F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 5 == 0
    return rules.contradicted(records).select("o_orderkey", rules.loop_outcome(finished, countable).alias("outcome"))


def claim_reach(spark, d):
    metrics = table(spark, d, "part").select(F.col("p_partkey").alias("metric_id"), F.col("p_size").alias("claim_id"), F.when(F.col("p_partkey") % 2 == 0, "diff-actionable").otherwise("context-informational").alias("class"))
    claims = table(spark, d, "nation").select(F.col("n_nationkey").alias("claim_id"), _pick(["A", "B", "C"], F.col("n_nationkey")).alias("tier"))
    return evidence.reach(metrics, claims, rules.Policy()).select("metric_id", "tier", "reach")


def parse_budgets(spark, d):
    e = table(spark, d, "events")
    totals = e.groupBy(F.col("event_type").alias("language")).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("event_id") % 4 == 0).alias("degraded_files"), F.sum(F.col("user_id") % 3).alias("error_nodes"), F.sum(F.col("user_id") % 50).alias("total_nodes"))
    limits = e.filter("event_type <> 'view'").groupBy(F.col("event_type").alias("language")).agg(
        F.when(F.col("event_type") == "click", 0.1).otherwise(0.9).alias("max_degraded_file_ratio"), F.when(F.col("event_type") == "purchase", 0.0).otherwise(1.0).alias("max_error_node_ratio")
    )
    surplus = limits.limit(0).union(spark.range(1).select(F.lit("none"), F.lit(0.5), F.lit(0.5)))
    return evidence.budgets(totals, limits.union(surplus)).select("language", "problem")


def entropy_integers(spark, d):
    counts = table(spark, d, "events").groupBy(F.col("user_id") % 50, "event_type").count().groupBy(F.col("(user_id % 50)").alias("author")).agg(F.collect_list("count").alias("counts"))
    return counts.select("author", scalars.entropy_microbits_udf("counts").alias("microbits"))


def ancestry(spark, d):
    s = table(spark, d, "supplier")
    parents = s.select(F.col("s_suppkey").alias("oid"), F.floor(F.col("s_suppkey") / 2).alias("parent")).filter("parent > 0")
    return compare.ancestors(parents, s.filter("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("oid")))


def index_update(spark, d):
    k = F.col("p_partkey")
    path, oid = _text("p", k), lambda n: F.sha1(_bytes(F.col("p_size") + n))
    p = table(spark, d, "part")
    previous = p.filter("p_partkey % 5 <> 0").select(path.alias("path"), oid(0).alias("blob_oid"), F.when(k % 7 == 0, "r0").otherwise("r1").alias("regime"), F.array(F.lit("kept")).alias("symbols"))
    inputs = p.filter("p_partkey % 11 <> 0").select(path.alias("path"), oid((k % 3 == 0).cast("int")).alias("blob_oid"), _bytes(k).alias("content"))
    index = clones.incremental(previous, inputs, "r1", lambda missed: missed.select("path", "blob_oid", F.array(F.lit("new")).alias("symbols")))
    return index.select("path", "blob_oid", "regime", F.array_join("symbols", " ").alias("symbols"))


# Sources -------------------------------------------------------------------------


def code_facts(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size") % 5
    flat = _text("def f(x):\n", F.repeat(F.lit("    if x:\n        x -= 1\n"), n.cast("int")), "    return x\n")
    method = F.lit("class A:\n    # note\n    def m(self, a, b):\n        return a and b\n")
    text = F.when(k % 4 == 0, flat).when(k % 4 == 1, method).when(k % 4 == 2, "def f(:\n# c\nx = 1\n").otherwise("/* a\n b */\nfn f() {} // z\n")
    files = table(spark, d, "part").select(_text("p", k, F.when(k % 4 == 3, ".rs").otherwise(".py")).alias("path"), text.cast("binary").alias("content"))
    facts = sourcecode.file_facts(files)
    return facts.select("path", "language", "completeness", F.col("sloc").alias("file_sloc"), F.explode_outer("functions").alias("f")).select("path", "language", "completeness", "file_sloc", "f.*")


def token_streams(spark, d):
    n = (F.col("p_size") % 3 + 1).cast("int")
    content = _bytes("import os\n", F.repeat(F.lit("x = y + 1  # c\n"), n))
    found = sourcecode.streams(table(spark, d, "part").select(_text("p", F.col("p_partkey"), ".py").alias("path"), content.alias("content")))
    return found.select("file", F.array_join("symbols", " ").alias("symbols"), F.array_max("lines").alias("last_line"))


def _changes(spark, d):
    """Four files for each part: tests, a module and two settings."""
    k, size = F.col("p_partkey"), F.col("p_size")
    p = table(spark, d, "part")
    file = lambda name, base, head: p.select(_text("p", k, "/", name).alias("path"), _bytes(base).alias("base"), head.cast("binary").alias("head"))
    one, two, bare = "def test_a():\n    assert f()\n", "\ndef test_b():\n    assert g()\n", "\ndef test_b():\n    g()\n"
    tests = file("tests/test_x.py", one + two, F.when(k % 4 == 0, one).when(k % 4 == 1, one + bare).otherwise(one + two))
    list_ = F.array_join(F.array_repeat(F.lit("1"), (size + 24).cast("int")), ", ")
    body = "def f(x):\n    return x\n"
    module = file("src/m.py", body, F.when(k % 5 == 0, _text("def f(x):\n    return [", list_, "]\n")).when(k % 5 == 1, "def f(x):\n    return (x\n").when(k % 5 == 2, body + "a = 1  # noqa\nb = 1  # noqa\n").otherwise(body))
    strict = file("tsconfig.json", '{ "compilerOptions": { "strict": true } }\n', F.when(k % 3 == 0, '{ "compilerOptions": { "strict": false } }\n').otherwise('{ "compilerOptions": { "strict": true } }\n'))
    omit = file(".coveragerc", "omit = build/*\n", F.when(k % 6 == 0, "omit = build/*, dist/*\n").otherwise("omit = build/*\n"))
    return tests.union(module).union(strict).union(omit)


def detector_outcomes(spark, d):
    return detectors.detect(_changes(spark, d)).select("signal", "fired", "magnitude", F.size("findings").alias("findings"), F.size("unassessed").alias("unassessed"))


QUERIES = {
    f.__name__: f
    for f in (
        lcov_lines,
        cobertura_lines,
        hunk_scan,
        author_keys,
        trailer_scan,
        path_forms,
        readable_changes,
        config_roster,
        config_settings,
        config_exclusions,
        config_bounds,
        pattern_breadth,
        stale_citations,
        contradictions,
        claim_reach,
        parse_budgets,
        entropy_integers,
        ancestry,
        index_update,
        code_facts,
        token_streams,
        detector_outcomes,
    )
}

_ROSTER_SQL = ", ".join(f"({n}, {threshold}, {covered})" for n, (_, threshold, covered) in enumerate(ROSTER))
ORACLES = {
    "lcov_lines": """
WITH da AS (SELECT l_orderkey, l_partkey % 50 AS p, l_linenumber AS line, l_quantity::BIGINT AS hits FROM lineitem
  UNION ALL SELECT l_orderkey, l_partkey % 50, l_linenumber, 1 FROM lineitem WHERE l_suppkey % 7 = 0)
SELECT l_orderkey::VARCHAR AS report, 'lcov' AS format, 'src/p' || p::VARCHAR || '.py' AS path, line, sum(hits)::BIGINT AS hits, l_orderkey % 10 = 0 AS degraded FROM da GROUP BY l_orderkey, p, line""",
    "cobertura_lines": """
SELECT l_orderkey::VARCHAR AS report, 'cobertura' AS format, 'src/p' || (l_partkey % 50)::VARCHAR || '.py' AS path, l_linenumber AS line, sum(l_quantity::BIGINT)::BIGINT AS hits, false AS degraded
FROM lineitem GROUP BY l_orderkey, l_partkey % 50, l_linenumber""",
    "hunk_scan": """
WITH h AS (SELECT l_orderkey AS path, l_linenumber * 10 AS start, CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE l_quantity::BIGINT % 4 END AS n FROM lineitem)
SELECT DISTINCT path, start + k AS line FROM h, (VALUES (0), (1), (2)) t(k) WHERE k < n""",
    "author_keys": "SELECT c_custkey, substr(sha256(c_name || chr(0) || c_custkey::VARCHAR || '@example.org'), 1, 16) AS author_key FROM customer",
    "trailer_scan": """
SELECT c_custkey, sha256(c_name) AS digest FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, sha256(c_mktsegment) FROM customer WHERE c_custkey % 7 = 0""",
    "path_forms": """
SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN '.' WHEN 4 THEN 'a/./' ELSE '' END || 'src/p' || p_size::VARCHAR || '/x.py' AS path, p_brand AS text FROM part""",
    "readable_changes": """
SELECT p_partkey, p_partkey % 6 = 0 AS added, p_partkey % 4 = 0 AS deleted FROM part
WHERE p_partkey % 10 <> 0 AND p_partkey % 9 <> 0 AND NOT (p_partkey % 6 <> 0 AND p_partkey % 4 <> 0 AND p_partkey % 3 = 0)""",
    "config_roster": f"SELECT p_partkey, threshold, covered AS coverage FROM part JOIN (VALUES {_ROSTER_SQL}) t(n, threshold, covered) ON n = p_partkey % {len(ROSTER)}",
    "config_settings": """
WITH s AS (SELECT *, 'base' AS side FROM part UNION ALL SELECT *, 'head' FROM part WHERE p_partkey % 4 = 0)
SELECT 'p' || p_partkey::VARCHAR || '/setup.cfg' AS path, side, 'coverage:report.' || key AS key, CASE key WHEN 'show' THEN 'x' ELSE (p_size + 1)::VARCHAR END AS value, line, 'shared' AS dialect
FROM s, (VALUES ('fail_under', 5), ('show', 4)) t(key, line) WHERE p_partkey % 2 = 0
UNION ALL SELECT 'p' || p_partkey::VARCHAR || '/tsconfig.json', side, key, CASE key WHEN 'strict' THEN 'true' ELSE 'es' || p_size::VARCHAR END, 1, 'shared' FROM s, (VALUES ('strict'), ('target')) t(key) WHERE p_partkey % 2 = 1""",
    "config_exclusions": """
SELECT 'p' || p_partkey::VARCHAR || '/.coveragerc' AS path, 'base' AS side, line, CASE line WHEN 3 THEN 'build/*' ELSE 'gen' || p_size::VARCHAR || '/*' END AS entry FROM part, (VALUES (3), (4)) t(line)
UNION ALL SELECT 'p' || p_partkey::VARCHAR || '/.coveragerc', 'head', 1, entry FROM part, (VALUES ('build/*'), ('dist/*')) t(entry) WHERE p_partkey % 3 = 0""",
    "config_bounds": """
WITH v(c, number) AS (VALUES (0, 4.0::DOUBLE), (1, 5.0), (2, 6.0), (3, 10.0), (4, 7.0), (5, NULL)),
x AS (SELECT o_orderkey, o_orderkey % 4 AS k, o_custkey % 2 AS f, o_custkey % 3 AS t, o_custkey % 4 AS w, number FROM orders JOIN v ON c = o_custkey % 6)
SELECT o_orderkey, number,
 CASE WHEN k = 3 THEN 'other' WHEN number IS NULL OR number = 5 THEN 'unranked' WHEN (k = 0) = (number > 5) THEN 'loosened' ELSE 'tightened' END AS move,
 CASE WHEN t = 2 OR (f = 0) = (t = 1) THEN 'unranked' WHEN (k % 2 = 0) = (f = 0) THEN 'loosened' ELSE 'tightened' END AS flag,
 CASE WHEN w = 0 THEN 'loosened' WHEN w = 2 OR (w = 1 AND k % 2 = 0) THEN 'tightened' ELSE 'other' END AS word FROM x""",
    "pattern_breadth": "SELECT p_partkey, p_partkey % 5 = 0 OR (p_partkey % 5 = 1 AND p_size % 4 < 2) AS broader FROM part",
    "stale_citations": "SELECT DISTINCT l_suppkey AS claim_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey % 3 = 0 AND (l_quantity > 49 OR l_partkey % 90 = 1)",
    "contradictions": """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'countable' WHEN o_orderkey % 3 = 0 THEN 'finished' ELSE 'inconclusive' END AS outcome FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 = 0""",
    "claim_reach": """
SELECT p_partkey AS metric_id, CASE n_nationkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS tier,
 CASE WHEN p_partkey % 2 = 0 AND n_nationkey % 3 < 2 THEN 'critical' ELSE 'low' END AS reach FROM part LEFT JOIN nation ON n_nationkey = p_size""",
    "parse_budgets": """
WITH t AS (SELECT event_type AS language, count(*) AS files, count(*) FILTER (event_id % 4 = 0) AS degraded, sum(user_id % 3) AS errors FROM events GROUP BY event_type)
SELECT language, CASE WHEN language = 'view' THEN 'no-budget' WHEN degraded / files > CASE language WHEN 'click' THEN 0.1 ELSE 0.9 END THEN 'degraded-files' ELSE 'error-nodes' END AS problem
FROM t WHERE language = 'view' OR degraded / files > CASE language WHEN 'click' THEN 0.1 ELSE 0.9 END OR (language = 'purchase' AND errors > 0)
UNION ALL SELECT 'none', 'surplus-budget'""",
    "entropy_integers": """
WITH c AS (SELECT user_id % 50 AS author, event_type, count(*)::DOUBLE AS n FROM events GROUP BY ALL)
SELECT author, round((log2(sum(n)) - sum(n * log2(n)) / sum(n)) * 1e6)::BIGINT AS microbits FROM c GROUP BY author""",
    "ancestry": """
WITH RECURSIVE a(oid) AS (SELECT s_suppkey::BIGINT FROM supplier WHERE s_suppkey % 5 = 0 UNION SELECT oid // 2 FROM a WHERE oid // 2 > 0) SELECT oid FROM a""",
    "index_update": """
WITH i AS (SELECT *, p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 3 <> 0 AS kept FROM part WHERE p_partkey % 11 <> 0)
SELECT 'p' || p_partkey::VARCHAR AS path, sha1((p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END)::VARCHAR) AS blob_oid, 'r1' AS regime, CASE WHEN kept THEN 'kept' ELSE 'new' END AS symbols FROM i""",
    "code_facts": """
WITH x AS (SELECT p_partkey % 4 AS k, p_size % 5 AS n, p_partkey FROM part)
SELECT 'p' || p_partkey::VARCHAR || CASE k WHEN 3 THEN '.rs' ELSE '.py' END AS path, CASE k WHEN 3 THEN 'rust' ELSE 'python' END AS language, CASE WHEN k < 2 THEN 'complete' ELSE 'parse-degraded' END AS completeness,
 CASE k WHEN 0 THEN 2 + 2 * n WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS file_sloc, CASE k WHEN 0 THEN 'f' WHEN 1 THEN 'A.m' END AS name, CASE k WHEN 0 THEN 1 WHEN 1 THEN 3 END AS line,
 CASE k WHEN 0 THEN 2 + 2 * n WHEN 1 THEN 4 END AS end_line, CASE k WHEN 0 THEN 2 + 2 * n WHEN 1 THEN 2 END AS sloc, CASE k WHEN 0 THEN 1 + n WHEN 1 THEN 2 END AS cyclomatic, CASE k WHEN 0 THEN n WHEN 1 THEN 1 END AS cognitive FROM x""",
    "token_streams": """
SELECT 'p' || p_partkey::VARCHAR || '.py' AS file, rtrim(repeat('ID = ID + NUM ', (p_size % 3 + 1)::INT)) AS symbols, p_size % 3 + 2 AS last_line FROM part""",
    "detector_outcomes": """
WITH c AS (SELECT count(*) FILTER (p_partkey % 4 = 0) AS gone, count(*) FILTER (p_partkey % 4 = 1) AS bare, count(*) FILTER (p_partkey % 5 = 0) AS tables, max(p_size) FILTER (p_partkey % 5 = 0) + 24 AS largest,
 count(*) FILTER (p_partkey % 5 = 1) AS broken, 2 * count(*) FILTER (p_partkey % 5 = 2) AS marks, count(*) FILTER (p_partkey % 3 = 0) AS loose, count(*) FILTER (p_partkey % 6 = 0) AS wide FROM part)
SELECT t.* FROM c, LATERAL (VALUES ('suppression-density', marks > 1, marks, marks, 0), ('test-removal', gone > 0, gone, gone, 0), ('threshold-config-edit', loose > 0, loose, loose, 0),
 ('coverage-exclusion-drift', wide > 0, wide, wide, 0), ('assertion-free-test', bare > 0, bare, bare, 0), ('lookup-table-blowup', tables > 0, largest, tables, 0), ('parse-error-delta', broken > 0, broken, broken, 0)) t(signal, fired, magnitude, findings, unassessed)""",
}
