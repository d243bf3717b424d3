import random

from pyspark.sql import functions as F

from changeloom.operators import changes, clones, compare, detectors, ordering, rules, sourcecode
from changeloom.streaming.iteration import advance, iterate


def files(spark, *rows):
    return spark.createDataFrame([(p, None, "modified", b.encode() if b is not None else None, h.encode() if h is not None else None) for p, b, h in rows], "path string, old_path string, kind string, base binary, head binary")


def outcome(frame):
    row = frame.first()
    return row.fired, row.magnitude


def test_suppressions(spark):
    base = "x = 1\ny = 2  # noqa\n"
    assert outcome(detectors.suppression_density(files(spark, ("a.py", base, base + "z = 3  # noqa\nw = 4  # type: ignore\n")))) == (True, 2)
    assert outcome(detectors.suppression_density(files(spark, ("a.py", base, base + "z = 3  # noqa\n")))) == (False, 1)
    assert outcome(detectors.suppression_density(files(spark, ("a.py", base, base)))) == (False, 0)


def test_removed_and_skipped_tests(spark):
    base = "def test_a():\n    assert f() == 1\n\ndef test_b():\n    assert f() == 2\n"
    assert outcome(detectors.test_removal(files(spark, ("tests/test_f.py", base, base[: base.index("def test_b")])))) == (True, 1)
    skipped = base.replace("def test_b", "@pytest.mark.skip\ndef test_b")
    assert outcome(detectors.test_removal(files(spark, ("tests/test_f.py", base, skipped)))) == (True, 1)
    moved = files(spark, ("tests/test_f.py", base, base[: base.index("def test_b")]), ("tests/test_g.py", None, base[base.index("def test_b") :]))
    assert outcome(detectors.test_removal(moved)) == (False, 0)
    script = 'it("adds", () => { expect(1).toBe(1) });\nit("more", () => { expect(2).toBe(2) });\n'
    assert outcome(detectors.test_removal(files(spark, ("a.test.ts", script, script.replace('it("more"', 'it.skip("more"'))))) == (True, 1)


def test_tests_without_assertions(spark):
    head = "def test_a():\n    run()\n\ndef test_b():\n    assert run()\n"
    assert outcome(detectors.assertion_free_test(files(spark, ("tests/test_f.py", None, head)))) == (True, 1)
    assert outcome(detectors.assertion_free_test(files(spark, ("tests/test_f.py", head, head + "\n")))) == (False, 0)


def test_lookup_tables(spark):
    table = "def f(x):\n    return {" + ", ".join(f"{k}: {k}" for k in range(30)) + "}[x]\n"
    assert outcome(detectors.lookup_table_blowup(files(spark, ("src/f.py", "def f(x):\n    return x\n", table)))) == (True, 30)
    assert outcome(detectors.lookup_table_blowup(files(spark, ("src/data/f.py", "", table)))) == (False, 0)
    script = "function f(x) { return [" + ", ".join(map(str, range(30))) + "][x]; }\n"
    assert outcome(detectors.lookup_table_blowup(files(spark, ("src/f.ts", "", script)))) == (True, 30)
    assert outcome(detectors.lookup_table_blowup(files(spark, ("src/f.ts", "", "const T = [" + ", ".join(map(str, range(30))) + "];\n")))) == (False, 0)


def test_thresholds(spark):
    run = lambda path, base, head: outcome(detectors.threshold_config_edit(files(spark, (path, base, head))))
    assert run("pyproject.toml", "[tool.coverage.report]\nfail_under = 90\n", "[tool.coverage.report]\nfail_under = 80\n") == (True, 1)
    assert run("pyproject.toml", "fail_under = 80\n", "fail_under = 90\n") == (False, 0)
    assert run("tsconfig.json", '{\n"strict": true\n}', '{\n"strict": false\n}') == (True, 1)
    assert run(".eslintrc.json", '"no-eval": 2,', '"no-eval": 0,') == (True, 1)
    assert run("biome.json", '"no-eval": 2,', '"no-eval": 0,') == (False, 0)
    assert run("src/app.toml", "fail_under = 90\n", "fail_under = 10\n") == (False, 0)


def test_exclusions(spark):
    run = lambda base, head: outcome(detectors.coverage_exclusion_drift(files(spark, (".coveragerc", base, head))))
    assert run("[run]\nomit =\n    a/x.py\n", "[run]\nomit =\n    a/x.py\n    b/y.py\n") == (True, 1)
    assert run("[run]\nomit =\n    src/a/b/x.py\n", "[run]\nomit =\n    src/**\n") == (True, 1)
    assert run("[run]\nomit =\n    a/x.py\n", "[run]\nomit =\n    a/x.py\n\n") == (False, 0)


def test_parse_faults(spark):
    assert outcome(detectors.parse_error_delta(files(spark, ("a.py", "x = 1\n", "x = (\n")))) == (True, 1)
    assert outcome(detectors.parse_error_delta(files(spark, ("a.py", "x = (\n", "x = 1\n")))) == (False, 0)


def test_complexity():
    tree = sourcecode.parse("def f(a, b):\n    if a and b:\n        for x in a:\n            if x:\n                return f(x, b)\n    elif b:\n        return 1\n    else:\n        return 2\n")
    ((name, node),) = sourcecode.functions(tree)
    assert (name, sourcecode.cyclomatic(node), sourcecode.cognitive(node)) == ("f", 6, 1 + 1 + 2 + 3 + 1 + 1 + 1)


def test_lines_of_code():
    assert sourcecode.sloc("a.py", '# c\nx = "#"\n\ny = 2  # d\n') == 2
    assert sourcecode.sloc("a.rs", 'fn a() {}\n/* x /* y */\n z */\nlet s = r#"// not"#;\n// c\n') == 2
    assert sourcecode.sloc("a.ts", "/* a\n b */ let x = 1;\n// c\n") == 1


def brute_duplicated(streams, least):
    out = {}
    grams = {}
    for f, s in streams.items():
        for p in range(len(s) - least + 1):
            grams.setdefault(tuple(s[p : p + least]), []).append((f, p))
    for f, s in streams.items():
        covered = set()
        for p in range(len(s) - least + 1):
            if any(g != f or abs(q - p) >= least for g, q in grams[tuple(s[p : p + least])]):
                covered.update(range(p, p + least))
        if covered:
            out[f] = len(covered)
    return out


def test_duplicated_tokens(spark):
    rng = random.Random(4)
    streams = {f"f{k}": [rng.choice("ab") for _ in range(rng.randrange(0, 40))] for k in range(6)}
    df = spark.createDataFrame(list(streams.items()), "file string, symbols array<string>")
    got = {r.file: r.duplicated for r in clones.duplicated_tokens(df, 6).collect()}
    assert got == brute_duplicated(streams, 6)


def test_matches_and_groups(spark):
    a = [f"x{k}" for k in range(80)]
    df = spark.createDataFrame([("a", a), ("b", ["q"] * 3 + a[10:75]), ("c", a[:60])], "file string, symbols array<string>")
    found = clones.matches(clones.seed_pairs(clones.windows_of(df)))
    assert {(r.file_a, r.start_a, r.file_b, r.start_b, r.tokens) for r in found.collect()} == {("a", 10, "b", 3, 65), ("a", 0, "c", 0, 60), ("b", 3, "c", 10, 50)}
    assert [(r.file_a, r.file_b, r.tokens) for r in clones.disjoint_groups(found).collect()] == [("a", "b", 65)]
    assert {r.file: r.duplicated for r in clones.covered_tokens(found).collect()} == {"a": 75, "b": 65, "c": 60}


def test_incremental_index_equals_cold_rebuild(spark):
    rng = random.Random(9)
    tokenize = lambda df: df.select("path", "blob_oid", F.split(F.col("content").cast("string"), " ").alias("symbols"))
    schema = "path string, blob_oid string, content binary"
    empty = spark.createDataFrame([], "path string, blob_oid string, regime string, symbols array<string>")
    state, index = {}, empty
    for _ in range(3):
        for _ in range(rng.randrange(1, 5)):
            path = f"p{rng.randrange(4)}"
            if rng.random() < 0.3:
                state.pop(path, None)
            else:
                state[path] = f"t {rng.randrange(5)}"
        inputs = spark.createDataFrame([(p, t, t.encode()) for p, t in state.items()], schema)
        index = clones.incremental(index, inputs, "r1", tokenize)
        index = spark.createDataFrame(index.collect(), index.schema)
        cold = clones.incremental(empty, inputs, "r1", tokenize)
        assert sorted(index.collect()) == sorted(cold.collect())


def test_attestations(spark):
    order = ["confirmed", "unwitnessed", "divergent", "unwitnessed-version-skew"]
    df = spark.createDataFrame([("h", a, k) for k, a in enumerate(order)] + [("g", "unwitnessed-version-skew", k) for k in range(3)] + [("f", "confirmed", 0)], "head_oid string, attestation string, ordinal int")
    got = {r.head_oid: (r.attestation, r.verdict) for r in compare.decide(df).collect()}
    assert got == {"h": ("divergent", "block"), "g": ("unwitnessed-version-skew", "escalate_to_human"), "f": ("confirmed", "pass")}


def test_ancestry(spark):
    parents = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a"), ("x", "a")], "oid string, parent string")
    assert [compare.base_relation(parents, c, "d") for c in ("d", "b", "x", "zzz")] == ["equal", "ancestor", "not-ancestor", "unknown"]


def test_ladders_must_rise():
    rules.check_ladders(rules.LADDERS)
    try:
        rules.check_ladders({"m": [(2.0, "low"), (1.0, "high")]})
    except ValueError:
        return
    raise AssertionError("a falling ladder passed")


def test_budget_skips_long_lines_and_goes_on(spark):
    df = spark.createDataFrame([("r", 1, "x" * 5), ("r", 2, "y" * 50), ("r", 3, "z" * 5)], "repo string, at int, said string")
    assert [r.at for r in ordering.bounded_listing(df, "repo", "at", "said", 20).collect()] == [1, 3]


def test_deltas_of_renames(spark):
    head = spark.createDataFrame([("b", "a", "py", 5), ("n", None, "py", 1)], "path string, old_path string, language string, value int")
    base = spark.createDataFrame([("a", "py", 3)], "path string, language string, value int")
    assert {r.path: r.delta for r in changes.deltas(head, base).collect()} == {"b": 2, "n": None}


def test_iterations(spark):
    assert advance(1, "a", "countable", "a") == (1, "a") and advance(1, "a", "countable", "b") == (2, "b")
    rows = [("m", 1, "a", "countable"), ("m", 2, "a", "countable"), ("m", 3, "b", "inconclusive"), ("m", 4, "c", "countable"), ("m", 5, "c", "finished"), ("m", 6, "c", "countable")]
    df = spark.createDataFrame(rows, "branch string, seq long, change string, outcome string")
    assert [r["count"] for r in iterate(df, cap=1).orderBy("seq").collect()] == [1, 1, 1, 2, 0, 1]


def test_every_pair_of_a_line_is_read():
    from changeloom.operators.configs import scan

    read = lambda text: [(k, v) for _, k, v in scan(text)]
    assert read('{ "compilerOptions": { "strict": true, "target": "es2020" } }') == [("strict", "true"), ("target", "es2020")]
    assert read("branches: 80, lines: 70") == [("branches", "80"), ("lines", "70")]
    assert read("if (a == b && c >= 3) x => y; at 10:30\n# key = 1\nFail_Under = 90;") == [("fail_under", "90")]
    assert read("[tool.coverage.report]\nomit = [\n  'a',\n  'b',\n]\nlast = 1") == [("coverage.report.omit", "[ 'a', 'b', ]"), ("coverage.report.last", "1")]
    assert read('"rules": {\n "complexity": ["error",\n 10]\n}') == [("complexity", '["error", 10]')]


def test_one_line_config_edit_is_seen(spark):
    from changeloom.operators.detectors import threshold_config_edit

    rows = [("tsconfig.json", '{ "compilerOptions": { "strict": true, "target": "es2020" } }', '{ "compilerOptions": { "strict": false, "target": "es5" } }')]
    files = spark.createDataFrame([(p, p, "modified", bytearray(b.encode()), bytearray(h.encode())) for p, b, h in rows], "path string, old_path string, kind string, base binary, head binary")
    out = threshold_config_edit(files).first()
    assert out.fired and out.magnitude == 1 and "strict" in out.findings[0].text and out.unassessed == []
