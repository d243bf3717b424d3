import subprocess

import pytest
from pyspark.sql import functions as F

from changeloom import api, cli
from changeloom.operators.rules import Policy
from changeloom.sources import coverage, git, settings
from changeloom.sources import ledger as records

LCOV = "TN:\nSF:src/a.py\nDA:1,1\nDA:2,0\nDA:2,3\nend_of_record\nDA:9,1\nSF:./b.py\nDA:1,0\nend_of_record\n"
XML = """<?xml version="1.0"?><coverage><sources><source>src</source></sources><packages><package><classes>
<class filename="a.py"><lines><line number="1" hits="2"/><line number="2" hits="0"/></lines></class></classes></package></packages></coverage>"""


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    folder = tmp_path_factory.mktemp("repo")
    run = lambda *a, at="2024-01-01T00:00:00Z": subprocess.run(["git", "-C", str(folder), "-c", "user.name=a", "-c", "user.email=a@x", *a], check=True, capture_output=True, env={"GIT_AUTHOR_DATE": at, "GIT_COMMITTER_DATE": at, "PATH": "/usr/bin:/bin", "HOME": str(folder)})
    run("init", "-q", "-b", "main")
    write = lambda name, text: ((folder / name).parent.mkdir(parents=True, exist_ok=True), (folder / name).write_text(text))
    write("src/a.py", "def f(x):\n    return x\n")
    write("tests/test_a.py", "def test_f():\n    assert f(1) == 1\n")
    write("old.bin", "\0\1\2")
    run("add", ".")
    run("commit", "-qm", "one", at="2023-01-01T00:00:00Z")
    write("src/a.py", "def f(x):\n    if x:\n        return x\n    return 0\n")
    run("commit", "-qam", "two", at="2024-01-02T00:00:00Z")
    write("tests/test_a.py", "def test_f():\n    f(1)\n")
    write("src/name with \1 sign.py", "x = 1  # noqa\ny = 2  # noqa\n")
    write("lcov.info", "SF:src/a.py\nDA:2,0\nDA:3,1\nend_of_record\n")
    run("add", ".")
    run("commit", "-qm", "three", at="2024-01-03T00:00:00Z")
    return folder


def test_history(spark, repo):
    rows = git.history(spark, str(repo)).collect()
    assert {(r.path, r.added) for r in rows} == {("src/a.py", 3), ("tests/test_a.py", 1), ("src/name with \1 sign.py", 2), ("lcov.info", 4)}
    assert {r.path for r in git.history(spark, str(repo), window_days=10_000).collect()} >= {"old.bin"}
    assert [(r.added, r.deleted) for r in git.history(spark, str(repo), window_days=10_000).filter("path = 'old.bin'").collect()] == [(None, None)]


def test_change_and_blobs(spark, repo):
    changed = git.file_changes(spark, str(repo), "HEAD~1").collect()
    by = {r.path: r for r in changed}
    assert by["tests/test_a.py"].kind == "modified" and by["lcov.info"].kind == "added" and by["lcov.info"].base is None
    tree = git.tree(spark, str(repo))
    held = git.blobs(tree, str(repo))
    assert held.filter(git.blob_oid(F.col("content")) != F.col("blob_oid")).count() == 0 and held.count() == tree.count()
    lines = {(r.path, r.line) for r in git.changed_lines(spark, str(repo), "HEAD~2", "HEAD~1").collect()}
    assert lines == {("src/a.py", 2), ("src/a.py", 3), ("src/a.py", 4)}


def test_dirty_tree(spark, repo):
    (repo / "src/a.py").write_text("changed\n")
    (repo / "new.txt").write_text("new\n")
    try:
        status, full = git.dirty_set(spark, str(repo)).collect(), git.dirty_set(spark, str(repo), full=True).collect()
    finally:
        (repo / "new.txt").unlink()
        subprocess.run(["git", "-C", str(repo), "checkout", "-q", "src/a.py"], check=True)
    assert [r.path for r in status] == ["new.txt", "src/a.py"] and [r.path for r in full] == ["src/a.py"]
    assert status[0].base_oid is None and status[1].head_oid == full[0].head_oid


def test_measure(spark, repo, capsys):
    results, record = api.measure_change(spark, str(repo), "HEAD~1")
    fired = {r.metric_id for r in results.filter("kind = 'flag' AND flag").collect()}
    assert fired == {"tamper.suppression-density", "tamper.assertion-free-test"}
    assert record.first().verdict == "block" and "tamper-signal" in record.first().reasons
    assert api.get_results(results, "churn-commits").count() == 3
    assert cli.main(["measure", "--repo", str(repo), "--base", "HEAD~2", "--head", "HEAD~1"], spark) == 0
    assert "artifacts.uncovered-changed-lines" in capsys.readouterr().out


def test_coverage_reports(spark):
    got = {(r.path, r.line): (r.hits, r.degraded) for r in coverage.lcov(spark.createDataFrame([("l", LCOV)], "report string, text string")).collect()}
    assert got == {("src/a.py", 1): (1, True), ("src/a.py", 2): (3, True), ("b.py", 1): (0, True)}
    assert [(r.path, r.line, r.hits) for r in coverage.cobertura(spark.createDataFrame([("x", XML)], "report string, text string")).orderBy("line").collect()] == [("src/a.py", 1, 2), ("src/a.py", 2, 0)]
    with pytest.raises(ValueError):
        coverage.parse_cobertura("<a>" * 70 + "</a>" * 70)
    assert [coverage.sniff(x) for x in (b"<x/>", b"SF:a", b"\xff\xfe", b"hello")] == ["cobertura", "lcov", "unreadable", "unrecognized"]


def test_settings(spark, tmp_path):
    assert settings.policy_from("schema_version = 1\n[loop]\niteration_cap = 5\n") == Policy(iteration_cap=5)
    for bad in ("schema_version = 2\n", "[loop]\nwhat = 1\n", "[nothing]\nx = 1\n"):
        with pytest.raises(ValueError):
            settings.policy_from(bad)
    assert settings.policy_hash(Policy()) != settings.policy_hash(Policy(iteration_cap=5))
    (tmp_path / "process.toml").write_text('[[metric]]\nmetric_id = "m"\nclaim_id = "c"\n[[claim]]\nclaim_id = "c"\ntier = "A"\nexpiry = "2025-01-01"\n')
    metrics, claims = settings.registry(spark, str(tmp_path))
    assert metrics.first().metric_id == "m" and str(claims.first().expiry) == "2025-01-01"
    assert api.explain_finding(metrics.withColumn("class", F.lit("diff-actionable")), claims, "m").first().reach == "critical"


def test_ledger_files(spark, tmp_path):
    path = str(tmp_path / "ledger")
    one = spark.createDataFrame([(2, "self-report", "complete")], "schema_version int, record_kind string, completeness string")
    records.append(one, path)
    records.append(one.withColumn("completeness", F.lit("partial")), path)
    assert sorted(r.completeness for r in records.read_records(spark, path).collect()) == ["complete", "partial"]
    records.merge(spark, path, path, str(tmp_path / "merged"))
    assert spark.read.text(str(tmp_path / "merged")).count() == 2
    (tmp_path / "bad.json").write_text('{"schema_version": \n')
    with pytest.raises(Exception):
        records.read_records(spark, str(tmp_path / "bad.json")).collect()


def test_store(spark, tmp_path):
    store = records.Store(spark, str(tmp_path), 1)
    assert store.get("k", "r") is None
    assert store.read_through("k", lambda: spark.range(3), "r").count() == 3
    assert store.get("k", "other") is None and records.Store(spark, str(tmp_path), 2).get("k", "r") is None


def test_reports(spark):
    rows = spark.createDataFrame([("low", "m", "<a>", "1", "complete", "diff-actionable"), ("high", "n", "b", "2", "complete", "diff-actionable"), ("info", "o", "c", None, "unwitnessed", "diff-actionable")], "severity string, metric_id string, scope_label string, value_label string, completeness string, metric_class string")
    page = records.html_report(rows, "t<")
    assert "&lt;a&gt;" in page and "<title>t&lt;" in page and page.index(">n<") < page.index(">m<")
    assert records.terminal_report(rows).splitlines()[0].startswith("high") and records.terminal_report(rows).splitlines()[-1].startswith("absent")
    row = records.redact(spark.createDataFrame([("/home/x/y and /home/x",)], "t string"), "t", ["/home/x", "/home/x/y"]).first()
    assert (row.t, row.redactions) == ("<redacted> and <redacted>", 2)


def test_suite_runs(spark, tmp_path):
    from changeloom.sources.suite import suite_results

    rows = lambda command, limit=20: {r.metric_id: (r.kind, r.flag, r.said) for r in suite_results(spark, command, str(tmp_path), limit).collect()}
    assert rows("true")["tests.suite-failure"] == ("flag", False, None)
    assert rows("exit 3")["tests.suite-outcome"] == ("text", None, "exited 3")
    assert rows("sleep 30", 0.3)["tests.suite-failure"] == ("text", None, "timed out")


def test_notes_meet_over_a_remote(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", *a], check=True, capture_output=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    run("init", "-q", "--bare", str(tmp_path / "hub"))
    for name in ("one", "two"):
        run("clone", "-q", str(tmp_path / "hub"), str(tmp_path / name))
        for key in ("name", "email"):
            run("-C", str(tmp_path / name), "config", f"user.{key}", "x")
    run("-C", str(tmp_path / "one"), "commit", "-q", "--allow-empty", "-m", "c")
    run("-C", str(tmp_path / "one"), "push", "-q", "origin", "HEAD:main")
    run("-C", str(tmp_path / "two"), "pull", "-q", "origin", "main")
    for name in ("one", "two"):
        run("-C", str(tmp_path / name), "notes", "--ref=ledger", "add", "-m", f"line {name}", "HEAD")
    assert git.sync_notes(str(tmp_path / "one"), "ledger") == 1
    assert git.sync_notes(str(tmp_path / "two"), "ledger") == 1
    assert {r.line for r in git.notes(spark, str(tmp_path / "two"), "ledger").collect()} == {"line one", "line two"}
    assert {r.line for r in git.notes_history(spark, str(tmp_path / "two"), "ledger").collect()} == {"line one", "line two"}


def test_frozen_folder(tmp_path):
    (tmp_path / "a").write_text("x")
    first = settings.freeze_digest(str(tmp_path))
    (tmp_path / "a").write_text("y")
    assert first != settings.freeze_digest(str(tmp_path))
