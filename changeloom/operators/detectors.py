"""Tamper detectors over file changes (path, old_path, kind, base, head binary).

Each returns one row: signal, fired, magnitude, findings (array of path, line,
text) and unassessed (array of path). Line work is done with array functions;
only parsing needs Python (sourcecode.py)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions.scalars import is_data_path, is_test_path
from changeloom.operators import configs, sourcecode
from changeloom.operators.changes import changed_content, key_moves, multiset_gain
from changeloom.sources.tables import cut

#: Substrings that mark a suppression, compared in lower case.
MARKERS = [
    "eslint-disable",
    "deno-lint-ignore",
    "oxlint-disable",
    "@ts-ignore",
    "@ts-expect-error",
    "@ts-nocheck",
    "biome-ignore",
    "prettier-ignore",
    "istanbul ignore",
    "c8 ignore",
    "v8 ignore",
    "noqa",
    "type: ignore",
    "pylint: disable",
    "pyright: ignore",
    "ruff: noqa",
    "flake8: noqa",
    "mypy: ignore-errors",
    "#[allow(",
    "nosec",
    "sonarignore",
    "no-inspection",
]
#: Smallest collection literal that counts as a table.
TABLE_ELEMENTS = 24


def density(markers: Column, lines: Column) -> Column:
    """Markers for a thousand lines, whole; without lines, the largest long if
    there are markers."""
    return F.when(lines > 0, F.floor(markers * 1000 / lines).cast("long")).when(markers > 0, F.lit((1 << 63) - 1)).otherwise(F.lit(0).cast("long"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def marked_lines(frame: DataFrame, text: str, markers: list[str] = MARKERS) -> DataFrame:
    """(…, line, said): the lines that hold a marker, numbered from 1."""
    out = frame.select(*[c for c in frame.columns if c != text], F.posexplode(lines_of(F.col(text))).alias("line", "said"))
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.contains(F.lower("said"), F.lit(m.lower()))
    return out.filter(hit).withColumn("line", F.col("line") + 1).withColumn("said", F.trim("said"))


def code_lines(text: Column) -> Column:
    return F.size(F.filter(lines_of(text), lambda x: F.trim(x) != "")).cast("long")


def _outcome(signal: str, facts: DataFrame, fired: Column, magnitude: Column, findings: DataFrame, unassessed: DataFrame | None = None) -> DataFrame:
    """facts is one row; findings are collected as a change's finite evidence."""
    found = findings.agg(F.array_sort(F.collect_list(F.struct("path", "line", "text"))).alias("findings"))
    row = facts.join(found, F.lit(True))
    if unassessed is not None:
        row = row.join(unassessed.agg(F.array_sort(F.collect_set("path")).alias("unassessed")), F.lit(True))
    else:
        row = row.withColumn("unassessed", F.array().cast("array<string>"))
    return row.select(F.lit(signal).alias("signal"), F.coalesce(fired, F.lit(False)).alias("fired"), F.coalesce(magnitude, F.lit(0)).cast("long").alias("magnitude"), "findings", "unassessed")


def suppression_density(files: DataFrame, least: int = 2) -> DataFrame:
    """Fires if two suppressions or more were added and their density rose."""
    files = changed_content(files)
    base, head = marked_lines(files.select("path", "base"), "base"), marked_lines(files.select("path", "head"), "head")
    added = F.col("head_markers") - F.col("base_markers")
    facts = files.agg(F.coalesce(F.sum(code_lines(F.col("base"))), F.lit(0)).alias("base_lines"), F.coalesce(F.sum(code_lines(F.col("head"))), F.lit(0)).alias("head_lines"))
    facts = facts.join(base.agg(F.count(F.lit(1)).alias("base_markers")), F.lit(True)).join(head.agg(F.count(F.lit(1)).alias("head_markers")), F.lit(True))
    fired = (added >= least) & (density(F.col("head_markers"), F.col("head_lines")) > density(F.col("base_markers"), F.col("base_lines")))
    gained = multiset_gain(base, head, ["path", "said"], ["line"]).select("path", "line", F.col("said").alias("text"))
    return _outcome("suppression-density", facts, fired, F.greatest(added, F.lit(0)), gained)


def parse_error_delta(files: DataFrame) -> DataFrame:
    """Fires if faults rose over all files, or a changed file is degraded."""
    health = sourcecode.health(changed_content(files))
    facts = health.agg(F.sum(F.col("head_faults") - F.col("base_faults")).alias("rise"), F.max((F.col("head_faults") > 0).cast("int")).alias("degraded"))
    found = health.filter("head_faults > 0").select("path", F.lit(1).alias("line"), F.concat(F.col("head_faults").cast("string"), F.lit(" parse faults")).alias("text"))
    return _outcome("parse-error-delta", facts, (F.col("rise") > 0) | (F.col("degraded") > 0), F.greatest("rise", F.lit(0)), found)


def test_removal(files: DataFrame) -> DataFrame:
    """Fires if the change has fewer tests than its base over all files, or a
    file more skipped ones."""
    counts = sourcecode.tests(changed_content(files))
    by_file = counts.groupBy("path").agg(
        F.count_if(F.col("side") == "base").alias("base"),
        F.count_if(F.col("side") == "head").alias("head"),
        (F.count_if((F.col("side") == "head") & F.col("skipped")) - F.count_if((F.col("side") == "base") & F.col("skipped"))).alias("skips"),
    )
    facts = by_file.agg((F.coalesce(F.greatest(F.sum("base") - F.sum("head"), F.lit(0)), F.lit(0)) + F.coalesce(F.sum(F.greatest("skips", F.lit(0))), F.lit(0))).alias("lost"))
    found = by_file.filter("head < base OR skips > 0").select("path", F.lit(1).alias("line"), F.concat_ws(" ", F.lit("tests"), F.col("base").cast("string"), F.lit("to"), F.col("head").cast("string")).alias("text"))
    return _outcome("test-removal", facts, F.col("lost") > 0, F.col("lost"), found)


def assertion_free_test(files: DataFrame) -> DataFrame:
    """Fires on test cases without an assertion beyond those of that name in the base."""
    cases = sourcecode.tests(changed_content(files).filter(is_test_path(F.col("path")))).filter("NOT asserts")
    base, head = (cases.filter(F.col("side") == s).drop("side") for s in ("base", "head"))
    new = multiset_gain(base, head, ["path", "name"], ["line"]).select("path", "line", F.col("name").alias("text"))
    facts = new.agg(F.count(F.lit(1)).alias("n"))
    return _outcome("assertion-free-test", facts, F.col("n") > 0, F.col("n"), new)


def lookup_table_blowup(files: DataFrame, least: int = TABLE_ELEMENTS) -> DataFrame:
    """Fires on a collection literal in a function, of `least` elements or more
    and larger than any in the base's file; not in tests or data."""
    files = changed_content(files).filter(~is_test_path(F.col("path")) & ~is_data_path(F.col("path")))
    tables = sourcecode.tables(files)
    had = tables.filter("side = 'base'").groupBy("path").agg(F.max("elements").alias("had"))
    new = tables.filter("side = 'head'").join(had, "path", "left").filter((F.col("elements") >= least) & (F.col("elements") > F.coalesce("had", F.lit(0))))
    facts = new.agg(F.count(F.lit(1)).alias("n"), F.max("elements").alias("largest"))
    return _outcome("lookup-table-blowup", facts, F.col("n") > 0, F.col("largest"), new.select("path", "line", F.concat(F.col("elements").cast("string"), F.lit(" elements")).alias("text")))


def threshold_config_edit(files: DataFrame) -> DataFrame:
    """Fires on a threshold, severity or strictness flag that a change loosens."""
    settings = configs.settings(changed_content(files).filter(configs.is_threshold_config(F.col("path"))))
    base, head = (settings.filter(F.col("side") == s) for s in ("base", "head"))
    lines = head.select("path", "key", "line")
    moves = key_moves(base, head, ["path", "key", "dialect"]).join(lines, ["path", "key"], "left")
    moves = moves.withColumn("bound", configs.bound(F.col("dialect"), F.col("key"), F.col("before"), F.col("after")))
    loose = moves.filter("bound = 'loosened'").select("path", F.coalesce("line", F.lit(0)).alias("line"), F.concat_ws(" ", "key", "before", F.lit("to"), "after").alias("text"))
    facts = loose.agg(F.count(F.lit(1)).alias("n"))
    return _outcome("threshold-config-edit", facts, F.col("n") > 0, F.col("n"), loose, moves.filter("bound = 'unranked'").select("path"))


def coverage_exclusion_drift(files: DataFrame) -> DataFrame:
    """Fires if a file's coverage exclusions grew or one was broadened."""
    entries = configs.exclusions(changed_content(files).filter(configs.is_coverage_config(F.col("path"))))
    base, head = (entries.filter(F.col("side") == s).drop("side") for s in ("base", "head"))
    added, removed = multiset_gain(base, head, ["path", "entry"], ["line"]), multiset_gain(head, base, ["path", "entry"], ["line"])
    grown = entries.groupBy("path").agg((F.count_if(F.col("side") == "head") - F.count_if(F.col("side") == "base")).alias("net")).filter("net > 0")
    pairs = added.join(removed.select("path", F.col("entry").alias("old")), "path").filter(configs.broader(F.col("entry"), F.col("old")))
    facts = grown.agg(F.coalesce(F.sum("net"), F.lit(0)).alias("net")).join(pairs.agg(F.count_distinct("path", "entry").alias("broadened")), F.lit(True))
    found = added.join(grown.select("path").union(pairs.select("path")).distinct(), "path", "left_semi").select("path", "line", F.col("entry").alias("text"))
    unranked = added.join(removed.select("path").distinct(), "path", "left_semi").join(pairs.select("path").distinct(), "path", "left_anti").join(grown, "path", "left_anti")
    return _outcome("coverage-exclusion-drift", facts, (F.col("net") > 0) | (F.col("broadened") > 0), F.col("net") + F.col("broadened"), found, unranked)


#: The declared order of the detectors; each takes files and gives one outcome row.
DETECTORS = {
    "suppression-density": suppression_density,
    "test-removal": test_removal,
    "threshold-config-edit": threshold_config_edit,
    "coverage-exclusion-drift": coverage_exclusion_drift,
    "assertion-free-test": assertion_free_test,
    "lookup-table-blowup": lookup_table_blowup,
    "parse-error-delta": parse_error_delta,
}


def detect(files: DataFrame, together: Callable[[list], list] | None = None) -> DataFrame:
    """All detectors' outcomes over one change, each written before they are
    joined. `together` may start them side by side."""
    works = [lambda run=run, name=name: cut(run(files), name) for name, run in DETECTORS.items()]
    return reduce(DataFrame.unionByName, together(works) if together else [w() for w in works])
