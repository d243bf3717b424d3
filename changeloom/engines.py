"""The extension surface: engines measure a change and yield result rows.

An engine declares its metrics; run() checks family and regime, assigns
severities from the ladders, and seals. Detectors are registered in
operators/detectors.py as functions of a file-changes table."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.functions.canonical import seal
from changeloom.operators import clones, detectors, history, rules, sourcecode
from changeloom.sources.coverage import CANDIDATES
from changeloom.sources.tables import cut

RESULT_COLUMNS = ["engine_id", "family", "metric_id", "claim_id", "metric_class", "scope", "scope_label", "kind", "number", "flag", "said", "completeness", "tier", "deterministic", "regime_label"]


@dataclass
class Change:
    """What engines read: changed files with both sides, history and coverage."""

    files: DataFrame
    touches: DataFrame | None = None
    anchor_at: int = 0
    coverage: DataFrame | None = None
    changed_lines: DataFrame | None = None


class ComplexitySource(Protocol):
    def __call__(self) -> DataFrame: ...


class Engine(ABC):
    """One family of metrics."""

    engine_id: str
    family: str
    regime: str
    metrics: dict[str, str]  # metric -> class

    @abstractmethod
    def measure(self, spark: SparkSession, change: Change) -> DataFrame:
        """Rows of (metric_id, path, kind, number, flag, said, completeness)."""

    def run(self, spark: SparkSession, change: Change, tiers: DataFrame | None = None) -> DataFrame:
        rows = cut(self.measure(spark, change), self.engine_id)
        known = F.array(*map(F.lit, self.metrics))
        checked = F.when(F.array_contains(known, F.col("metric_id")), F.col("metric_id")).otherwise(F.raise_error(F.concat(F.lit("undeclared metric "), F.col("metric_id"))).cast("string"))
        classes = F.create_map(*[F.lit(x) for pair in self.metrics.items() for x in pair])
        rows = rows.select(
            F.lit(self.engine_id).alias("engine_id"),
            F.lit(self.family).alias("family"),
            checked.alias("metric_id"),
            F.lit(None).cast("string").alias("claim_id"),
            classes[F.col("metric_id")].alias("metric_class"),
            F.struct(F.when(F.col("path").isNull(), "change").otherwise("file").alias("kind"), F.col("path")).alias("scope"),
            F.coalesce("path", F.lit("change")).alias("scope_label"),
            "kind",
            F.col("number").cast("double").alias("number"),
            "flag",
            F.col("said").cast("string").alias("said"),
            "completeness",
            F.lit("N").alias("tier"),
            F.lit(True).alias("deterministic"),
            F.lit(self.regime).alias("regime_label"),
        )
        if tiers is not None:
            rows = rows.drop("tier", "claim_id").join(tiers.select("metric_id", "claim_id", "tier"), "metric_id", "left").select(*RESULT_COLUMNS)
        ladders = rules.severities(rows, rules.ladder_table(spark), "number")
        fired = (F.col("kind") == "flag") & F.coalesce("flag", F.lit(False))
        by_flag = F.when(F.col("metric_id") == "tests.suite-failure", "critical").when(F.col("metric_id") == "tamper.threshold-config-edit", "low").otherwise("high")
        return seal(ladders.withColumn("severity", F.when(fired, by_flag).otherwise(F.col("severity"))))


def together(works: list[Callable[[], DataFrame]]) -> list[DataFrame]:
    """The results of works that each write a table, started side by side: a
    change is small, and most of its time is planning and waiting."""
    with ThreadPoolExecutor(len(works)) as pool:
        return [f.result() for f in [pool.submit(w) for w in works]]


def _row(metric: str, path, kind: str, number=None, flag=None, said=None, completeness="complete"):
    null = lambda t: F.lit(None).cast(t)
    return [
        F.lit(metric).alias("metric_id"),
        (path if path is not None else null("string")).alias("path"),
        F.lit(kind).alias("kind"),
        (number if number is not None else null("double")).cast("double").alias("number"),
        (flag if flag is not None else null("boolean")).alias("flag"),
        (said if said is not None else null("string")).alias("said"),
        (completeness if not isinstance(completeness, str) else F.lit(completeness)).alias("completeness"),
    ]


class StaticEngine(Engine):
    engine_id, family, regime = "static", "static", "static v1 spec 1 grammars [python=ast]"
    metrics = {"static.sloc": "context-informational", "static.parse-errors": "context-informational", "static.unmeasured-files": "context-informational"} | {
        f"static.{k}-complexity.python": "diff-actionable" for k in ("cyclomatic", "cognitive")
    }

    def measure(self, spark, change):
        facts = cut(sourcecode.file_facts(change.files.filter("head IS NOT NULL").select("path", F.col("head").alias("content"))), "facts")
        each = facts.select("path", "completeness", F.explode("functions").alias("f")).groupBy("path", "completeness").agg(F.max("f.cyclomatic").alias("cyclomatic"), F.max("f.cognitive").alias("cognitive"))
        out = facts.select(*_row("static.sloc", F.col("path"), "count", F.col("sloc"), completeness=F.col("completeness")))
        for k in ("cyclomatic", "cognitive"):
            out = out.union(each.select(*_row(f"static.{k}-complexity.python", F.col("path"), "count", F.col(k), completeness=F.col("completeness"))))
        faults = sourcecode.health(change.files).select(*_row("static.parse-errors", F.col("path"), "count", F.col("head_faults")))
        unmeasured = facts.filter("completeness <> 'complete'").agg(F.count(F.lit(1)).alias("n")).select(*_row("static.unmeasured-files", None, "count", F.col("n")))
        return out.union(faults).union(unmeasured)


class ClonesEngine(Engine):
    engine_id, family, regime = "clones", "clones", "clones v1 window-hash min-tokens 50 window 25 normalization 1"
    metrics = {f"clones.{m}": "diff-actionable" for m in ("duplicated-tokens", "duplicated-token-ratio", "file-duplicated-tokens", "clone-groups", "largest-clone-tokens")}

    def measure(self, spark, change):
        streams = cut(sourcecode.streams(change.files.filter("head IS NOT NULL").select("path", F.col("head").alias("content"))), "streams")
        total = clones.clone_summary(streams)
        groups = clones.disjoint_groups(clones.matches(clones.seed_pairs(clones.windows_of(streams)))).agg(F.count(F.lit(1)).alias("n"))
        out = total.select(*_row("clones.duplicated-tokens", None, "count", F.col("duplicated")))
        out = out.union(total.select(*_row("clones.duplicated-token-ratio", None, "ratio", F.col("ratio"))))
        out = out.union(total.select(*_row("clones.largest-clone-tokens", None, "count", F.col("largest"))))
        out = out.union(groups.select(*_row("clones.clone-groups", None, "count", F.col("n"))))
        return out.union(clones.duplicated_tokens(streams).select(*_row("clones.file-duplicated-tokens", F.col("file"), "count", F.col("duplicated"))))


class TamperEngine(Engine):
    engine_id, family, regime = "tamper", "tamper", "tamper v1 detectors 1 rules 1"
    metrics = {f"tamper.{s}{end}": "diff-actionable" for s in detectors.DETECTORS for end in ("", ".magnitude")}

    def measure(self, spark, change):
        found = detectors.detect(change.files, together)
        whole = F.when(F.size("unassessed") > 0, "partial").otherwise("complete")
        flags = found.select(*_row("", None, "flag", flag=F.col("fired"), completeness=whole), "signal").withColumn("metric_id", F.concat(F.lit("tamper."), "signal"))
        sizes = found.select(*_row("", None, "count", F.col("magnitude"), completeness=whole), "signal").withColumn("metric_id", F.concat(F.lit("tamper."), "signal", F.lit(".magnitude")))
        return flags.union(sizes).drop("signal")


class ProcessEngine(Engine):
    engine_id, family, regime = "process", "process", "process v1 git window 365d"
    metrics = {f"process.{m}": "context-informational" for m in ("churn-commits", "churn-lines", "code-age-days", "ownership-entropy", "hotspot", "change-coupling")}

    def __init__(self, complexity: ComplexitySource | None = None):
        self.complexity = complexity

    def measure(self, spark, change):
        paths = change.files.select("path")
        seen = history.path_history(change.touches, paths)
        out = seen.select(*_row("process.churn-commits", F.col("path"), "count", F.col("commits")))
        out = out.union(seen.select(*_row("process.churn-lines", F.col("path"), "count", F.col("churn_lines"))))
        out = out.union(seen.select(*_row("process.code-age-days", F.col("path"), "count", history.age_days(F.lit(change.anchor_at), F.col("last_at")))))
        entropy = history.ownership_entropy(change.touches.join(paths, "path", "left_semi"))
        out = out.union(entropy.select(*_row("process.ownership-entropy", F.col("path"), "ratio", F.col("entropy"))))
        coupled = history.coupled_absent(change.touches, paths)
        out = out.union(coupled.select(*_row("process.change-coupling", F.col("target"), "count", F.col("coupled_absent"))))
        if self.complexity:
            spots = history.hotspots(seen.select("path", "commits"), self.complexity())
            out = out.union(spots.filter("hotspot IS NOT NULL").select(*_row("process.hotspot", F.col("path"), "count", F.col("hotspot"))))
        return out


class ArtifactsEngine(Engine):
    engine_id, family, regime = "artifacts", "artifacts", "artifacts v1 parsers [cobertura=1,lcov=1]"
    metrics = {"artifacts.uncovered-changed-lines": "diff-actionable"}

    def measure(self, spark, change):
        from changeloom.operators.changes import match_paths, uncovered_lines

        cover = change.coverage.groupBy("report", "path", "line").agg(F.sum("hits").alias("hits"))
        order = cover.select("report").distinct().withColumn("priority", F.array_position(F.array(*map(F.lit, CANDIDATES)), F.col("report")))
        place = match_paths(change.changed_lines.select("path").distinct(), cover.select(F.col("path").alias("covered_path")))
        named = cover.join(order, "report").withColumnRenamed("path", "covered_path").join(place, "covered_path").select("path", "line", "hits", "priority")
        return uncovered_lines(change.changed_lines, named).select(*_row("artifacts.uncovered-changed-lines", F.col("path"), "count", F.col("uncovered")))


def measure(spark: SparkSession, change: Change, engines: list[Engine], policy: rules.Policy | None = None, tiers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, record): all engines' sealed and clamped results, and the one-row
    verdict over them. An engine that fails raises: its metrics would be absent."""
    change = replace(change, files=cut(change.files, "files"))
    out = None
    for part in together([lambda e=e: e.run(spark, change, tiers) for e in engines]):
        out = part if out is None else out.unionByName(part)
    out = cut(out, "results")
    policy = policy or rules.Policy()
    clamped = rules.clamp(out, policy).withColumn("value_label", F.coalesce(F.col("number").cast("string"), F.col("flag").cast("string"), F.col("said")))
    record = rules.verdicts(clamped.withColumn("record", F.lit(1)), ["record"], policy).drop("record")
    return clamped, record
