"""What tools and the command line call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom import engines
from changeloom.operators import evidence, ledger, rules
from changeloom.sources import coverage, git, settings
from changeloom.sources import ledger as records


def change_of(spark: SparkSession, repo: str, base: str | None = None, head: str = "HEAD", window_days: int = 365) -> engines.Change:
    if base is None:
        found = git.resolve_base(repo)
        if found is None:
            raise LookupError("no base with a non-empty change")
        base = found[0]
    reports, _ = coverage.read_reports(spark, repo)
    return engines.Change(
        files=git.file_changes(spark, repo, base, head),
        touches=git.history(spark, repo, head, window_days),
        anchor_at=int(git.git(repo, "show", "-s", "--format=%ct", head)),
        coverage=reports,
        changed_lines=git.changed_lines(spark, repo, base, head),
    )


def measure_change(spark: SparkSession, repo: str, base: str | None = None, head: str = "HEAD", policy: rules.Policy | None = None) -> tuple[DataFrame, DataFrame]:
    change = change_of(spark, repo, base, head, (policy or rules.Policy()).window_days)
    used = [engines.StaticEngine(), engines.ClonesEngine(), engines.TamperEngine(), engines.ProcessEngine(), engines.ArtifactsEngine()]
    return engines.measure(spark, change, used, policy)


def get_results(results: DataFrame, text: str = "") -> DataFrame:
    return results.filter(F.contains("metric_id", F.lit(text)))


def explain_finding(metrics: DataFrame, claims: DataFrame, query: str, policy: rules.Policy | None = None) -> DataFrame:
    name = evidence.subject(metrics, query)
    return evidence.reach(metrics.filter(F.col("metric_id") == name), claims, policy or rules.Policy())


def get_ledger(spark: SparkSession, path: str, by: str = "author", where: str | None = None) -> DataFrame:
    entries = records.read_records(spark, path)
    if where:
        entries = ledger.where(entries, where)
    return ledger.slice_by(entries.withColumn("verdict", F.col("verdict.verdict")), by)


def load_registry(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return settings.registry(spark, folder)
