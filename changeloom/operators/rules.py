"""Severities, ceilings and verdicts as declarative rules over result rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.functions.scalars import completeness_rank, rank_of, severity_name, severity_rank
from changeloom.schema import SEVERITIES

INFO, LOW, MEDIUM, HIGH, CRITICAL = range(5)

#: Inclusive thresholds by metric: (at, severity) (fixed values).
LADDERS: dict[str, list[tuple[float, str]]] = {
    "static.cyclomatic-complexity": [(11, "medium"), (21, "high"), (51, "critical")],
    "static.cognitive-complexity": [(15, "medium"), (25, "high"), (50, "critical")],
    "process.churn-commits": [(10, "low"), (30, "medium"), (60, "high")],
    "process.churn-lines": [(500, "low"), (2000, "medium"), (5000, "high")],
    "process.ownership-entropy": [(1.5, "low"), (2.5, "medium"), (3.5, "high")],
    "process.hotspot": [(100, "low"), (400, "medium"), (1000, "high")],
    "process.change-coupling": [(1, "low"), (3, "medium"), (5, "high")],
    "clones.duplicated-tokens": [(1, "low"), (250, "medium"), (1000, "high")],
    "clones.file-duplicated-tokens": [(1, "low"), (250, "medium"), (1000, "high")],
    "clones.largest-clone-tokens": [(1, "low"), (250, "medium"), (1000, "high")],
    "clones.clone-groups": [(1, "low"), (5, "medium"), (20, "high")],
    "clones.duplicated-token-ratio": [(0.05, "low"), (0.2, "medium"), (0.4, "high")],
    "artifacts.uncovered-changed-lines": [(1, "low"), (10, "medium"), (50, "high")],
}


@dataclass
class Policy:
    """What a policy file sets, with its defaults."""

    block_on_tamper: bool = True
    block_on_test_failure: bool = True
    max_severity_for_c_tier: str = "low"
    med_plus_requires_diff_actionable: bool = True
    med_plus_tiers: list[str] = field(default_factory=lambda: ["A", "B"])
    iteration_cap: int = 3
    count_context_informational: bool = False
    profile_bytes: int = 6000
    window_days: int = 365
    claim_budget: int = 24
    max_claims_expiring_per_month: int = 3


def check_ladders(ladders: dict[str, list[tuple[float, str]]]) -> None:
    """Thresholds and severities must both rise."""
    for metric, rungs in ladders.items():
        for (a, low), (b, high) in zip(rungs, rungs[1:], strict=False):
            if a >= b or SEVERITIES.index(low) >= SEVERITIES.index(high):
                raise ValueError(f"the ladder of {metric} doesn't rise at {b}")


def ladder_table(spark: SparkSession, ladders: dict[str, list[tuple[float, str]]] = LADDERS) -> DataFrame:
    check_ladders(ladders)
    rows = [(m, float(at), s, SEVERITIES.index(s)) for m, rungs in ladders.items() for at, s in rungs]
    return spark.createDataFrame(rows, "metric_id string, at double, severity string, rank int")


def severity_case(value: Column, rungs: list[tuple[float, str]]) -> Column:
    """A ladder as a CASE; a null value is an absence and Info."""
    out = F.lit("info")
    for at, severity in rungs:
        out = F.when(value >= at, severity).otherwise(out)
    return out


def severities(results: DataFrame, rungs: DataFrame, value: str = "value") -> DataFrame:
    """The same by a join with a table of rungs: highest rung reached by each
    (metric_id, value). Rungs are a policy's, a few rows; results are joined on
    metric_id to one row of rungs, so no result is multiplied."""
    arrays = rungs.groupBy("metric_id").agg(F.array_sort(F.collect_list(F.struct("at", "rank"))).alias("__rungs"))
    reached = F.array_max(F.transform(F.filter("__rungs", lambda r: F.col(value) >= r["at"]), lambda r: r["rank"]))
    return results.join(arrays, "metric_id", "left").withColumn("severity", severity_name(F.coalesce(reached, F.lit(0)))).drop("__rungs")


def ceiling_rank(completeness: Column, tier: Column, metric_class: Column, policy: Policy) -> Column:
    """The highest severity that completeness, evidence and class allow."""
    top = F.lit(CRITICAL)
    whole = F.when(completeness == "complete", CRITICAL).otherwise(LOW)
    backed = F.when(tier.isin(*policy.med_plus_tiers), CRITICAL).otherwise(LOW)
    c_tier = F.when(tier == "C", SEVERITIES.index(policy.max_severity_for_c_tier)).otherwise(CRITICAL)
    context = F.when(metric_class == "context-informational", LOW).otherwise(CRITICAL) if policy.med_plus_requires_diff_actionable else top
    return F.least(whole, backed, c_tier, context)


def clamp(results: DataFrame, policy: Policy) -> DataFrame:
    bound = ceiling_rank(F.col("completeness"), F.col("tier"), F.col("metric_class"), policy)
    return results.withColumn("severity", severity_name(F.least(severity_rank(F.col("severity")), bound)))


def demote(results: DataFrame, when: Column, completeness: str, caveat: str) -> DataFrame:
    """Lower completeness and severity, and put a caveat first, once."""
    first = F.when(F.array_contains("caveats", caveat), F.col("caveats")).otherwise(F.array_prepend("caveats", F.lit(caveat)))
    low = severity_name(F.least(severity_rank(F.col("severity")), F.lit(LOW)))
    return results.withColumns(
        {
            "caveats": F.when(when, first).otherwise(F.col("caveats")),
            "severity": F.when(when, low).otherwise(F.col("severity")),
            "completeness": F.when(when, F.lit(completeness)).otherwise(F.col("completeness")),
        }
    )


def weakest(results: DataFrame, by: list[str]) -> DataFrame:
    """The weakest completeness of each record."""
    return results.groupBy(*by).agg(F.min_by("completeness", completeness_rank(F.col("completeness"))).alias("completeness"))


def is_tamper_flag(family: Column, kind: Column, metric: Column) -> Column:
    return (family == "tamper") & (kind == "flag") & ~F.endswith(metric, F.lit(".magnitude"))


def verdicts(results: DataFrame, by: list[str], policy: Policy, escalated: Column | None = None, loosened: Column | None = None, justified: Column | None = None) -> DataFrame:
    """The verdict of each record over results(family, metric_id, kind, flag,
    severity, metric_class). One aggregation: which reasons hold decides.

    A fired tamper flag stops the line on the flag, whatever its severity; a
    threshold edit does not if the policy change is justified."""
    no = F.lit(False)
    rank = severity_rank(F.col("severity"))
    fired = is_tamper_flag(F.col("family"), F.col("kind"), F.col("metric_id")) & F.coalesce("flag", no)
    exempt = (F.col("metric_id") == "tamper.threshold-config-edit") & (justified if justified is not None else no)
    tamper_stops = fired & F.lit(policy.block_on_tamper) & ~exempt
    suite = (F.col("family") == "tests") & (F.col("metric_id") == "tests.suite-failure") & F.coalesce("flag", no)
    suite_stops = suite & F.lit(policy.block_on_test_failure)
    plain = ~fired & ~suite
    med_plus = plain & (rank >= MEDIUM)
    advisory = (plain & (rank > INFO) & (rank < MEDIUM)) | (fired & ~tamper_stops) | (suite & ~suite_stops)
    actionable = F.col("metric_class") == "diff-actionable"
    counts = F.when(fired, tamper_stops).otherwise(rank > INFO) & (actionable | F.lit(policy.count_context_informational))
    some = lambda c: F.coalesce(F.max(c), no)
    out = results.groupBy(*by).agg(
        some(tamper_stops).alias("tamper_signal"),
        some(suite_stops).alias("test_failure"),
        some(med_plus).alias("severity_med_plus"),
        some(advisory).alias("finding_advisory"),
        some(counts).alias("countable"),
        some(loosened if loosened is not None else no).alias("policy_change_loosening"),
        some(escalated if escalated is not None else no).alias("__escalated"),
    )
    stops = F.col("tamper_signal") | F.col("test_failure") | F.col("severity_med_plus") | F.col("policy_change_loosening")
    verdict = F.when(F.col("__escalated") & F.col("countable"), "escalate_to_human").when(stops, "block").when(F.col("finding_advisory"), "advise").otherwise("pass")
    codes = F.array_compact(
        F.array(
            F.when(F.col("tamper_signal"), "tamper-signal"),
            F.when(F.col("test_failure"), "test-failure"),
            F.when(F.col("severity_med_plus"), "severity-med-plus"),
            F.when(F.col("finding_advisory"), "finding-advisory"),
            F.when(F.col("policy_change_loosening"), "policy-change-loosening"),
        )
    )
    return out.withColumn("verdict", verdict).withColumn("reasons", codes).drop("__escalated")


def contradicted(records: DataFrame) -> DataFrame:
    """Records that pass although paths could not be read."""
    return records.filter((F.col("verdict") == "pass") & (F.size("unreadable_paths") > 0))


def loop_outcome(finished: Column, countable: Column) -> Column:
    return F.when(countable, "countable").when(finished, "finished").otherwise("inconclusive")


def fired_signals(results: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Distinct fired signals of each record in declared order."""
    name = F.regexp_replace("metric_id", r"^tamper\.", "")
    fired = results.filter(is_tamper_flag(F.col("family"), F.col("kind"), F.col("metric_id")) & F.col("flag"))
    ranked = fired.groupBy(*by).agg(F.array_sort(F.collect_set(F.struct(rank_of(name, order).alias("k"), name.alias("name")))).alias("s"))
    return ranked.select(*by, F.transform("s", lambda x: x["name"]).alias("signals"))
