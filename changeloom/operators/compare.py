"""Comparing measurements of the same change: digest pairing, unpaired ids,
N-leg agreement, and the classification of a report against a recomputation.

Results are rows of (record, metric_id, scope, digest, deterministic, regime);
scope is a struct with null leaves, so keys are compared null-safely."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changeloom.sources.tables import cut


def first_of_key(results: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key by `order`; the aggregation combines map-side."""
    rest = [c for c in results.columns if c not in key]
    return results.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__r")).select(*key, "__r.*")


def paired(report: DataFrame, recompute: DataFrame, key: list[str]) -> DataFrame:
    """Inner pairing on the key, null-safe; other columns with prefixes r_ and v_."""
    a = report.select(*[F.col(c).alias(f"r_{c}") for c in report.columns])
    b = recompute.select(*[F.col(c).alias(f"v_{c}") for c in recompute.columns])
    on = F.lit(True)
    for c in key:
        on = on & F.col(f"r_{c}").eqNullSafe(F.col(f"v_{c}"))
    return a.join(b, on)


def unpaired(report: DataFrame, recompute: DataFrame, key: list[str], show: str) -> DataFrame:
    """Sorted distinct values of `show` on one side alone."""
    sides = report.select(*key, F.lit(1).alias("__r"), F.lit(0).alias("__v")).union(recompute.select(*key, F.lit(0), F.lit(1)))
    one = sides.groupBy(*key).agg(F.max("__r").alias("r"), F.max("__v").alias("v")).filter("r + v = 1")
    return one.select(show).distinct().orderBy(show)


def unwitnessed(report: DataFrame, recompute: DataFrame, key: list[str]) -> DataFrame:
    """Deterministic recomputed results that the report lacks."""
    on = [F.col(f"v.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key]
    return recompute.alias("v").filter("v.deterministic").join(report.select(*key).distinct().alias("r"), on, "left_anti")


def n_legs(legs: dict[str, DataFrame], key: list[str], digest: str = "digest") -> DataFrame:
    """A row for each key of any leg: legs that have it, distinct digests, and
    whether all legs agree. One union and one aggregation, whatever the number
    of legs."""
    every = None
    for name, leg in legs.items():
        part = leg.select(*key, F.col(digest).alias("__d")).withColumn("__leg", F.lit(name))
        every = part if every is None else every.unionByName(part)
    out = every.groupBy(*key).agg(F.count_distinct("__leg").alias("present"), F.count_distinct("__d").alias("digests"))
    return out.withColumn("agreed", (F.col("present") == len(legs)) & (F.col("digests") == 1))


def classify(uncommitted: Column, has_report: Column, fork_tier: Column, base_relation: Column, head_equal: Column, regime_equal: Column, mismatched: Column, pairs: Column, missing: Column) -> Column:
    """The attestation of a report against a recomputation; the first case that
    holds. mismatched, pairs and missing are numbers of results."""
    return (
        F.when(uncommitted, "unwitnessed-uncommitted")
        .when(~has_report & fork_tier, "confirmed-static")
        .when(~has_report, "unwitnessed")
        .when(base_relation.isin("not-ancestor", "unknown"), "divergent")
        .when((base_relation == "ancestor") | ~head_equal, "unwitnessed-base-mismatch")
        .when(~regime_equal, "unwitnessed-version-skew")
        .when(mismatched > 0, "divergent")
        .when((pairs == 0) | (missing > 0), "unwitnessed")
        .otherwise("confirmed")
    )


def compare_records(report: DataFrame, recompute: DataFrame, record: str, key: list[str]) -> DataFrame:
    """For each record: pairs, matched, mismatched, missing and whether regimes
    are equal; whether a digest counts is the verifier's flag."""
    both = paired(report, recompute, [record, *key])
    facts = both.groupBy(F.col(f"v_{record}").alias(record)).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.min(F.col("r_regime").eqNullSafe(F.col("v_regime"))).alias("regime_equal"),
        F.count_if(F.col("v_deterministic") & F.col("r_digest").eqNullSafe(F.col("v_digest"))).alias("matched"),
        F.count_if(F.col("v_deterministic") & ~F.col("r_digest").eqNullSafe(F.col("v_digest"))).alias("mismatched"),
        F.count_if(F.col("r_deterministic") != F.col("v_deterministic")).alias("flag_disagreements"),
    )
    missing = unwitnessed(report, recompute, [record, *key]).groupBy(record).agg(F.count(F.lit(1)).alias("missing"))
    out = recompute.select(record).distinct().join(facts, record, "left").join(missing, record, "left")
    zeros = {c: 0 for c in ("pairs", "matched", "mismatched", "flag_disagreements", "missing")}
    return out.fillna(zeros).fillna({"regime_equal": True})


def decide(classified: DataFrame, head: str = "head_oid", attestation: str = "attestation", ordinal: str = "ordinal", skews: int = 3) -> DataFrame:
    """The worst attestation of each head and whether repeated skews escalate."""
    from changeloom.functions.scalars import rank_of
    from changeloom.operators.ledger import ATTESTATION_ORDER

    ranked = classified.withColumn("__rank", rank_of(F.col(attestation), ATTESTATION_ORDER))
    soft = F.col(attestation).isin("unwitnessed-version-skew", "unwitnessed-base-mismatch")
    out = ranked.groupBy(head).agg(F.max_by(F.col(attestation), F.struct("__rank", -F.col(ordinal))).alias("attestation"), (F.count_if(soft) >= skews).alias("escalated"))
    verdict = (
        F.when(F.col("attestation") == "divergent", "block")
        .when(F.col("escalated"), "escalate_to_human")
        .when(F.startswith("attestation", F.lit("confirmed")), "pass")
        .otherwise("advise")
    )
    return out.withColumn("verdict", verdict)


def ancestors(parents: DataFrame, start: DataFrame, rounds: int = 10_000) -> DataFrame:
    """All ancestors of start(oid), itself included, by rounds over
    parents(oid, parent). Each round is cut, so that the plan stays short."""
    known = frontier = start.select("oid").distinct()
    for _ in range(rounds):
        step = frontier.join(parents, "oid").select(F.col("parent").alias("oid")).distinct().join(known, "oid", "left_anti")
        frontier = cut(step, "ancestors")
        if frontier.isEmpty():
            break
        known = known.union(frontier)
    return known


def base_relation(parents: DataFrame, claimed: str, trusted: str) -> str:
    """equal, ancestor, not-ancestor or unknown, of a claimed base to a trusted one."""
    if claimed == trusted:
        return "equal"
    spark = parents.sparkSession
    if parents.filter((F.col("oid") == claimed) | (F.col("parent") == claimed)).isEmpty():
        return "unknown"
    above = ancestors(parents, spark.createDataFrame([(trusted,)], "oid string"))
    return "not-ancestor" if above.filter(F.col("oid") == claimed).isEmpty() else "ancestor"


def ordinal(frame: DataFrame, by: list[str], order: list[str], out: str = "ordinal") -> DataFrame:
    """A running number within each group."""
    return frame.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
