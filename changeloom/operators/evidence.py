"""The evidence registry: resolving results to claims, integrity checks, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registries are authored by hand; over this many rows they are not broadcast.
BROADCAST_ROWS = 100_000


def small(frame: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """frame with a broadcast hint if it has `most` rows or fewer; its size is
    counted, and beyond that the planner chooses."""
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame


def resolve(results: DataFrame, metrics: DataFrame, claims: DataFrame, as_of: Column) -> DataFrame:
    """Results with their claim's tier, citation, limits and staleness."""
    rows = results.join(small(metrics.select("metric_id", "claim_id")), "metric_id", "left")
    rows = rows.join(small(claims.select("claim_id", "tier", "citation", "does_not_predict", "expiry")), "claim_id", "left")
    return rows.withColumn("stale", as_of > F.col("expiry"))


def unresolved(results: DataFrame, metrics: DataFrame, claims: DataFrame) -> DataFrame:
    """Metrics of results that no registry row or no claim backs; a measurement
    with any is refused."""
    known = metrics.join(claims.select("claim_id").distinct(), "claim_id", "left_semi").select("metric_id").distinct()
    return results.select("metric_id").distinct().join(known, "metric_id", "left_anti")


def with_limits(results: DataFrame, own: str, claimed: str) -> DataFrame:
    """The claim's limits that the result doesn't state, appended."""
    return results.withColumn(own, F.array_union(F.coalesce(own, F.array().cast("array<string>")), F.coalesce(claimed, F.array().cast("array<string>"))))


def integrity(metrics: DataFrame, claims: DataFrame, as_of: Column, budget: int = 24, a_month: int = 3) -> DataFrame:
    """(code, subject, fatal) for what is wrong with a registry."""
    row = lambda code, subject, fatal: (F.lit(code).alias("code"), subject.cast("string").alias("subject"), F.lit(fatal).alias("fatal"))
    claim_ids, used = claims.select("claim_id").distinct(), metrics.select("claim_id").distinct()
    parts = [
        metrics.join(claim_ids, "claim_id", "left_anti").select(*row("registry.unmapped-metric", F.col("metric_id"), True)),
        claims.join(used, "claim_id", "left_anti").select(*row("registry.unused-claim", F.col("claim_id"), False)),
        metrics.groupBy("metric_id").count().filter("count > 1").select(*row("registry.duplicate-metric", F.col("metric_id"), True)),
        claims.groupBy("claim_id").count().filter("count > 1").select(*row("registry.duplicate-claim", F.col("claim_id"), True)),
        claims.filter(as_of > F.col("expiry")).select(*row("registry.stale-claim", F.col("claim_id"), False)),
        claims.groupBy(F.date_format("expiry", "yyyy-MM").alias("m")).count().filter(F.col("count") > a_month).select(*row("registry.expiry-stagger", F.col("m"), False)),
        claims.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > budget).select(*row("registry.claim-budget", F.col("n"), True)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def conformance(declared: DataFrame, registered: DataFrame, fields: list[str]) -> DataFrame:
    """Metrics that an engine and the registry don't declare alike: (metric_id,
    in_engine, in_registry, differs)."""
    a = declared.select("metric_id", F.struct(*fields).alias("a"))
    b = registered.select("metric_id", F.struct(*fields).alias("b"))
    both = a.join(b, "metric_id", "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select(
        "metric_id",
        F.col("a").isNotNull().alias("in_engine"),
        F.col("b").isNotNull().alias("in_registry"),
        (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("differs"),
    )


def accounting(expected: DataFrame, succeeded: DataFrame, failed: DataFrame, key: str = "engine_id") -> DataFrame:
    """Engines that aren't accounted for exactly once: (key, expected, times)."""
    seen = succeeded.select(key).unionAll(failed.select(key)).groupBy(key).agg(F.count(F.lit(1)).alias("times"))
    both = expected.select(key).distinct().withColumn("expected", F.lit(True)).join(seen, key, "full_outer")
    return both.select(key, F.coalesce("expected", F.lit(False)).alias("expected"), F.coalesce("times", F.lit(0)).alias("times")).filter("NOT (expected AND times = 1)")


def expiring(claims: DataFrame, more_than: int) -> DataFrame:
    """Months in which more than so many claims expire."""
    return claims.groupBy(F.date_format("expiry", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("claims")).filter(F.col("claims") > more_than)


def cited_stale(results: DataFrame, stale_claims: DataFrame) -> DataFrame:
    """Stale claims behind results above info or fired."""
    return results.filter((F.col("severity") != "info") | F.coalesce("flag", F.lit(False))).select("claim_id").distinct().join(stale_claims.select("claim_id"), "claim_id", "left_semi")


def subject(metrics: DataFrame, query: str) -> str:
    """The metric a query names: exactly, or the only one that contains it."""
    if not metrics.filter(F.col("metric_id") == query).isEmpty():
        return query
    found = [r.metric_id for r in metrics.select("metric_id").distinct().filter(F.contains("metric_id", F.lit(query))).orderBy("metric_id").limit(2).collect()]
    if len(found) != 1:
        raise LookupError(f"{query!r} names {'no' if not found else 'more than one'} metric")
    return found[0]


def reach(metrics: DataFrame, claims: DataFrame, policy) -> DataFrame:
    """The claim card of each metric and the highest severity it may reach."""
    from changeloom.functions.scalars import severity_name
    from changeloom.operators.rules import ceiling_rank

    rows = metrics.join(small(claims), "claim_id", "left")
    return rows.withColumn("reach", severity_name(ceiling_rank(F.lit("complete"), F.col("tier"), F.col("class"), policy)))


def confusion(cases: DataFrame, detectors: DataFrame, fired: DataFrame) -> DataFrame:
    """For each detector over cases(id, expect array) and fired(id, signal): true
    and false positives and negatives, precision and recall (null without a
    denominator). Cases times detectors is the grid itself: a handful of
    detectors, so the join is a broadcast of theirs."""
    from changeloom.functions.scalars import quantize_ratio

    grid = cases.join(small(detectors.select("signal")), F.lit(True))
    hits = fired.select("id", "signal").distinct().withColumn("hit", F.lit(True))
    rows = grid.join(hits, ["id", "signal"], "left").select("signal", F.array_contains("expect", F.col("signal")).alias("want"), F.coalesce("hit", F.lit(False)).alias("hit"), (F.size("expect") > 0).alias("adversarial"))
    out = rows.groupBy("signal").agg(
        F.count_if(F.col("want") & F.col("hit")).alias("tp"),
        F.count_if(~F.col("adversarial") & F.col("hit")).alias("fp"),
        F.count_if(F.col("want") & ~F.col("hit")).alias("fn"),
        F.count_if(~F.col("adversarial") & ~F.col("hit")).alias("tn"),
        F.count_if(F.col("adversarial") & ~F.col("want") & F.col("hit")).alias("cross_fires"),
    )
    tp = F.col("tp").cast("double")
    return out.withColumn("precision", quantize_ratio(F.try_divide(tp, F.col("tp") + F.col("fp")))).withColumn("recall", quantize_ratio(F.try_divide(tp, F.col("tp") + F.col("fn"))))


def budgets(totals: DataFrame, limits: DataFrame) -> DataFrame:
    """Per-language parse totals against budgets: languages over a ratio, without
    a budget, or with a budget and no files."""
    both = totals.join(limits, "language", "full_outer")
    files = F.try_divide(F.col("degraded_files").cast("double"), F.col("files"))
    nodes = F.try_divide(F.col("error_nodes").cast("double"), F.col("total_nodes"))
    problem = (
        F.when(F.col("max_degraded_file_ratio").isNull(), "no-budget")
        .when(F.col("files").isNull(), "surplus-budget")
        .when(files > F.col("max_degraded_file_ratio"), "degraded-files")
        .when(nodes > F.col("max_error_node_ratio"), "error-nodes")
    )
    return both.withColumn("problem", problem).filter(F.col("problem").isNotNull())
