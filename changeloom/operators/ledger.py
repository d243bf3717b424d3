"""The ledger as a dataset: slices, distributions, clustering, report windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNRECORDED = "(unrecorded)"
DIMENSIONS = {
    "invocation-source": "invocation.source",
    "harness": "invocation.harness",
    "model": "invocation.model",
    "author": "invocation.author",
    "iteration": "invocation.iteration",
}


def dimension(column: str) -> Column:
    """A dimension's value as text; a missing one reads as (unrecorded)."""
    return F.coalesce(F.col(DIMENSIONS.get(column, column)).cast("string"), F.lit(UNRECORDED))


def where(entries: DataFrame, text: str) -> DataFrame:
    """Entries that a filter `<dimension>=<value>` keeps."""
    name, sign, value = text.partition("=")
    if not sign or not name:
        raise ValueError(f"a filter is <dimension>=<value>, not {text!r}")
    return entries.filter(dimension(name) == value)


def slice_by(entries: DataFrame, column: str, verdict: str = "verdict") -> DataFrame:
    """Records by dimension value and verdict."""
    return entries.groupBy(dimension(column).alias("value"), F.col(verdict).alias("verdict")).agg(F.count(F.lit(1)).alias("records"))


def _summaries(kind: Column, number: Column, flag: Column, decimals: int) -> list[Column]:
    numeric = kind.isin("count", "integer", "ratio", "duration")
    n = F.when(numeric, number)
    return [
        F.count(n).alias("numeric"),
        F.min(n).alias("min"),
        F.max(n).alias("max"),
        F.round(F.avg(n), decimals).alias("mean"),
        F.count_if((kind == "flag") & flag).alias("fired"),
        F.count_if((kind == "flag") & ~flag).alias("unfired"),
        F.count_if(kind == "text").alias("absent"),
    ]


def distribution(results: DataFrame, across_regimes: bool = False, decimals: int = 6) -> DataFrame:
    """Summaries of results(metric_id, regime_label, kind, number, flag) for each
    metric and regime. Regimes are not comparable: a pooled row (regime null,
    mixed true) comes only where across_regimes asks for it and a metric has
    several. `regimes` is their number, so that a caller can refuse to pool."""
    by = results.groupBy("metric_id", "regime_label").agg(*_summaries(F.col("kind"), F.col("number"), F.col("flag"), decimals))
    regimes = by.groupBy("metric_id").agg(F.count(F.lit(1)).alias("regimes"))
    by = by.join(regimes, "metric_id").withColumn("mixed", F.lit(False))
    if not across_regimes:
        return by
    several = regimes.filter("regimes > 1")
    pooled = results.join(several.select("metric_id"), "metric_id", "left_semi")
    pooled = pooled.groupBy("metric_id").agg(*_summaries(F.col("kind"), F.col("number"), F.col("flag"), decimals)).join(several, "metric_id")
    return by.unionByName(pooled.withColumn("regime_label", F.lit(None).cast("string")).withColumn("mixed", F.lit(True)))


def clustering(values: DataFrame, rungs: DataFrame, min_in_band: int = 5, min_share: float = 0.5) -> DataFrame:
    """Rungs below which values crowd: values(metric_id, regime_label, kind,
    number) against rungs(metric_id, kind, at). The band is [at - max(a tenth of
    at, 1), at), without the least width for ratios. Zeros of counts and ratios
    are left out, and bands that hold zero passed over. The rungs are a policy's
    few thresholds, an ordinary join key on metric_id and kind."""
    tenth = F.col("at") * F.lit(0.1)
    floor = F.col("at") - F.when(F.col("kind") == "ratio", tenth).otherwise(F.greatest(tenth, F.lit(1.0)))
    counted = values.filter(~(F.col("kind").isin("count", "ratio") & (F.col("number") == 0)))
    bands = rungs.withColumn("floor", floor).filter("NOT (floor <= 0 AND at > 0)")
    band = (F.col("number") >= F.col("floor")) & (F.col("number") < F.col("at"))
    return (
        counted.join(bands, ["metric_id", "kind"])
        .groupBy("metric_id", "regime_label", "at")
        .agg(F.count_if(band).alias("in_band"), F.count(F.lit(1)).alias("total"))
        .filter((F.col("in_band") >= min_in_band) & (F.col("in_band") >= F.col("total") * min_share))
    )


def report_window(entries: DataFrame, since: Column, until: Column) -> DataFrame:
    """One row over entries(stamp, self_report, head_oid, med_plus, escalated):
    those inside [since, until], undated ones, reports by others, distinct
    changes, changes of medium severity or more, escalations, and the rates,
    null where there is nothing to divide by."""
    inside = F.col("self_report") & F.col("stamp").between(since, until)
    days = (until - since) / F.lit(86_400.0)
    out = entries.agg(
        F.count_if(inside).alias("in_window"),
        F.count_if(F.col("self_report") & F.col("stamp").isNull()).alias("undated"),
        F.count_if(~F.col("self_report")).alias("non_self"),
        F.count_distinct(F.when(inside, F.col("head_oid"))).alias("changes"),
        F.count_distinct(F.when(inside & F.col("med_plus"), F.col("head_oid"))).alias("med_plus_changes"),
        F.count_if(inside & F.col("escalated")).alias("escalations"),
    )
    return out.select(
        "*",
        F.round(F.try_divide(F.col("escalations"), F.try_divide(days, F.lit(7.0))), 6).alias("escalations_per_week"),
        F.round(F.try_divide(F.col("med_plus_changes"), F.col("changes")), 6).alias("med_plus_rate"),
    )


def split_families(results: DataFrame) -> DataFrame:
    """Families measured under more than one regime."""
    return results.groupBy("family").agg(F.count_distinct("regime_label").alias("regimes")).filter("regimes > 1")


def stamped(records: DataFrame, landing: DataFrame) -> DataFrame:
    """Records(line, ...) with the time their line landed, null if undated."""
    return records.join(landing, "line", "left")


def merge_lines(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of distinct lines."""
    return a.union(b).distinct()


def migrate(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """Target rows, and those of source whose key target lacks."""
    return target.unionByName(source.join(target.select(*key).distinct(), key, "left_anti"))


def p95(frame: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Nearest-rank 95th percentile: the least value up to which 95 of 100 lie.
    Values are counted with map-side combine first; what is sorted in a group is
    its distinct values, which spill, where a percentile aggregate holds them."""
    counts = frame.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    group = W.partitionBy(*by)
    ranked = counts.withColumns({"__upto": F.sum("__n").over(group.orderBy(value)), "__all": F.sum("__n").over(group)})
    found = ranked.filter(F.col("__upto") * 100 >= F.col("__all") * 95).groupBy(*by).agg(F.min(value).alias("p95"))
    keys = frame.select(*by).distinct()
    same = reduce(Column.__and__, [keys[c].eqNullSafe(found[c]) for c in by])
    return keys.join(found, same, "left").select(*[keys[c] for c in by], "p95")


#: Attestations from best to worst (fixed values).
ATTESTATION_ORDER = [
    "confirmed",
    "confirmed-static",
    "unwitnessed",
    "unwitnessed-version-skew",
    "unwitnessed-base-mismatch",
    "unwitnessed-uncommitted",
    "divergent",
]


def worst_of(records: DataFrame, key: list[str], rank: str, ordinal: str) -> DataFrame:
    """The row of highest rank of each key; of equals, the first by ordinal."""
    row = F.struct(*[F.col(c) for c in records.columns])
    return records.groupBy(*key).agg(F.max_by(row, F.struct(F.col(rank), -F.col(ordinal))).alias("__row")).select("__row.*")


def trailer_digests(messages: DataFrame, name: str, message: str = "message") -> DataFrame:
    """(…, digest): the 64-digit digests of `<name>: <hex>` lines, lower-cased."""
    found = F.regexp_extract_all(message, F.lit(rf"(?m)^{name}: ([0-9A-Fa-f]{{64}})[ \t]*$"), F.lit(1))
    return messages.withColumn("digest", F.explode(F.transform(found, F.lower)))
