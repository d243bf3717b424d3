"""Orders, top-k and byte budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changeloom.functions.scalars import severity_rank


def worst_first(results: DataFrame) -> list[Column]:
    """Severity down, diff-actionable first, metric, scope."""
    return [severity_rank(F.col("severity")).desc(), F.when(F.col("metric_class") == "diff-actionable", 0).otherwise(1), F.col("metric_id"), F.col("scope_label")]


def absences(results: DataFrame) -> DataFrame:
    return results.filter(F.col("completeness") == "unwitnessed").orderBy("metric_id", "scope_label")


def findings(results: DataFrame) -> DataFrame:
    return results.filter(F.col("completeness") != "unwitnessed").orderBy(*worst_first(results))


def fired(results: DataFrame) -> DataFrame:
    return results.filter((F.col("kind") == "flag") & F.col("flag")).orderBy("metric_id", "scope_label")


def row_order(results: DataFrame) -> DataFrame:
    return results.orderBy("metric_id", "scope", "digest", "deterministic")


def engine_order(results: DataFrame) -> DataFrame:
    return results.orderBy("engine_id", "ordinal")


def group_order(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.col("token_len").desc(), "fragments")


def top_of_each(frame: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group. Spark prunes each task's groups to k rows
    before the shuffle (a window group limit)."""
    return frame.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def byte_prefix(frame: DataFrame, by: list[str], order: list[Column], text: str, budget: int) -> DataFrame:
    """Rows of each group up to where their running bytes pass the budget."""
    running = F.sum(F.octet_length(text)).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return frame.withColumn("running_bytes", running).filter(F.col("running_bytes") <= budget)


def bounded_listing(frame: DataFrame, by: str, order: str, text: str, budget: int, share: float = 0.9) -> DataFrame:
    """Lines kept while they fit in a share of the budget: a line that doesn't
    fit is skipped, and later shorter ones may still fit. Rows of a group come in
    order and are streamed; the state is one number for each group."""
    limit = int(budget * share)
    sorted_rows = frame.repartition(by).sortWithinPartitions(by, order)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, used = None, 0
        for part in parts:
            keep = []
            for key, said in zip(part[by], part[text], strict=True):
                if key != group:
                    group, used = key, 0
                size = len(said.encode()) + 1
                fits = used + size < limit
                used += size * fits
                keep.append(fits)
            yield part[keep]

    return sorted_rows.mapInPandas(run, frame.schema)


def agent_profile(results: DataFrame, reasons: DataFrame, by: str, budget: int = 6000, max_reasons: int = 20, max_findings: int = 12) -> DataFrame:
    """A bounded view of each record: its first reasons by severity and code and
    findings by severity and metric, texts cut at 128 bytes, up to the first row
    that passes the byte budget."""
    from changeloom.functions.scalars import truncate_bytes

    severe = severity_rank(F.col("severity")).desc()
    one = top_of_each(reasons.select(by, F.lit(0).alias("part"), "severity", F.col("code").alias("name"), truncate_bytes(F.col("message"), 128).alias("said"), "ordinal"), [by], [severe, F.col("name"), F.col("ordinal")], max_reasons)
    two = top_of_each(results.select(by, F.lit(1).alias("part"), "severity", F.col("metric_id").alias("name"), truncate_bytes(F.col("scope_label"), 64).alias("said"), "ordinal"), [by], [severe, F.col("name"), F.col("ordinal")], max_findings)
    rows = one.unionByName(two).withColumn("line", F.to_json(F.struct("severity", "name", "said")))
    return byte_prefix(rows, [by], [F.col("part"), F.col("rank")], "line", budget).drop("ordinal")
