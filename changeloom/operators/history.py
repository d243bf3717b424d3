"""Change history: churn, code age, ownership, hotspots and change coupling over
a table of touches (oid, committed_at, author_key, path, added, deleted)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400


def in_window(touches: DataFrame, anchor_at: int | Column, window_days: int) -> DataFrame:
    """Touches up to window_days before the anchor, the bound included."""
    anchor = anchor_at if isinstance(anchor_at, Column) else F.lit(anchor_at)
    return touches.filter(F.col("committed_at") >= anchor - window_days * DAY)


def path_history(touches: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """A row for each path: commits, churned lines, text and binary touches, last
    commit time. A touch without line counts is binary. With `paths`, paths that
    no commit touched are there with zeros and a null last time."""
    text = F.col("added").isNotNull() & F.col("deleted").isNotNull()
    found = touches.groupBy("path").agg(
        F.count(F.lit(1)).alias("commits"),
        F.coalesce(F.sum(F.when(text, F.col("added") + F.col("deleted"))), F.lit(0)).alias("churn_lines"),
        F.count_if(text).alias("text_touches"),
        F.count_if(~text).alias("binary_touches"),
        F.max("committed_at").alias("last_at"),
    )
    if paths is None:
        return found
    zeros = {c: 0 for c in ("commits", "churn_lines", "text_touches", "binary_touches")}
    return paths.select("path").distinct().join(found, "path", "left").fillna(zeros)


def age_days(anchor_at: Column, last_at: Column) -> Column:
    """Whole days since the last commit, 0 at least; null if there was none."""
    return F.when(last_at.isNotNull(), F.greatest(F.lit(0).cast("long"), F.floor((anchor_at - last_at) / DAY)))


def ownership_entropy(touches: DataFrame, path: str = "path", author: str = "author_key", decimals: int = 6) -> DataFrame:
    """Shannon entropy in bits of the authors of each path: two levels of
    partial aggregation, never a list of authors."""
    counts = touches.groupBy(path, author).agg(F.count(F.lit(1)).alias("__c"))
    weighted = F.sum(F.col("__c") * F.log2(F.col("__c").cast("double")))
    total = F.sum("__c")
    return counts.groupBy(path).agg(
        total.alias("touches"),
        F.count(F.lit(1)).alias("owners"),
        F.round(F.greatest(F.lit(0.0), F.log2(total.cast("double")) - weighted / total), decimals).alias("entropy"),
    )


def hotspots(history: DataFrame, complexity: DataFrame) -> DataFrame:
    """commits x the largest complexity of the path; null without complexity."""
    worst = complexity.groupBy("path").agg(F.max("complexity").alias("complexity"))
    return history.join(worst, "path", "left").withColumn("hotspot", F.col("commits") * F.col("complexity"))


def coupled_absent(touches: DataFrame, change: DataFrame, max_paths: int = 25, min_support: int = 3) -> DataFrame:
    """For each changed path, how many partners usually change with it but are
    not in the change. Commits of more than max_paths paths don't count; a
    partner has min_support shared commits, in half of the path's at least.

    The size filter comes first, so that a commit yields at most max_paths pairs
    for a target; the targets are the change's paths alone."""
    small = touches.groupBy("oid").agg(F.count_distinct("path").alias("__n")).filter(F.col("__n") <= max_paths).select("oid")
    eligible = touches.select("oid", "path").distinct().join(small, "oid", "left_semi")
    wanted = change.select("path").distinct()
    targets = eligible.join(wanted, "path", "left_semi").withColumnRenamed("path", "target")
    totals = targets.groupBy("target").agg(F.count(F.lit(1)).alias("eligible"))
    pairs = targets.join(eligible.withColumnRenamed("path", "partner"), "oid").filter("target <> partner")
    support = pairs.groupBy("target", "partner").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= min_support)
    absent = support.join(wanted.withColumnRenamed("path", "partner"), "partner", "left_anti")
    strong = absent.join(totals, "target").filter(F.col("support") * 2 >= F.col("eligible"))
    counts = strong.groupBy("target").agg(F.count(F.lit(1)).alias("coupled_absent"))
    return wanted.withColumnRenamed("path", "target").join(counts, "target", "left").fillna({"coupled_absent": 0})


def landing_times(notes: DataFrame) -> DataFrame:
    """When each line was first seen: notes(line, committed_at)."""
    return notes.groupBy("line").agg(F.min("committed_at").alias("landed_at"))
