"""Duplicate code: n-gram windows of token streams, seed pairs, diagonals.

Tokens are (file, pos, symbol). Windows are hashed by Spark's xxhash64 over
ordered arrays; hash values never leave this module. Two windows at one diagonal
(file a, file b, pos b - pos a) that follow each other are one longer match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changeloom.sources.tables import cut

WINDOW, LEAST, OCCURRENCES = 25, 50, 32


def windows_of(streams: DataFrame, size: int = WINDOW) -> DataFrame:
    """(file, pos, hash) of each window over streams(file, symbols array)."""
    n = F.size("symbols") - size
    starts = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    return streams.select("file", "symbols", F.explode(starts).alias("pos")).select("file", "pos", F.xxhash64(F.slice("symbols", F.col("pos") + 1, size)).alias("hash"))


def islands(frame: DataFrame, by: list[str], at: str, gap: int = 1) -> DataFrame:
    """Runs of values at most `gap` apart: by, start, end, length (values)."""
    w = W.partitionBy(*by).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    numbered = frame.select(*by, at).distinct().withColumn("__new", new)
    numbered = numbered.withColumn("__island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "__island").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("length")).drop("__island")


def longest_run(frame: DataFrame, by: list[str], at: str) -> DataFrame:
    """The longest run of consecutive values; of equals, the earliest."""
    return islands(frame, by, at).groupBy(*by).agg(F.max_by(F.struct("start", "length"), F.struct("length", -F.col("start"))).alias("r")).select(*by, "r.start", "r.length")


def seed_pairs(windows: DataFrame, most: int = OCCURRENCES) -> DataFrame:
    """Pairs of equal windows. A hash in at most `most` places yields all its
    pairs; a more frequent one is chained: each place with the next one in
    (file, pos) order, which keeps every place in some pair with work in
    proportion to the places. Frequencies are map-side aggregated."""
    counts = windows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = windows.join(counts, "hash")
    few, many = held.filter(F.col("n") <= most).drop("n"), held.filter(F.col("n") > most).drop("n")
    a = few.select("hash", F.col("file").alias("file_a"), F.col("pos").alias("pos_a"))
    b = few.select("hash", F.col("file").alias("file_b"), F.col("pos").alias("pos_b"))
    pairs = a.join(b, "hash").filter("struct(file_a, pos_a) < struct(file_b, pos_b)").drop("hash")
    after = W.partitionBy("hash").orderBy("file", "pos")
    chained = many.select(F.col("file").alias("file_a"), F.col("pos").alias("pos_a"), F.lead("file").over(after).alias("file_b"), F.lead("pos").over(after).alias("pos_b")).filter("file_b IS NOT NULL")
    return pairs.unionByName(chained)


def matches(pairs: DataFrame, size: int = WINDOW, least: int = LEAST) -> DataFrame:
    """Maximal matches of `least` tokens or more: (file_a, start_a, file_b,
    start_b, tokens). A match in one file is clipped to its own offset."""
    diagonal = pairs.withColumn("offset", F.col("pos_b") - F.col("pos_a"))
    runs = islands(diagonal, ["file_a", "file_b", "offset"], "pos_a")
    tokens = F.col("length") + size - 1
    clipped = F.when(F.col("file_a") == F.col("file_b"), F.least(tokens, F.col("offset"))).otherwise(tokens)
    return runs.select("file_a", F.col("start").alias("start_a"), "file_b", (F.col("start") + F.col("offset")).alias("start_b"), clipped.alias("tokens")).filter(F.col("tokens") >= least)


def covered_tokens(found: DataFrame) -> DataFrame:
    """Duplicated tokens of each file: the union of all match spans."""
    spans = found.select(F.col("file_a").alias("file"), F.col("start_a").alias("start"), "tokens").union(found.select("file_b", "start_b", "tokens"))
    w = W.partitionBy("file").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select("file", "start", (F.col("start") + F.col("tokens")).alias("end")).distinct()
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(w), F.col("start"))))
    return spans.withColumn("fresh", fresh).groupBy("file").agg(F.sum("fresh").alias("duplicated"))


def duplicated_tokens(streams: DataFrame, least: int = LEAST) -> DataFrame:
    """Exactly the tokens of each file that a duplicate of `least` tokens or more
    covers: a window of that size counts if an equal one is in another file, or
    in the same file without overlap. No pairs: each window meets one row of its
    hash, so a window that a third of all files share costs no more than others."""
    windows = windows_of(streams, least)
    spread = windows.groupBy("hash").agg(F.min(F.struct("file", "pos")).alias("low"), F.max(F.struct("file", "pos")).alias("high")).filter("low <> high")
    held = windows.join(spread, "hash")
    apart = (F.col("low.file") != F.col("high.file")) | (F.col("pos") - F.col("low.pos") >= least) | (F.col("high.pos") - F.col("pos") >= least)
    runs = islands(held.filter(apart).select("file", "pos"), ["file"], "pos", gap=least)
    return runs.groupBy("file").agg(F.sum(F.col("end") - F.col("start") + least).alias("duplicated"))


def clone_summary(streams: DataFrame, size: int = WINDOW, least: int = LEAST) -> DataFrame:
    """One row: files, tokens, duplicated tokens, their ratio (0 when empty) and
    the largest clone."""
    found = matches(seed_pairs(windows_of(streams, size)), size, least)
    per_file = duplicated_tokens(streams, least)
    totals = streams.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.size("symbols")), F.lit(0)).alias("tokens"))
    dup = per_file.agg(F.coalesce(F.sum("duplicated"), F.lit(0)).alias("duplicated"))
    largest = found.agg(F.coalesce(F.max("tokens"), F.lit(0)).alias("largest"))
    ratio = F.when(F.col("tokens") > 0, F.round(F.col("duplicated") / F.col("tokens"), 6)).otherwise(0.0)
    return totals.join(dup, F.lit(True)).join(largest, F.lit(True)).withColumn("ratio", ratio)  # three rows of one each


def disjoint_groups(found: DataFrame) -> DataFrame:
    """Matches chosen greedily, longest first, so that none shares a token with
    an earlier choice. Order matters within files that matches connect, so each
    connected component of files is solved in one place, and no more."""
    import pandas as pd

    files = found.select("file_a", "file_b").filter("file_a <> file_b").distinct()
    label = connected(files)
    rows = found.join(label.withColumnRenamed("file", "file_a"), "file_a", "left").withColumn("component", F.coalesce("component", "file_a"))

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        taken: dict = {}
        keep = []
        part = part.sort_values(["tokens", "file_a", "start_a", "file_b", "start_b"], ascending=[False, True, True, True, True])
        for row in part.itertuples():
            spans = [(row.file_a, row.start_a), (row.file_b, row.start_b)]
            free = all(s + row.tokens <= a or b <= s for f, s in spans for a, b in taken.get(f, ()))
            if free:
                for f, s in spans:
                    taken.setdefault(f, []).append((s, s + row.tokens))
            keep.append(free)
        return part[keep]

    return rows.groupBy("component").applyInPandas(choose, rows.schema).drop("component")


def connected(pairs: DataFrame, a: str = "file_a", b: str = "file_b") -> DataFrame:
    """(file, component): the smallest file reachable, by rounds of minima; each
    round is written until none changes."""
    links = pairs.select(F.col(a).alias("x"), F.col(b).alias("y"))
    links = links.union(links.select("y", "x")).distinct()
    links = cut(links, "file-links")
    label = links.select(F.col("x").alias("file")).distinct().withColumn("component", F.col("file"))
    while True:
        near = links.join(label, links.y == label.file).groupBy("x").agg(F.min("component").alias("near"))
        new = label.join(near, label.file == near.x, "left").select("file", F.least("component", F.coalesce("near", "component")).alias("component"), (F.col("near") < F.col("component")).alias("moved"))
        new = cut(new, "file-components")
        label = new.drop("moved")
        if new.filter("moved").isEmpty():
            return label


def incremental(previous: DataFrame, inputs: DataFrame, regime: str, tokenize) -> DataFrame:
    """An index of (path, blob_oid, regime, symbols) for inputs(path, blob_oid,
    content): entries of the same path, blob and regime are reused; tokenize gets
    the others alone. Dropped paths vanish. Equal to a cold rebuild."""
    wanted = inputs.select("path", "blob_oid")
    kept = previous.filter(F.col("regime") == regime).join(wanted, ["path", "blob_oid"], "left_semi")
    missed = inputs.join(kept.select("path", "blob_oid"), ["path", "blob_oid"], "left_anti")
    return kept.unionByName(tokenize(missed).withColumn("regime", F.lit(regime)).select(*previous.columns))


def brackets(frame: DataFrame, by: list[str], at: str) -> DataFrame:
    """For each row, the nearest values before and after it in its group."""
    w = W.partitionBy(*by).orderBy(at)
    return frame.withColumns({"before": F.max(at).over(w.rangeBetween(W.unboundedPreceding, -1)), "after": F.min(at).over(w.rangeBetween(1, W.unboundedFollowing))})


def regions(frame: DataFrame, by: list[str], at: str) -> DataFrame:
    """Numbers regions of positions: a new one where the gap passes the group's
    least gap."""
    w = W.partitionBy(*by).orderBy(at)
    gaps = frame.withColumn("gap", F.col(at) - F.lag(at).over(w)).withColumn("stride", F.min("gap").over(W.partitionBy(*by)))
    return gaps.withColumn("region", F.sum(F.when(F.col("gap") > F.col("stride"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
