"""Change sets: merging committed and uncommitted sides, deltas, coverage of
changed lines, and multiset differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changeloom.functions.scalars import under


def split_excluded(changes: DataFrame, patterns: list[str], path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(kept, withheld): changes outside and under the patterns."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | under(F.col(path), p)
    return changes.filter(~hit), changes.filter(hit)


def changed_content(files: DataFrame) -> DataFrame:
    """Without files whose two sides are equal bytes."""
    return files.filter(~(F.col("base").isNotNull() & F.col("head").isNotNull() & (F.col("base") == F.col("head"))))


def readable(changes: DataFrame, mode: str = "new_mode", oid: str = "new_oid") -> DataFrame:
    """Without gitlinks and null object ids."""
    return changes.filter((F.col(mode) != "160000") & ~F.col(oid).rlike("^0+$"))


def overlay(committed: DataFrame, dirty: DataFrame, key: str = "path", present_base: str = "base_oid", present_head: str = "head_oid") -> DataFrame:
    """Committed and uncommitted changes as one: the base side of the first, the
    head side of the second; what was added and then deleted again vanishes.
    Absent sides are null."""
    a = committed.select(F.col(key), F.col(present_base).alias("__ab"), F.col(present_head).alias("__ah"), F.lit(True).alias("__a"))
    b = dirty.select(F.col(key), F.col(present_base).alias("__bb"), F.col(present_head).alias("__bh"), F.lit(True).alias("__b"))
    both = a.join(b, key, "full_outer")
    base = F.when(F.col("__a").isNotNull(), F.col("__ab")).otherwise(F.col("__bb"))
    head = F.when(F.col("__b").isNotNull(), F.col("__bh")).otherwise(F.col("__ah"))
    out = both.select(key, base.alias(present_base), head.alias(present_head)).filter(F.col(present_base).isNotNull() | F.col(present_head).isNotNull())
    status = F.when(F.col(present_base).isNull(), "added").when(F.col(present_head).isNull(), "deleted").otherwise("modified")
    return out.withColumn("status", status)


def deltas(head: DataFrame, base: DataFrame, value: str = "value", language: str = "language") -> DataFrame:
    """head(path, old_path, language, value) with delta = head - base; null where
    the base lacks the path (the old one of a rename) or has another language."""
    old = base.select(F.col("path").alias("__path"), F.col(language).alias("__language"), F.col(value).alias("__value"))
    on = (F.coalesce(F.col("old_path"), F.col("path")) == F.col("__path")) & (F.col(language) == F.col("__language"))
    return head.join(old, on, "left").withColumn("delta", F.col(value) - F.col("__value")).drop("__path", "__language", "__value")


def match_paths(wanted: DataFrame, known: DataFrame, path: str = "path", covered: str = "covered_path") -> DataFrame:
    """For each wanted path, the covered path that is equal, else the only one
    that ends in `/` and it; null if none or several do. The suffix match is an
    equality join on exploded suffixes, not a theta join: a path has a few."""
    exact = known.select(F.col(covered).alias(path), F.col(covered).alias("__exact")).distinct()
    parts = F.split(F.col(covered), "/")
    tails = known.select(covered).distinct().select(
        covered,
        F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/")), lambda s: s != F.col(covered))).alias(path),
    )
    only = tails.groupBy(path).agg(F.count(F.lit(1)).alias("__n"), F.min(covered).alias("__only")).filter("__n = 1")
    return (
        wanted.join(exact, path, "left")
        .join(only.select(path, "__only"), path, "left")
        .withColumn(covered, F.coalesce("__exact", "__only"))
        .drop("__exact", "__only")
    )


def uncovered_lines(changed: DataFrame, coverage: DataFrame, priority: str = "priority") -> DataFrame:
    """For each changed path that a report covers: touched lines the report
    knows, and those with no hits. Of several reports the first that has the
    file counts; lines unknown to it are ignored."""
    first = coverage.groupBy("path").agg(F.min(priority).alias(priority))
    chosen = coverage.join(first, ["path", priority])
    both = changed.select("path", "line").distinct().join(chosen, ["path", "line"])
    return both.groupBy("path").agg(F.count(F.lit(1)).alias("covered_changes"), F.count_if(F.col("hits") == 0).alias("uncovered"))


def kth(frame: DataFrame, by: list[str], order: list[str], out: str = "k") -> DataFrame:
    return frame.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def multiset_gain(base: DataFrame, head: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Head rows beyond as many equal ones as base has: the k-th equal row is new
    if k is over base's count. Counts of base are aggregated map-side."""
    had = base.groupBy(*key).agg(F.count(F.lit(1)).alias("__had"))
    numbered = kth(head, key, order, "__k")
    return numbered.join(had, key, "left").filter(F.col("__k") > F.coalesce("__had", F.lit(0))).drop("__k", "__had")


def multiset_difference(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    return a.exceptAll(b), b.exceptAll(a)


def key_moves(base: DataFrame, head: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """Keys whose value moved or that went: (key, before, after), after null for
    a deletion. Added keys aren't moves."""
    a = base.select(*key, F.col(value).alias("before"))
    b = head.select(*key, F.col(value).alias("after"))
    return a.join(b, key, "left").filter(~F.col("before").eqNullSafe(F.col("after")))


def flatten_json(frame: DataFrame, text: str, id_cols: list[str]) -> DataFrame:
    """(ids, field, value): the leaves of a JSON object by dotted path, each as
    canonical JSON text. Arrays are leaves."""
    import json
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql import types as T

    from changeloom.functions.canonical import canonical

    def leaves(prefix: str, value) -> Iterator[tuple[str, str]]:
        stack = [(prefix, value)]
        while stack:
            at, v = stack.pop()
            if isinstance(v, dict) and v:
                stack += [(f"{at}.{k}" if at else k, x) for k, x in v.items()]
            else:
                yield at, canonical(v)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(*ids, field, value) for *ids, said in part.itertuples(index=False) if said is not None for field, value in leaves("", json.loads(said))]
            yield pd.DataFrame(rows, columns=[*id_cols, "field", "value"])

    kept = frame.select(*id_cols, text)
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("field", T.StringType()), T.StructField("value", T.StringType())])
    return kept.mapInPandas(run, schema)


def json_diff(before: DataFrame, after: DataFrame, text: str, id_cols: list[str]) -> DataFrame:
    """(ids, field, before, after) for fields that differ or are on one side."""
    a = flatten_json(before, text, id_cols).withColumnRenamed("value", "before")
    b = flatten_json(after, text, id_cols).withColumnRenamed("value", "after")
    return a.join(b, [*id_cols, "field"], "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))


#: How each policy field relaxes (fixed values): `false`/`true` when it becomes
#: that, `up`/`down` when a number moves so, `grow`/`shrink` when a list does,
#: `absent` when it goes, `neutral` never, or a ladder from tight to loose.
POLICY_FIELDS: dict[str, str | list[str]] = {
    "schema_version": "neutral",
    "severity.block_on_tamper": "false",
    "severity.block_on_test_failure": "false",
    "severity.max_severity_for_c_tier": ["critical", "high", "medium", "low", "info"],
    "severity.med_plus_requires_diff_actionable": "true",
    "severity.med_plus_tiers": "shrink",
    "loop.iteration_cap": "up",
    "loop.count_context_informational": "false",
    "agent.profile_token_budget": "neutral",
    "agent.bytes_per_token": "neutral",
    "perf.fast_lane_warm_p95_ms": "up",
    "perf.fast_lane_warm_fallback_p95_ms": "up",
    "perf.fast_lane_cold_cap_ms": "up",
    "perf.max_git_spawns_per_measure": "up",
    "history.window_days": "neutral",
    "registry.claim_budget": "up",
    "registry.max_claims_expiring_per_month": "up",
    "sandbox.enabled": "false",
    "sandbox.test_command": "absent",
    "sandbox.test_timeout_ms": "down",
    "sandbox.env_allow": "grow",
    "sandbox.memory_limit_mb": "up",
    "self_measure.binary": ["last-attested-release", "current-build"],
    "self_measure.excluded_paths": "grow",
    "self_measure.exclusion_drift_signal": "false",
}


def direction(field: Column, before: Column, after: Column) -> Column:
    """loosening, tightening, neutral or unclassified, of a policy field's move;
    before and after are JSON texts, null where the field was absent."""
    null = lambda c: c.isNull() | (c == "null")
    number = lambda c: c.try_cast("double")
    items = lambda c: F.from_json(c, "array<string>")
    gone = F.size(F.array_except(items(before), items(after))) > 0
    new = F.size(F.array_except(items(after), items(before))) > 0
    lists = F.startswith(before, F.lit("[")) & F.startswith(after, F.lit("["))

    def moved(loose: Column, tight: Column) -> Column:
        return F.when(F.coalesce(loose, F.lit(False)), "loosening").when(F.coalesce(tight, F.lit(False)), "tightening").otherwise("unclassified")

    to = lambda a, b: (before == a) & (after == b)
    ways = {
        "neutral": F.lit("neutral"),
        "false": moved(to("true", "false"), to("false", "true")),
        "true": moved(to("false", "true"), to("true", "false")),
        "up": moved(number(after) > number(before), number(after) < number(before)),
        "down": moved(number(after) < number(before), number(after) > number(before)),
        "absent": moved(~null(before) & null(after), null(before) & ~null(after)),
        "grow": F.when(lists, F.when(new, "loosening").when(gone, "tightening").otherwise("neutral")).otherwise("unclassified"),
        "shrink": F.when(lists, F.when(gone, "loosening").when(new, "tightening").otherwise("neutral")).otherwise("unclassified"),
    }
    out = F.lit("unclassified")
    for name, how in POLICY_FIELDS.items():
        if isinstance(how, list):
            place = lambda c, how=how: F.array_position(F.array(*[F.lit(f'"{x}"') for x in how]), c)
            a, b = place(before), place(after)
            way = moved((a > 0) & (b > a), (b > 0) & (a > b))
        else:
            way = ways[how]
        out = F.when(field == name, way).otherwise(out)
    return out
