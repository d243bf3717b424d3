"""Policy and registry files (TOML), read on the driver with strict schemas."""

from __future__ import annotations

import tomllib
from dataclasses import fields
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from changeloom.functions.canonical import digest
from changeloom.operators.rules import Policy
from changeloom.schema import CLAIMS, METRICS

#: Policy sections and the fields of Policy that they set.
SECTIONS = {
    "severity": ["block_on_tamper", "block_on_test_failure", "max_severity_for_c_tier", "med_plus_requires_diff_actionable", "med_plus_tiers"],
    "loop": ["iteration_cap", "count_context_informational"],
    "history": ["window_days"],
    "registry": ["claim_budget", "max_claims_expiring_per_month"],
    "agent": ["profile_bytes"],
}


def policy_from(text: str) -> Policy:
    """A policy; unknown sections or fields and other schema versions are errors."""
    data = tomllib.loads(text)
    if data.pop("schema_version", 1) != 1:
        raise ValueError("schema_version must be 1")
    values = {}
    for section, content in data.items():
        for key, value in content.items() if isinstance(content, dict) else [(None, None)]:
            if key not in SECTIONS.get(section, []):
                raise ValueError(f"unknown policy field {section}.{key}")
            values[key] = value
    return Policy(**values)


def policy_hash(policy: Policy) -> str:
    return digest({f.name: getattr(policy, f.name) for f in fields(policy)})


def registry_rows(engine: str, text: str) -> tuple[list[tuple], list[tuple]]:
    data = tomllib.loads(text)
    metrics = [(engine, m["metric_id"], m["claim_id"], m.get("class"), m.get("deterministic", True)) for m in data.get("metric", [])]
    names = ["claim_id", "implementation", "implementation_version", "language", "outcome", "tier", "citation", "population", "effect", "does_not_predict", "owner", "expiry"]
    claims = []
    for c in data.get("claim", []):
        row = {k: c.get(k) for k in names}
        if isinstance(row["expiry"], str):
            row["expiry"] = date.fromisoformat(row["expiry"])
        claims.append((engine, *row.values()))
    return metrics, claims


def registry(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(metrics, claims) of the registry files in a folder, one for each engine."""
    metrics, claims = [], []
    for path in sorted(Path(folder).glob("*.toml")):
        m, c = registry_rows(path.stem, path.read_text())
        metrics, claims = metrics + m, claims + c
    return spark.createDataFrame(metrics, METRICS), spark.createDataFrame(claims, CLAIMS)


def fixture_cases(spark: SparkSession, folder: str) -> DataFrame:
    """(id, path, kind, base, head) of case folders with base/ and head/ trees;
    files on one side alone are additions or deletions. Read with binaryFile."""
    from pyspark.sql import functions as F

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    part = F.regexp_extract("path", r"([^/]+/[^/]+)/(base|head)/(.+)$", 0)
    rows = raw.filter(part != "").select(
        F.regexp_extract("path", r"([^/]+/[^/]+)/(base|head)/(.+)$", 1).alias("id"),
        F.regexp_extract("path", r"([^/]+/[^/]+)/(base|head)/(.+)$", 2).alias("side"),
        F.regexp_extract("path", r"([^/]+/[^/]+)/(base|head)/(.+)$", 3).alias("file"),
        "content",
    )
    base = rows.filter("side = 'base'").select("id", "file", F.col("content").alias("base"))
    head = rows.filter("side = 'head'").select("id", "file", F.col("content").alias("head"))
    kind = F.when(F.col("base").isNull(), "added").when(F.col("head").isNull(), "deleted").otherwise("modified")
    return base.join(head, ["id", "file"], "full_outer").select("id", F.col("file").alias("path"), F.lit(None).cast("string").alias("old_path"), kind.alias("kind"), "base", "head")


def freeze_digest(folder: str) -> str:
    """One digest over the sorted (path, length, bytes) of a folder's files: an
    ordered fold, so it runs on the driver over a corpus of fixtures."""
    import hashlib

    out = hashlib.sha256()
    for path in sorted(p for p in Path(folder).rglob("*") if p.is_file()):
        raw = path.read_bytes()
        out.update(f"{path.relative_to(folder).as_posix()}\0{len(raw)}\0".encode() + raw)
    return out.hexdigest()
