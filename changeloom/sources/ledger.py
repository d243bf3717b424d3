"""The ledger as files: JSON lines of records, appended, merged and read back;
content-addressed and versioned tables; reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.functions.canonical import canonical_json, sha256_hex
from changeloom.functions.scalars import html_escape
from changeloom.schema import RECORD


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines; a malformed line is an error, not a skip."""
    return spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)


def results_of(records: DataFrame, *keep: str) -> DataFrame:
    """A row for each result, with the named columns of its record."""
    return records.select(*keep, F.explode("results").alias("r")).select(*keep, "r.*")


def append(records: DataFrame, path: str) -> None:
    records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value")).select(canonical_json("value").alias("value")).write.mode("append").text(path)


def overwrite(records: DataFrame, path: str) -> None:
    records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value")).select(canonical_json("value").alias("value")).write.mode("overwrite").text(path)


def merge(spark: SparkSession, a: str, b: str, out: str) -> None:
    """Union of distinct lines of two ledgers."""
    spark.read.text(a).union(spark.read.text(b)).distinct().write.mode("overwrite").text(out)


def trailer(results: DataFrame, by: str) -> DataFrame:
    """(by, digest): sha-256 over the sorted (metric, scope, digest,
    deterministic) rows of each record, which are a record's own few."""
    rows = F.array_sort(F.collect_list(F.struct("metric_id", "scope", "digest", "deterministic")))
    return results.groupBy(by).agg(F.to_json(rows, {"ignoreNullFields": "false"}).alias("__rows")).select(by, sha256_hex(canonical_json("__rows")).alias("digest"))


class Store:
    """Tables by content key under one folder, with a manifest of version and
    regime; another version or regime reads as absent, and is rebuilt."""

    def __init__(self, spark: SparkSession, folder: str, version: int = 1):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), version

    def _paths(self, key: str) -> tuple[str, str]:
        return f"{self.folder}/{key}/data", f"{self.folder}/{key}/manifest"

    def put(self, key: str, table: DataFrame, regime: str = "") -> None:
        data, manifest = self._paths(key)
        table.write.mode("overwrite").parquet(data)
        self.spark.createDataFrame([(self.version, regime)], "version int, regime string").coalesce(1).write.mode("overwrite").json(manifest)

    def get(self, key: str, regime: str = "") -> DataFrame | None:
        data, manifest = self._paths(key)
        try:
            row = self.spark.read.schema("version int, regime string").json(manifest).first()
            return self.spark.read.parquet(data) if row == (self.version, regime) else None
        except Exception:  # absent or unreadable: a miss, never an error
            return None

    def read_through(self, key: str, build, regime: str = "") -> DataFrame:
        held = self.get(key, regime)
        if held is None:
            self.put(key, build(), regime)
            held = self.get(key, regime)
        return held


def redact(texts: DataFrame, column: str, roots: list[str], sign: str = "<redacted>") -> DataFrame:
    """Known roots replaced, longest first, and how often."""
    said, times = F.col(column), F.lit(0)
    for root in sorted(roots, key=len, reverse=True):
        times = times + ((F.length(said) - F.length(F.replace(said, F.lit(root), F.lit("")))) / len(root)).cast("int")
        said = F.replace(said, F.lit(root), F.lit(sign))
    return texts.withColumns({column: said, "redactions": times})


def html_report(results: DataFrame, title: str, most: int = 1000) -> str:
    """A self-contained page of a record's results, worst first; all text of the
    repository is escaped. The row limit is the page's."""
    from changeloom.operators.ordering import worst_first

    cells = [html_escape(F.col(c).cast("string")).alias(c) for c in ("severity", "metric_id", "scope_label", "value_label")]
    rows = results.orderBy(*worst_first(results)).select(*cells).limit(most).collect()
    from html import escape

    body = "".join("<tr>" + "".join(f"<td>{x or ''}</td>" for x in r) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><table><tr><th>severity<th>metric<th>scope<th>value</tr>{body}</table>"


def terminal_report(results: DataFrame, most: int = 200) -> str:
    """Findings worst first, then absences."""
    from changeloom.operators.ordering import absences, findings

    out = [f"{r.severity:<9}{r.metric_id}  {r.scope_label}  {r.value_label or ''}".rstrip() for r in findings(results).limit(most).collect()]
    gone = [f"absent   {r.metric_id}  {r.scope_label}" for r in absences(results).limit(most).collect()]
    return "\n".join([*out, *gone])
