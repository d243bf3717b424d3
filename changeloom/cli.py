"""Command line: measure, report, explain, ledger."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from changeloom import api
from changeloom.sources import ledger as records

#: Exit codes by verdict.
CODES = {"pass": 0, "advise": 0, "block": 2, "escalate_to_human": 3}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="changeloom")
    verbs = out.add_subparsers(dest="verb", required=True)
    for name in ("measure", "report"):
        verb = verbs.add_parser(name)
        verb.add_argument("--repo", default=".")
        verb.add_argument("--base")
        verb.add_argument("--head", default="HEAD")
        verb.add_argument("--html", action="store_true")
    explain = verbs.add_parser("explain")
    explain.add_argument("--registry", required=True)
    explain.add_argument("metric")
    ledger = verbs.add_parser("ledger")
    ledger.add_argument("path")
    ledger.add_argument("--by", default="author")
    ledger.add_argument("--filter")
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    said = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("changeloom").getOrCreate()
    if said.verb in ("measure", "report"):
        results, record = api.measure_change(spark, said.repo, said.base, said.head)
        results = results.cache()
        print(records.html_report(results, said.head) if said.html else records.terminal_report(results))
        verdict = record.first().verdict
        print(verdict)
        return CODES[verdict] if said.verb == "measure" else 0
    if said.verb == "explain":
        metrics, claims = api.load_registry(spark, said.registry)
        api.explain_finding(metrics, claims, said.metric).show(truncate=False)
    else:
        api.get_ledger(spark, said.path, said.by, said.filter).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
