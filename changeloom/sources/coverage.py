"""Coverage reports: lcov, Cobertura-style XML, format sniffing."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changeloom.functions.scalars import normalize_path, strip_bom
from changeloom.schema import COVERAGE

#: Where reports are looked for, in order.
CANDIDATES = ["lcov.info", "coverage/lcov.info", "coverage.xml", "cobertura.xml", "coverage/coverage.xml", "coverage/cobertura.xml", "coverage/cobertura-coverage.xml", "target/lcov.info", "build/lcov.info"]
LARGEST, DEEPEST = 32 << 20, 64


def lcov(reports: DataFrame) -> DataFrame:
    """reports(report, text) to (report, format, path, line, hits, degraded).
    Equal lines' hits add up; a DA record outside a file's part, or malformed,
    marks the report degraded. Pure column functions: a report's lines are
    numbered and take the last SF before them."""
    lines = reports.select("report", F.posexplode(F.split(strip_bom(F.col("text")), "\r?\n", -1)).alias("at", "said"))
    w = W.partitionBy("report").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    mark = F.when(F.startswith("said", F.lit("SF:")), F.substring("said", 4, 1 << 20)).when(F.col("said") == "end_of_record", "")
    lines = lines.withColumn("file", F.last(mark, ignorenulls=True).over(w))
    data = lines.filter(F.startswith("said", F.lit("DA:")))
    shape = r"^DA:(\d+),(\d+)(?:,.*)?$"
    inside = F.coalesce(F.col("file"), F.lit("")) != ""
    good = inside & F.col("said").rlike(shape)
    data = data.select("report", normalize_path(F.col("file")).alias("path"), good.alias("good"), F.regexp_extract("said", shape, 1).try_cast("int").alias("line"), F.regexp_extract("said", shape, 2).try_cast("long").alias("hits"))
    bad = data.groupBy("report").agg(F.max(~F.col("good")).alias("degraded"))
    hits = data.filter("good").groupBy("report", "path", "line").agg(F.sum("hits").alias("hits"))
    return hits.join(bad, "report").select("report", F.lit("lcov").alias("format"), "path", "line", "hits", "degraded")


def parse_cobertura(text: str) -> list[tuple[str, int, int]]:
    """(path, line, hits); each class counts under each source folder. Elements
    nested over a bound are refused."""
    sources: list[str] = []
    hits: dict[tuple[str, int], int] = defaultdict(int)
    classes: list[tuple[str, list[tuple[int, int]]]] = []
    parser, depth, name, lines = ET.XMLPullParser(["start", "end"]), 0, None, []
    parser.feed(text)
    for event, node in parser.read_events():
        tag = node.tag.rsplit("}", 1)[-1]
        if event == "start":
            depth += 1
            if depth > DEEPEST:
                raise ValueError("the report is nested too deeply")
            if tag == "class":
                name, lines = node.get("filename"), []
        else:
            depth -= 1
            if tag == "source" and node.text:
                sources.append(node.text.strip().rstrip("/"))
            elif tag == "line" and name and node.get("number", "").isdigit() and node.get("hits", "").isdigit():
                lines.append((int(node.get("number")), int(node.get("hits"))))
            elif tag == "class" and name:
                classes.append((name, list(dict.fromkeys(lines))))
                name = None
    for file, own in classes:
        for source in sources or [""]:
            path = f"{source}/{file}" if source and not source.startswith("/") and source != "." else file
            for line, n in own:
                hits[path.replace("\\", "/").removeprefix("./"), line] += n
    return [(p, line, n) for (p, line), n in sorted(hits.items())]


def cobertura(reports: DataFrame) -> DataFrame:
    """reports(report, text) to (report, format, path, line, hits, degraded), a
    report at a time."""
    names = [x.split()[0] for x in COVERAGE.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(name, "cobertura", p, line, n, False) for name, text in zip(part["report"], part["text"], strict=True) for p, line, n in parse_cobertura(text)]
            yield pd.DataFrame(rows, columns=names)

    return reports.select("report", "text").mapInPandas(run, COVERAGE)


def sniff(raw: bytes) -> str:
    """lcov, cobertura, unreadable or unrecognized."""
    if len(raw) > LARGEST:
        return "unreadable"
    try:
        text = raw.decode("utf-8").removeprefix("﻿").lstrip()
    except UnicodeDecodeError:
        return "unreadable"
    if text.startswith("<"):
        return "cobertura"
    return "lcov" if text.startswith(("SF:", "TN:")) else "unrecognized"


def read_reports(spark: SparkSession, folder: str, candidates: list[str] = CANDIDATES) -> tuple[DataFrame, dict[str, str]]:
    """Coverage of the reports found in a folder, and what each candidate was."""
    from pathlib import Path

    found, lcovs, xmls = {}, [], []
    for name in candidates:
        path = Path(folder, name)
        if not path.is_file():
            found[name] = "absent"
            continue
        raw = path.read_bytes()
        found[name] = kind = sniff(raw)
        if kind in ("lcov", "cobertura"):
            (lcovs if kind == "lcov" else xmls).append((name, raw.decode("utf-8").removeprefix("﻿")))
    out = spark.createDataFrame([], COVERAGE)
    if lcovs:
        out = out.union(lcov(spark.createDataFrame(lcovs, "report string, text string")))
    if xmls:
        out = out.union(cobertura(spark.createDataFrame(xmls, "report string, text string")))
    return out, found
