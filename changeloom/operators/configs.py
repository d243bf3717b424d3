"""Settings in configuration files: rosters, key/value lines, bounds, exclusions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCRIPTS = ["js", "cjs", "mjs", "ts", "mts", "cts"]
#: File stems of tools. None: any syntax (dotfiles); `family`
#: takes stem.variant.syntax too, where the syntax is no script.
THRESHOLD_TOOLS: list[tuple[str, list[str] | None, bool]] = [
    (".changeloom", None, False),
    ("tsconfig", ["json", "jsonc"], True),
    (".eslintrc", None, False),
    ("eslint.config", SCRIPTS, True),
    ("biome", ["json", "jsonc"], False),
    (".flake8", None, False),
    ("pyproject", ["toml"], False),
    ("mypy", ["ini"], False),
    (".mypy", None, False),
    ("ruff", ["toml"], False),
    (".ruff", None, False),
    ("clippy", ["toml"], False),
    (".golangci", None, False),
    ("sonar-project", ["properties"], True),
    ("jest.config", [*SCRIPTS, "json"], True),
    ("vitest.config", SCRIPTS, True),
    (".coveragerc", None, False),
    (".nycrc", None, False),
    (".c8rc", None, False),
    ("codecov", ["yml", "yaml"], False),
    (".codecov", None, False),
    ("tarpaulin", ["toml"], False),
    ("setup", ["cfg"], False),
    ("package", ["json"], False),
    ("tox", ["ini"], False),
]
COVERAGE_TOOLS = [t for t in THRESHOLD_TOOLS if t[0] in ("pyproject", "sonar-project", "jest.config", "vitest.config", ".coveragerc", ".nycrc", ".c8rc", "codecov", ".codecov", "tarpaulin", "setup", "package", "tox")] + [("nyc.config", SCRIPTS, True)]
#: Words of severity from off to strictest; parts of keys.
SEVERITY_WORDS = ["off", "none", "ignore", "info", "hint", "warn", "warning", "error", "deny", "forbid"]
FLOOR_KEYS = ["threshold", "minimum", "min_", "min-", "branches", "functions", "lines", "statements", "coverage", "fail_under", "fail-under", "max_severity", "budget"]
CEILING_KEYS = ["complexity", "max_line_length", "max-line-length", "max_warnings", "max-warnings", "max_errors", "max-errors", "iteration_cap"]
ZERO_IS_UNLIMITED = ["max-issues-per-linter", "max-same-issues"]
FLOOR_DESPITE_MAX = ["max_severity", "max-severity"]
STRICT_WHEN_TRUE = [
    "strict",
    "strictnullchecks",
    "noimplicitany",
    "noimplicitreturns",
    "nounusedlocals",
    "nounusedparameters",
    "strictfunctiontypes",
    "strictbindcallapply",
    "alwaysstrict",
    "usedefineforclassfields",
    "block_on_tamper",
    "block_on_test_failure",
    "disallow_untyped_defs",
    "check_untyped_defs",
    "warn_unused_ignores",
    "exclusion_drift_signal",
]
STRICT_WHEN_FALSE = ["skiplibcheck", "skipdefaultlibcheck", "suppressimplicitanyindexerrors", "suppressexcesspropertyerrors"]


def names_one_of(path: Column, tools: list[tuple[str, list[str] | None, bool]]) -> Column:
    """Whether the file's name is one of the tools' files."""
    name = F.element_at(F.split(F.lower(path), "/"), -1)
    dotted = name.rlike(r"^.+\..*$")
    stem = F.when(dotted, F.regexp_extract(name, r"^(.+)\.([^.]*)$", 1)).otherwise(name)
    syntax = F.when(dotted, F.regexp_extract(name, r"^(.+)\.([^.]*)$", 2)).otherwise("")
    out = F.lit(False)
    for tool, syntaxes, family in tools:
        if syntaxes is None:
            hit = stem == tool
        else:
            hit = stem == tool
            if family:
                hit = hit | (~syntax.isin(*SCRIPTS) & F.startswith(stem, F.lit(tool + ".")))
            hit = hit & syntax.isin(*syntaxes)
        out = out | hit
    return out


def is_threshold_config(path: Column) -> Column:
    return names_one_of(path, THRESHOLD_TOOLS)


def is_coverage_config(path: Column) -> Column:
    return names_one_of(path, COVERAGE_TOOLS)


def dialect(path: Column) -> Column:
    pick = lambda *stems: names_one_of(path, [t for t in THRESHOLD_TOOLS if t[0] in stems])
    return F.when(pick(".eslintrc", "eslint.config"), "eslint").when(pick("codecov", ".codecov"), "codecov").when(pick(".golangci"), "golangci").when(pick("clippy"), "clippy").otherwise("shared")


_SECTION = re.compile(r"^\s*\[+([^\[\]]+)\]+\s*$")
_PAIR = re.compile(r"""["']?([A-Za-z0-9_./*-]+)["']?\s*[:=]\s*(.+?)\s*,?\s*$""")
_COMMENT = re.compile(r"^\s*(?:#|//|;|--)")
OPEN_LINES = 64
#: A key and what sets it; `=>`, `==`, `!=`, `<=`, `>=` and `::` set nothing.
_KEYED = re.compile(r"""(?<![A-Za-z0-9_./*-])([A-Za-z0-9_./*-]+)["']?\s*(?<![=!<>:])[:=](?![=>])\s*""")
_CLOSES = {"[": "]", "{": "}"}


def _open(text: str) -> int:
    return sum(map(text.count, "[({")) - sum(map(text.count, "])}"))


def _value(text: str) -> str:
    """The value at the start of text: a bracket up to its match, else what
    comes before the next comma or closing bracket."""
    if text[:1] in _CLOSES:
        depth = 0
        for at, c in enumerate(text):
            depth += (c == text[0]) - (c == _CLOSES[text[0]])
            if not depth:
                return text[: at + 1]
        return text
    return re.split(r"[,}\]]", text, maxsplit=1)[0].strip().rstrip(";").strip().strip("\"'")


def pairs(line: str) -> list[tuple[str, str]]:
    """Every (key, value) set in a line, inside nested objects too. Keys are in
    lower case; a number is no key."""
    return [(m.group(1).lower(), _value(line[m.end() :])) for m in _KEYED.finditer(line) if not m.group(1).isdigit()]


def scan(text: str) -> Iterator[tuple[int, str, str]]:
    """(line, section-qualified key, value) of all pairs of all lines. A value
    whose bracket stays open is completed from a bounded number of lines; an
    object is no value, its keys are read where they stand."""
    section, lines = "", text.splitlines()
    for k, line in enumerate(lines):
        if _COMMENT.match(line):
            continue
        if found := _SECTION.match(line):
            section = found.group(1).strip().lower().removeprefix("tool.") + "."
            continue
        own, joined = pairs(line), line.strip()
        if own and _open(joined) > 0:
            for more in lines[k + 1 : k + 1 + OPEN_LINES]:
                if not _COMMENT.match(more):
                    joined += " " + more.strip()
                if _open(joined) <= 0:
                    own = [(key, later[1] if later[0] == key else value) for (key, value), later in zip(own, pairs(joined), strict=False)]
                    break
        for key, value in own:
            if value and not value.startswith("{"):
                yield k + 1, section + key, value


def _sides(files: DataFrame, emit, schema: str) -> DataFrame:
    """Rows from the readable texts of both sides of each file."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for part in parts:
            rows = []
            for path, *sides in part[["path", "base", "head"]].itertuples(index=False):
                for side, raw in zip(("base", "head"), sides, strict=True):
                    if raw is not None:
                        rows += [(path, side, *x) for x in emit(path, bytes(raw))]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "base", "head").mapInPandas(run, schema)


def settings(files: DataFrame) -> DataFrame:
    """(path, side, key, value, line, dialect): the last value of each key."""

    def emit(path: str, raw: bytes):
        last = {key: (value, line) for line, key, value in scan(raw.decode("utf-8", "replace").removeprefix("﻿"))}
        return [(key, value, line) for key, (value, line) in last.items()]

    return _sides(files, emit, "path string, side string, key string, value string, line int").withColumn("dialect", dialect(F.col("path")))


_EXCLUDE = re.compile("exclude|omit|ignore|skip", re.IGNORECASE)


def exclusions(files: DataFrame) -> DataFrame:
    """(path, side, line, entry): entries under keys that exclude, and negated
    ones under keys that include; in brackets or on indented lines."""

    def items(value: str) -> list[str]:
        return [x.strip().strip("\"'") for x in re.split(r"[,\s\[\]]+", value) if x.strip().strip("\"'")]

    def emit(path: str, raw: bytes):
        lines = raw.decode("utf-8", "replace").splitlines()
        out, block = [], None
        for at, line in enumerate(lines, 1):
            if _COMMENT.match(line) or not line.strip():
                continue
            found = _PAIR.search(line.strip()) if not line.strip().startswith("-") else None
            bare = re.match(r"""\s*["']?([A-Za-z0-9_.-]+)["']?\s*[:=]\s*\[?\s*$""", line)
            if found or bare:
                key = (found or bare).group(1)
                block = bool(_EXCLUDE.search(key)) if (_EXCLUDE.search(key) or "include" in key.lower()) else None
                values = items(found.group(2)) if found and not bare else []
            elif block is not None and (line[:1].isspace() or line.strip().startswith(("-", '"', "'"))):
                values = items(line.strip().removeprefix("- "))
            else:
                block, values = None, []
            if block is not None:
                out += [(at, v if block else v[1:]) for v in values if block or v.startswith("!")]
        return out

    return _sides(files, emit, "path string, side string, line int, entry string")


def broader(added: Column, removed: Column) -> Column:
    """Whether a pattern covers another: its literal folder is strictly
    shallower, and it ends in a wildcard."""
    anchor = lambda p: F.regexp_replace(F.regexp_extract(p, r"^[^*?\[{]*", 0), "[^/]*$", "")
    literal = F.when(removed.rlike(r"[*?\[{]"), anchor(removed)).otherwise(F.regexp_replace(removed, "[^/]*$", ""))
    wild = F.contains(added, F.lit("**")) | F.endswith(added, F.lit("*"))
    return wild & (F.length(anchor(added)) < F.length(literal)) & F.startswith(literal, anchor(added))


def number(value: Column) -> Column:
    plain = F.regexp_replace(F.trim(F.regexp_replace(value, "[\"']", "")), "%$", "")
    return F.when(~plain.rlike("^_|_$"), F.replace(plain, F.lit("_"), F.lit("")).try_cast("double"))


def word_rank(dialect_: Column, value: Column) -> Column:
    """Rank of a severity word; the digits 0, 1, 2 have ranks in one dialect."""
    plain = F.lower(F.trim(F.regexp_replace(value, "[\"']", "")))
    words = F.array(*map(F.lit, SEVERITY_WORDS))
    digit = F.when(dialect_ == "eslint", F.when(plain == "0", "off").when(plain == "1", "warn").when(plain == "2", "error"))
    place = F.array_position(words, F.coalesce(digit, plain))
    return F.when(place > 0, place)


def truth(value: Column) -> Column:
    plain = F.lower(F.trim(F.regexp_replace(value, "[\"']", "")))
    return F.when(plain.isin("true", "yes", "on", "1"), True).when(plain.isin("false", "no", "off", "0"), False)


def bound(dialect_: Column, key: Column, before: Column, after: Column) -> Column:
    """loosened, tightened, unranked (a ranked key whose move can't be told) or
    other, of one setting's move; after is null for a deleted key."""
    lower = F.lower(key)
    leaf = F.element_at(F.split(lower, r"\."), -1)
    has = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(lower, p))
    a, b = number(before), number(after)
    ceiling = has(CEILING_KEYS) & ~has(FLOOR_DESPITE_MAX)
    floor = has(FLOOR_KEYS)
    unlimited = (dialect_ == "golangci") & leaf.isin(*ZERO_IS_UNLIMITED)
    up, down = b > a, b < a
    flag_a, flag_b = truth(before), truth(after)
    said = lambda loose, tight: F.when(loose, "loosened").when(tight, "tightened")
    return F.coalesce(
        F.when(leaf.isin(*STRICT_WHEN_TRUE), said(flag_a & ~flag_b, ~flag_a & flag_b)),
        F.when(leaf.isin(*STRICT_WHEN_FALSE), said(~flag_a & flag_b, flag_a & ~flag_b)),
        F.when(unlimited, said((b == 0) & (a > 0) | (up & (a > 0)), (a == 0) & (b > 0) | down)),
        F.when(ceiling, said(up, down)),
        F.when(floor, said(down, up)),
        said(word_rank(dialect_, after) < word_rank(dialect_, before), word_rank(dialect_, after) > word_rank(dialect_, before)),
        F.when(ceiling | floor | unlimited | leaf.isin(*STRICT_WHEN_TRUE, *STRICT_WHEN_FALSE), "unranked"),
        F.lit("other"),
    )
