"""Scalar functions as column expressions."""

from __future__ import annotations



import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.schema import COMPLETENESS, SEVERITIES


def rank_of(value: Column, ordered: list[str]) -> Column:
    """Place of a value in a closed ordered set, from 0; null if it isn't there."""
    out = F.lit(None).cast("int")
    for k, name in enumerate(ordered):
        out = F.when(value == name, k).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    return rank_of(severity, SEVERITIES)


def severity_name(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, SEVERITIES)), rank)


def completeness_rank(completeness: Column) -> Column:
    return rank_of(completeness, COMPLETENESS)


def author_key(name: Column, email: Column) -> Column:
    """First 16 hex digits of sha-256 over name, a zero byte, email."""
    return F.substring(F.sha2(F.concat(name.cast("binary"), F.unhex(F.lit("00")), email.cast("binary")), 256), 1, 16)


def quantize_ratio(value: Column) -> Column:
    """Six decimals, half away from zero; NaN and infinities are errors."""
    ok = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(ok | value.isNull(), F.round(value * 1e6, 0) / 1e6).otherwise(F.raise_error(F.lit("a ratio must be finite")).cast("double"))


def _log2_q32(n: int) -> int:
    """Truncated base-2 logarithm with 32 fractional bits, bit by bit."""
    whole = n.bit_length() - 1
    x, out = (n << 64) >> whole, whole << 32
    for bit in range(31, -1, -1):
        x = x * x >> 64
        if x >> 65:
            x >>= 1
            out |= 1 << bit
    return out


def entropy_microbits(counts: list[int]) -> int:
    """Shannon entropy of counts in millionths of a bit, in integers alone, so
    that every platform agrees."""
    counts = [c for c in counts if c > 0]
    total = sum(counts)
    if len(counts) < 2:
        return 0
    spread = total * _log2_q32(total) - sum(c * _log2_q32(c) for c in counts)
    scaled = max(0, spread) * 1_000_000
    below = total << 32
    return (scaled + below // 2) // below


@F.pandas_udf(T.LongType())
def entropy_microbits_udf(counts: pd.Series) -> pd.Series:
    return counts.map(lambda c: None if c is None else entropy_microbits([int(x) for x in c]))


def strict_date(text: Column) -> Column:
    """A date of exactly YYYY-MM-DD that the calendar has, else null."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def strict_stamp(text: Column) -> Column:
    """Unix seconds of exactly YYYY-MM-DDTHH:MM:SSZ, else null."""
    shape = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$")
    plain = F.regexp_replace(F.regexp_replace(text, "T", " "), "Z$", "+00:00")
    return F.when(shape, F.unix_timestamp(F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ssXXX"))))


def year_month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def days_of(date: Column) -> Column:
    return F.unix_date(date)


def date_of(days: Column) -> Column:
    return F.date_from_unix_date(days)


def is_stale(expiry: Column, as_of: Column) -> Column:
    return as_of > expiry


def retry_delay_ms(failures: int, base: int = 500, cap: int = 8000) -> int:
    return min(cap, base << (failures - 1)) if failures > 0 else 0


def normalize_path(path: Column) -> Column:
    """Backslashes to slashes, leading ./ away."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(?:\./)+", "")


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿", "")


def truncate_bytes(text: Column, most: int) -> Column:
    """The longest prefix of whole characters within `most` UTF-8 bytes."""
    cut = F.substring(text.cast("binary"), 1, most)
    whole = F.octet_length(text) <= most
    # drop the bytes of a character that was cut: 0-3 continuation bytes and their lead byte
    tries = [F.try_validate_utf8(F.substring(cut, 1, most - k).cast("string")) for k in range(4)]
    return F.when(whole, text).otherwise(F.coalesce(*tries))


def html_escape(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def value_label(value: Column) -> Column:
    """Text of a tagged value: +n for positive integers, four decimals for
    ratios, fired or not for flags."""
    number = value["value_long"].cast("string")
    return (
        F.when(value["kind"] == "integer", F.when(value["value_long"] > 0, F.concat(F.lit("+"), number)).otherwise(number))
        .when(value["kind"] == "count", number)
        .when(value["kind"] == "ratio", F.format_string("%.4f", value["value_double"]))
        .when(value["kind"] == "duration", F.concat(number, F.lit("ms")))
        .when(value["kind"] == "flag", F.when(value["value_bool"], "fired").otherwise("not fired"))
        .otherwise(value["value_text"])
    )


def scope_label(scope: Column) -> Column:
    lines = F.concat(F.lit(":"), scope["line_span"]["start"].cast("string"))
    symbol = F.concat(F.lit("::"), scope["symbol"])
    return F.when(scope["path"].isNull(), scope["kind"]).otherwise(F.concat(scope["path"], F.coalesce(symbol, F.lit("")), F.coalesce(lines, F.lit(""))))


def numeric_value(value: Column) -> Column:
    """The number of a tagged value, null for flags and absences."""
    return F.when(value["kind"].isin("count", "integer", "duration"), value["value_long"].cast("double")).when(value["kind"] == "ratio", value["value_double"])


def same_kind(a: Column, b: Column) -> Column:
    """a's number where both values are of one kind, else null."""
    return F.when(a["kind"] == b["kind"], numeric_value(a))


def regime_label(r: Column) -> Column:
    """The readable label by which results are grouped into regimes."""
    pairs = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    v = F.concat(F.lit(" v"), r["engine_version"])
    text = lambda *parts: F.concat(r["family"], v, *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (
        F.when(r["family"] == "static", text(" spec ", r["spec_revision"], " grammars [", pairs(r["grammars"]), "]"))
        .when(
            r["family"] == "clones",
            text(" ", r["algorithm"], " min-tokens ", r["min_tokens"].cast("string"), " window ", r["window_tokens"].cast("string"), " normalization ", r["normalization_revision"]),
        )
        .when(r["family"] == "tamper", text(" detectors ", r["detector_set_revision"], " rules ", r["rule_pack_version"]))
        .when(r["family"] == "process", text(" git ", r["git_version"], " window ", r["history_window_days"].cast("string"), "d"))
        .when(r["family"] == "artifacts", text(" parsers [", pairs(r["parser_versions"]), "]"))
        .when(r["family"] == "tests", text(' command "', r["command"], '" sandbox ', r["sandbox"]))
    )


# Paths -----------------------------------------------------------------------

#: Folders and name parts that mark tests and data.
TEST_FOLDERS = ["test", "tests", "__tests__", "spec", "specs", "e2e", "testing"]
TEST_NAMES = [".test.", ".spec.", "_test.", "-test.", ".steps."]
DATA_SUFFIXES = [".json", ".csv", ".yaml"]
DATA_NAMES = [".generated.", ".gen.", ".data."]
DATA_FOLDERS = ["data", "fixtures", "fixture", "locales", "locale", "i18n", "seeds", "seed", "generated", "__generated__", "snapshots", "__snapshots__", "migrations"]
#: Extension to language.
LANGUAGES = {"ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "py": "python", "rs": "rust"}


def _any(column: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(column, F.lit(p))
    return out


def is_test_path(path: Column) -> Column:
    lower = F.lower(path)
    parts = F.split(lower, "/")
    name = F.element_at(parts, -1)
    return F.arrays_overlap(parts, F.array(*map(F.lit, TEST_FOLDERS))) | F.startswith(name, F.lit("test_")) | _any(name, TEST_NAMES)


def is_data_path(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    ends = F.lit(False)
    for s in DATA_SUFFIXES:
        ends = ends | F.endswith(name, F.lit(s))
    return ends | _any(name, DATA_NAMES) | F.arrays_overlap(folders, F.array(*map(F.lit, DATA_FOLDERS)))


def language_of(path: Column, clones: bool = False) -> Column:
    """By the last extension; clone detection has no Rust and wants a stem."""
    extension = F.regexp_extract(path, r"([^/]*)\.([^./]+)$", 2)
    stem = F.regexp_extract(path, r"([^/]*)\.([^./]+)$", 1)
    out = F.lit(None).cast("string")
    for ext, language in LANGUAGES.items():
        if not (clones and language == "rust"):
            out = F.when(extension == ext, language).otherwise(out)
    return F.when(stem != "", out) if clones else out


def under(path: Column, pattern: str) -> Column:
    """`dir/**` holds dir itself and all below; anything else is literal."""
    if pattern.endswith("/**"):
        top = pattern[:-3]
        return (path == top) | F.startswith(path, F.lit(top + "/"))
    return path == pattern


def log2_entropy(total: Column, weighted: Column) -> Column:
    """log2(N) - sum(c log2 c) / N."""
    return F.log2(total) - weighted / total


