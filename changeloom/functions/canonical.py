"""Canonical JSON, digests and seals.

Bytes follow the public canonicalisation scheme of RFC 8785: keys sorted by
UTF-16 code units, no blanks, nulls kept, integers exact, doubles as ECMAScript
prints them."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def es6_double(x: float) -> str:
    """The ECMAScript text of a double; NaN and infinities are errors."""
    if not math.isfinite(x):
        raise ValueError(f"no canonical text for {x}")
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(abs(x))).as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    point = len(text) + exponent
    text = text.rstrip("0")
    size = len(text)
    if size <= point <= 21:
        body = text + "0" * (point - size)
    elif 0 < point <= 21:
        body = f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        body = "0." + "0" * -point + text
    else:
        body = text[0] + (f".{text[1:]}" if size > 1 else "") + f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return f"-{body}" if x < 0 else body


def _string(s: str) -> str:
    return json.dumps(s, ensure_ascii=False)


def canonical(value) -> str:
    """Canonical JSON of Python data (dict, list, str, bool, int, float, None)."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return es6_double(value)
    if isinstance(value, str):
        return _string(value)
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{_string(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, Iterable):
        return "[" + ",".join(map(canonical, value)) + "]"
    raise TypeError(f"no canonical form of {type(value).__name__}")


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON texts in canonical form; null stays null."""
    return texts.map(lambda t: None if t is None else canonical(json.loads(t)))


@F.pandas_udf(T.StringType())
def es6_text(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if pd.isna(x) else es6_double(float(x)))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


#: What a seal covers, in this order; severity, evidence, class, determinism and
#: freshness are left out (fixed values).
SEALED = ["schema_version", "base_oid", "head_oid", "head_kind", "engine_id", "metric_id", "claim_id", "family", "scope", "value", "delta", "completeness", "measurement_regime"]


def seal(results: DataFrame, out: str = "digest") -> DataFrame:
    """results with the digest of the sealed columns that it has. Null fields are
    kept as null."""
    fields = [c for c in SEALED if c in results.columns]
    plain = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return results.withColumn(out, sha256_hex(canonical_json(plain)))


def broken_seals(results: DataFrame, digest_col: str = "digest") -> DataFrame:
    """The results whose digest is not that of their content; none if all hold."""
    return seal(results, "__again").filter(~F.col("__again").eqNullSafe(F.col(digest_col))).drop("__again")
