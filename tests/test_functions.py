import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changeloom.functions import scalars
from changeloom.functions.canonical import broken_seals, canonical, es6_double, seal


@pytest.mark.parametrize(
    "x, text",
    [(0.0, "0"), (-0.0, "0"), (1.0, "1"), (-1.0, "-1"), (100.0, "100"), (0.1, "0.1"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-6, "0.000001"), (1e-7, "1e-7"), (1.25e-7, "1.25e-7"), (123456.789, "123456.789"), (5e-324, "5e-324"), (1.7976931348623157e308, "1.7976931348623157e+308")],
)
def test_doubles_as_ecmascript_prints_them(x, text):
    assert es6_double(x) == text


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_doubles_round_trip(x):
    assert float(es6_double(x)) == x


values = st.recursive(st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.text(max_size=5), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "é", "\U0001f600", "\uffff"]), v, max_size=4), max_leaves=10)


@settings(max_examples=60)
@given(values)
def test_canonical_bytes_do_not_depend_on_key_order(value):
    def turned(v):
        if isinstance(v, dict):
            return {k: turned(x) for k, x in reversed(v.items())}
        return [turned(x) for x in v] if isinstance(v, list) else v

    assert canonical(turned(value)) == canonical(value)
    assert json.loads(canonical(value)) == value


def test_key_order_is_by_utf16():
    assert canonical({"\uffff": 1, "\U0001f600": 2}) == '{"\U0001f600":2,"\uffff":1}'
    with pytest.raises(ValueError):
        canonical({"x": math.inf})


def test_seals_break_with_content_not_with_severity(spark):
    rows = spark.createDataFrame([("m", "complete", "low"), ("n", None, "high")], "metric_id string, completeness string, severity string")
    sealed = seal(rows)
    assert broken_seals(sealed).count() == 0
    assert broken_seals(sealed.withColumn("severity", F.lit("info"))).count() == 0
    assert broken_seals(sealed.withColumn("completeness", F.lit("partial"))).count() == 2


def test_entropy():
    assert scalars.entropy_microbits([1, 1]) == 1_000_000
    assert scalars.entropy_microbits([5]) == scalars.entropy_microbits([]) == 0
    for counts in ([3, 1], [2, 2, 2], [10, 7, 1, 1]):
        n = sum(counts)
        assert abs(scalars.entropy_microbits(counts) / 1e6 - -sum(c / n * math.log2(c / n) for c in counts)) < 2e-6


def test_text_functions(spark):
    df = spark.createDataFrame([("a\\b/./c", "é" * 40, "2024-02-30", "2024-02-29"), ("./x/y", "ab", "2024-1-01", "20240101")], "path string, said string, bad string, day string")
    got = df.select(scalars.normalize_path(F.col("path")).alias("p"), scalars.truncate_bytes(F.col("said"), 5).alias("t"), scalars.strict_date(F.col("bad")).alias("b"), scalars.strict_date(F.col("day")).alias("d")).collect()
    assert [(r.p, r.t) for r in got] == [("a/b/./c", "éé"), ("x/y", "ab")]
    assert [r.b for r in got] == [None, None] and [str(r.d) for r in got] == ["2024-02-29", "None"]


def test_ratio(spark):
    df = spark.createDataFrame([(0.0000005,), (-0.0000005,), (None,)], "x double")
    assert [r.q for r in df.select(scalars.quantize_ratio(F.col("x")).alias("q")).collect()] == [1e-6, -1e-6, None]
    with pytest.raises(Exception, match="finite"):
        spark.createDataFrame([(math.inf,)], "x double").select(scalars.quantize_ratio(F.col("x"))).collect()


def test_retry_delays():
    assert [scalars.retry_delay_ms(k) for k in range(1, 7)] == [500, 1000, 2000, 4000, 8000, 8000]


def test_regime_labels(spark):
    df = spark.createDataFrame([("static", "1", "2", {"py": "3", "js": "4"})], "family string, engine_version string, spec_revision string, grammars map<string,string>")
    others = ["algorithm", "min_tokens", "window_tokens", "normalization_revision", "detector_set_revision", "rule_pack_version", "git_version", "history_window_days", "command", "sandbox"]
    r = df.select(F.struct("*", *[F.lit(None).cast("string").alias(c) for c in others], F.lit(None).cast("map<string,string>").alias("parser_versions")).alias("r"))
    assert r.select(scalars.regime_label(F.col("r")).alias("l")).first().l == "static v1 spec 2 grammars [js=4,py=3]"
