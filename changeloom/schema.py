"""The data model: fixed nested schemas of records, results and their inputs.
Absent is never zero: nullable fields are null where a thing was not measured. Schemas are DDL texts, which need no
session to be imported."""

SCOPE = "STRUCT<kind: STRING, path: STRING, blob_oid: STRING, symbol: STRING, line_span: STRUCT<start: INT, `end`: INT>>"
#: A tagged value: kind is one of count, integer, ratio, duration, flag, text;
#: one of the other fields is set. A text marks an absence, never a number.
VALUE = "STRUCT<kind: STRING, value_long: BIGINT, value_double: DOUBLE, value_bool: BOOLEAN, value_text: STRING>"
#: The fields of all families; those of others are null.
REGIME = (
    "STRUCT<family: STRING, engine_version: STRING, spec_revision: STRING, grammars: MAP<STRING, STRING>, algorithm: STRING, min_tokens: INT, window_tokens: INT, "
    "normalization_revision: STRING, detector_set_revision: STRING, rule_pack_version: STRING, git_version: STRING, history_window_days: INT, "
    "parser_versions: MAP<STRING, STRING>, command: STRING, sandbox: STRING>"
)
RESULT = (
    "STRUCT<metric_id: STRING, claim_id: STRING, engine_id: STRING, family: STRING, engine_class: STRING, metric_class: STRING, "
    f"scope: {SCOPE}, value: {VALUE}, delta: {VALUE}, severity: STRING, completeness: STRING, measurement_regime: {REGIME}, "
    "evidence: STRUCT<claim_id: STRING, tier: STRING, citation: STRING, does_not_predict: ARRAY<STRING>, stale: BOOLEAN>, "
    "deterministic: BOOLEAN, digest: STRING, freshness: STRUCT<measured_at: STRING, duration_ms: BIGINT, lane: STRING, cache: STRING>>"
)
RECORD = (
    "schema_version INT, record_kind STRING, policy_hash STRING, completeness STRING, "
    "tool STRUCT<name: STRING, version: STRING, build_oid: STRING, attested_release: BOOLEAN>, "
    "compare_context STRUCT<base_oid: STRING, head_oid: STRING, head_kind: STRING, git_version: STRING, base_resolution: STRING>, "
    "invocation STRUCT<source: STRING, harness: STRING, model: STRING, author: STRING, iteration: INT>, "
    f"results ARRAY<{RESULT}>, "
    "verdict STRUCT<verdict: STRING, reasons: ARRAY<STRUCT<code: STRING, severity: STRING, message: STRING, metric_ids: ARRAY<STRING>>>, iteration: STRUCT<count: INT, cap: INT, escalated: BOOLEAN>>, "
    "attestation STRUCT<value: STRING, tamper_signals: ARRAY<STRING>, verifier: STRING, "
    "compare: STRUCT<tuple_equal: BOOLEAN, regime_equal: BOOLEAN, matched: ARRAY<STRING>, mismatched: ARRAY<STRING>, unpaired: ARRAY<STRING>, flag_disagreements: ARRAY<STRING>>>, "
    "unreadable_paths ARRAY<STRING>"
)

TOUCHES = "oid STRING, committed_at BIGINT, author_key STRING, path STRING, added BIGINT, deleted BIGINT"
CHANGES = "path STRING, old_path STRING, status STRING, similarity INT, old_mode STRING, new_mode STRING, old_oid STRING, new_oid STRING"
FILE_CHANGES = "path STRING, old_path STRING, kind STRING, base BINARY, head BINARY"
COVERAGE = "report STRING, format STRING, path STRING, line INT, hits BIGINT, degraded BOOLEAN"
CHANGED_LINES = "path STRING, line INT"
METRICS = "engine STRING, metric_id STRING, claim_id STRING, class STRING, deterministic BOOLEAN"
CLAIMS = (
    "engine STRING, claim_id STRING, implementation STRING, implementation_version STRING, language STRING, outcome STRING, tier STRING, citation STRING, "
    "population STRING, effect STRING, does_not_predict ARRAY<STRING>, owner STRING, expiry DATE"
)

#: Closed sets in rank order (fixed values).
SEVERITIES = ["info", "low", "medium", "high", "critical"]
COMPLETENESS = ["unwitnessed", "partial", "parse-degraded", "complete"]
TAMPER_SIGNALS = [
    "suppression-density",
    "test-removal",
    "threshold-config-edit",
    "coverage-exclusion-drift",
    "assertion-free-test",
    "lookup-table-blowup",
    "parse-error-delta",
    "base-fabrication",
]
