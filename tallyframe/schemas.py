"""Declared schemas of the two sources, the rule documents, the export and the state tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*cols: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in cols])


_S, _L, _F, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.DateType(), T.TimestampType()

QUERY_HISTORY = _struct(
    ("statement_id", _S, True),
    ("executed_by", _S, True),
    ("warehouse_id", _S, True),
    ("statement_type", _S, True),
    ("execution_status", _S, True),
    ("total_duration_ms", _L, True),
    ("read_bytes", _L, True),
    ("start_time", _TS, True),
    ("end_time", _TS, True),
    ("statement_text", _S, True),
)

BILLING_USAGE = _struct(
    ("d", _D, True),
    ("sku_name", _S, True),
    ("warehouse_id", _S, True),
    ("usage_quantity", T.DecimalType(18, 6), True),
    ("usage_start_time", _TS, True),
    ("usage_end_time", _TS, True),
    ("billing_origin_product", _S, True),
)

FINGERPRINT_HISTORY = _struct(
    ("ck", _S, False),
    ("statement_id", _S, False),
    ("d", _D, False),
    ("start_time", _TS, True),
    ("warehouse_id", _S, True),
    ("total_duration_ms", _L, True),
    ("route", _S, True),
    ("rule_id", _S, True),
    ("ingested_at", _TS, False),
)

WATERFALL_DAILY = _struct(
    ("d", _D, False),
    ("sku_name", _S, False),
    ("warehouse_id", _S, True),
    ("dbus", _F, True),
    ("usd", _F, True),
    ("layer", _S, True),
    ("updated_at", _TS, False),
)

COVERAGE_DAILY = _struct(
    ("d", _D, False),
    ("gateway_routed", _L, True),
    ("total", _L, True),
    ("coverage_ratio", _F, True),
    ("updated_at", _TS, False),
)

RULE_EFFECTIVENESS = _struct(
    ("ck", _S, False),
    ("rule_id", _S, True),
    ("window", _S, False),
    ("baseline_rate", _F, True),
    ("observed", _L, True),
    ("avoided", _L, True),
    ("realized_usd", _F, True),
    ("updated_at", _TS, False),
)

RULES = _struct(
    ("rule_id", _S, False),
    ("rule_type", _S, True),
    ("description", _S, True),
    ("config_json", _S, True),
    ("pulled_at", _TS, False),
)

SYNC_LOG = _struct(
    ("d", _D, False),
    ("ts", _TS, False),
    ("direction", _S, False),
    ("payload_bytes", _L, True),
    ("status", _S, False),
)

# Which files of the history were taken in, which days they touched, and when the reports were rebuilt from that.
INGESTED_FILES = _struct(
    ("path", _S, False),
    ("modified", _TS, False),
    ("length", _L, False),
    ("ingested_at", _TS, False),
)

CHANGED_DAYS = _struct(("d", _D, False), ("batch", _S, False), ("changed_at", _TS, False))

RECOMPUTE_LOG = _struct(("started_at", _TS, False), ("batch", _S, True))

# The batches that a stream began; whether it found rows in the table when it began itself.
STREAM_BATCHES = _struct(("position", _S, False), ("batch", _L, False), ("on_rows", T.BooleanType(), False), ("begun_at", _TS, False))

STATE = {
    "fingerprint_history": FINGERPRINT_HISTORY,
    "waterfall_daily": WATERFALL_DAILY,
    "coverage_daily": COVERAGE_DAILY,
    "rule_effectiveness": RULE_EFFECTIVENESS,
    "rules": RULES,
    "sync_log": SYNC_LOG,
    "ingested_files": INGESTED_FILES,
    "changed_days": CHANGED_DAYS,
    "recompute_log": RECOMPUTE_LOG,
    "stream_batches": STREAM_BATCHES,
}

# Executions per fingerprint, rule, warehouse and day: the roll-up that reports read.
EXECUTIONS_DAILY = _struct(
    ("ck", _S, False),
    ("rule_id", _S, True),
    ("warehouse_id", _S, True),
    ("n", _L, False),
    ("ms", _L, True),
    ("d", _D, False),
)

PARTITIONED_BY = {
    "fingerprint_history": "d",
    "waterfall_daily": "d",
    "coverage_daily": "d",
    "sync_log": "d",
}

# The coded domains of the state columns.
ROUTES = ["warehouse", "cache_miss", "smaller_wh", "bypass"]
LAYERS = ["raw", "projected_saving", "realized_saving"]
RULE_TYPES = ["cache", "bypass", "smaller_wh"]
DIRECTIONS = ["push_pull", "pull_only", "push_only"]

# A rule document is {"rules": [{...}]}. The rules stay JSON text, so unknown fields survive.
RULE_DOCUMENT = T.StructType([T.StructField("rules", T.ArrayType(_S))])
RULE_FIELDS = _struct(("rule_id", _S, True), ("rule_type", _S, True), ("description", _S, True))

# The only columns that may leave: aggregates and identifiers, no text, user or warehouse.
EXPORT_COLUMNS = ["rule_id", "ck", "window", "avoided", "realized_usd"]
EXPORT = T.StructType([f for f in RULE_EFFECTIVENESS if f.name in EXPORT_COLUMNS])
