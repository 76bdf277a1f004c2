"""Named queries over the test tables, each on its whole input.

Money is rounded to four decimals and ratios to six here, because sums of doubles depend on their
order in the last digits; the operators themselves do not round.
"""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import (
    fingerprint,
    fingerprint_versioned,
    has_tag,
    is_gateway_routed,
    normalize_sql,
    parse_tag,
    to_number,
)
from tallyframe.operators import cost, coverage, ingest, predicates, reports, rules, savings
from tallyframe.operators.ingest import to_prints
from tallyframe.params import Params
from tallyframe.plans.jobs import recompute, run_ingest, run_ingest_files, run_recompute, run_sync
from tallyframe.schemas import EXPORT
from tallyframe.sources import driver_tables as src
from tallyframe.sources import state, views
from tallyframe.sources.rollup import read_rollup, refresh_rollup
from tallyframe.sources.shared import new_folder
from tallyframe.streaming import start_coverage, start_ingest

Query = Callable[[SparkSession, str], DataFrame]

P = src.PARAMS
# Start of the last third of the log: what an earlier ingest has not seen.
CUT = "2024-03-01 00:00:00"

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the function's name, less a final underscore; the log is read as UTC."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    QUERIES[fn.__name__.rstrip("_")] = run
    return fn


def money(*names: str) -> list[Column]:
    return [F.round(n, 4).alias(n) for n in names]


def ratio(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def _prints(spark: SparkSession, sf: str) -> DataFrame:
    return to_prints(src.history(spark, sf))


def _effect(spark: SparkSession, sf: str, params: Params = P) -> DataFrame:
    return savings.rule_effectiveness(_prints(spark, sf), src.billing(spark, sf), params)


def _effect_columns() -> list:
    return ["ck", "rule_id", "window", F.col("baseline_rate").cast("double").alias("baseline_rate")]


# Sources and views


@query
def history_view(spark: SparkSession, sf: str) -> DataFrame:
    return views.query_history(src.history(spark, sf), P)


@query
def history_self_view(spark: SparkSession, sf: str) -> DataFrame:
    return views.query_history_self(views.query_history(src.history(spark, sf), P), "u7")


@query
def billing_window(spark: SparkSession, sf: str) -> DataFrame:
    usage = F.col("usage_quantity").cast("double").alias("usage_quantity")
    rest = [c for c in src.BILLING_USAGE.names if c != "usage_quantity"]
    return views.billing_usage(src.billing(spark, sf), P).select(*rest, usage)


@query
def view_sql(spark: SparkSession, sf: str) -> DataFrame:
    """SQL text over the registered views."""
    views.register_views(
        views.query_history(src.history(spark, sf), P), views.billing_usage(src.billing(spark, sf), P), "u7"
    )
    return spark.sql(
        """
        SELECT h.warehouse_id, h.statements, s.own_statements, b.usage_records
        FROM (SELECT warehouse_id, count(*) AS statements FROM query_history_v GROUP BY ALL) h
        LEFT JOIN (SELECT warehouse_id, count(*) AS own_statements FROM query_history_self_v GROUP BY ALL) s
          USING (warehouse_id)
        LEFT JOIN (SELECT warehouse_id, count(*) AS usage_records FROM billing_usage_v GROUP BY ALL) b
          USING (warehouse_id)
        """
    )


# Text functions


@query
def normalized_sql(spark: SparkSession, sf: str) -> DataFrame:
    return src.history(spark, sf).select("statement_id", normalize_sql(F.col("statement_text")).alias("normalized"))


@query
def fingerprint_(spark: SparkSession, sf: str) -> DataFrame:
    return src.history(spark, sf).select("statement_id", fingerprint(F.col("statement_text")).alias("ck"))


@query
def fingerprint_versioned_(spark: SparkSession, sf: str) -> DataFrame:
    return src.history(spark, sf).select("statement_id", *fingerprint_versioned(F.col("statement_text")))


@query
def document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of the long multilingual texts, whole."""
    return src.table(spark, sf, "documents").select("doc_id", fingerprint(F.col("text")).alias("ck"))


@query
def tag_fields(spark: SparkSession, sf: str) -> DataFrame:
    tag = src.history(spark, sf).select("statement_id", parse_tag(F.col("statement_text")).alias("tag"))
    return tag.select(
        "statement_id",
        F.col("tag.v").alias("v"),
        F.col("tag.ck").alias("ck"),
        F.col("tag.rule").alias("rule_id"),
        F.col("tag.route").alias("route"),
        F.array_size(F.map_keys("tag")).alias("fields"),
    )


@query
def gateway_routed_flag(spark: SparkSession, sf: str) -> DataFrame:
    return src.history(spark, sf).select("statement_id", is_gateway_routed(F.col("statement_text")).alias("routed"))


@query
def has_tag_flag(spark: SparkSession, sf: str) -> DataFrame:
    return src.history(spark, sf).select("statement_id", has_tag(F.col("statement_text")).alias("has_tag"))


@query
def lenient_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that are numbers and texts that are not."""
    digit = F.substring("o_orderpriority", 1, 1)
    return src.table(spark, sf, "orders").select(
        "o_orderkey", to_number(digit).alias("digit"), to_number(F.col("o_orderpriority")).alias("label")
    )


# Ingest


@query
def finished_statements(spark: SparkSession, sf: str) -> DataFrame:
    return predicates.finished(src.history(spark, sf)).select(
        "statement_id", "warehouse_id", "total_duration_ms", "start_time", "statement_text"
    )


def _loaded(spark: SparkSession, sf: str) -> DataFrame:
    """What an ingest before the cut has stored."""
    return _prints(spark, sf).where(F.col("start_time") < F.lit(CUT).cast("timestamp"))


@query
def ingest_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.checkpoint(_loaded(spark, sf), ingest.first_load_from(P.as_of))


@query
def incremental_since(spark: SparkSession, sf: str) -> DataFrame:
    """Finished statements after the newest stored one, up to the present."""
    position = ingest.checkpoint(_loaded(spark, sf), ingest.first_load_from(P.as_of)).scalar()
    return predicates.since(predicates.finished(src.history(spark, sf)), position).select(
        "statement_id", "warehouse_id", "total_duration_ms", "start_time", "statement_text"
    )


@query
def ingest_batch(spark: SparkSession, sf: str) -> DataFrame:
    position = ingest.first_load_from(P.as_of)
    return ingest.ingest_batch(src.history(spark, sf), position).drop("ingested_at")


@query
def ingest_whole_seconds(spark: SparkSession, sf: str) -> DataFrame:
    position = ingest.first_load_from(P.as_of)
    return ingest.ingest_batch(src.history(spark, sf), position, whole_seconds=True).select(
        "ck", "statement_id", "d", "start_time"
    )


@query
def ingest_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    """The whole log arrives twice after its first two thirds were stored: only the rest is new."""
    history = src.history(spark, sf)
    again = to_prints(history.unionByName(history), F.lit(CUT).cast("timestamp"))
    return ingest.dedupe(again, _loaded(spark, sf)).drop("ingested_at")


@query
def fingerprint_history_table(spark: SparkSession, sf: str) -> DataFrame:
    """The ingest job on a table that has the first two thirds of the log, read back."""
    root = new_folder(spark, "state")
    state.create_state(spark, root, ["fingerprint_history"])
    state.append(_loaded(spark, sf), root, "fingerprint_history")
    run_ingest(spark, root, src.history(spark, sf), P)
    return state.read_state(spark, root, "fingerprint_history").drop("ingested_at")


@query
def ingest_late_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs of the ingest job: half of the statements before the cut arrive in the second, up to months late."""
    root = new_folder(spark, "state")
    state.create_state(spark, root, ["fingerprint_history"])
    log = src.history(spark, sf)
    late = (F.col("start_time") < F.lit(CUT).cast("timestamp")) & (F.xxhash64("statement_id") % 2 == 0)
    run_ingest(spark, root, log.where(~late), P)
    run_ingest(spark, root, log, P)
    return state.read_state(spark, root, "fingerprint_history").drop("ingested_at")


# Days of which half the statements arrive in the second delivery: 30 hours and 40 days late.
LATE_DAYS = ("2024-03-29", "2024-02-20")
LAST_DAY = "2024-03-30"
# Files of a delivery per core: even ones, so that neither their writing nor their reading waits for a few tasks.
FILES_PER_CORE = 4


def _deliveries(spark: SparkSession, sf: str) -> list[tuple[DataFrame, DataFrame]]:
    """The log in two deliveries, and what the history view shows after each.

    The second has the last day, the late statements and some of the first delivery again.
    """
    # Texts are made from rows that are dealt out evenly, whatever the row groups of the table.
    files = FILES_PER_CORE * spark.sparkContext.defaultParallelism
    log = src.history_from_events(src.table(spark, sf, "events").repartition(files, "event_id"))
    day, half = F.to_date("start_time"), F.xxhash64("statement_id") % 2 == 0
    late = (day >= F.lit(LAST_DAY).cast("date")) | (day.isin(*(F.lit(d).cast("date") for d in LATE_DAYS)) & half)
    again = day == F.lit(LATE_DAYS[0]).cast("date")
    return [(log.where(~late), log.where(~late)), (log.where(late | again), log)]


def _two_deliveries(spark: SparkSession, sf: str, recomputed: bool = False) -> str:
    """The jobs after each of two deliveries, by files; the root of their tables."""
    root, folder = new_folder(spark, "state"), new_folder(spark, "log")
    state.create_state(spark, root)
    for delivered, history in _deliveries(spark, sf):
        delivered.write.mode("append").parquet(folder)
        run_ingest_files(spark, root, folder, P)
        if recomputed:
            run_recompute(spark, root, history, src.billing(spark, sf), P, only_changed=True)
    return root


@query
def ingest_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Ingest by arrival: the second run opens the files of the second delivery only."""
    root = _two_deliveries(spark, sf)
    return state.read_state(spark, root, "fingerprint_history").drop("ingested_at")


@query
def ingest_changed_days(spark: SparkSession, sf: str) -> DataFrame:
    """The days each delivery touched, with the statements that are stored of them."""
    root = _two_deliveries(spark, sf)
    changed = state.read_state(spark, root, "changed_days")
    batches = changed.groupBy("batch").agg(F.min("changed_at").alias("at"), F.count("*").alias("days"))
    stored = state.read_state(spark, root, "fingerprint_history").groupBy("d").agg(F.count("*").alias("statements"))
    last = batches.agg(F.max("at"))
    second = changed.where(F.col("changed_at") == last.scalar()).select("d")
    return stored.join(second, "d").select("d", "statements")


@query
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The log as a stream into the state table, read back."""
    root = new_folder(spark, "stream-state")
    state.create_state(spark, root, ["fingerprint_history"])
    log = src.history_from_events(_event_stream(spark, sf))
    start_ingest(log, root, new_folder(spark, "stream-position")).awaitTermination()
    return state.read_state(spark, root, "fingerprint_history").drop("ingested_at")


@query
def stream_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Daily coverage kept up to date by a stream, read back."""
    root = new_folder(spark, "stream-state")
    log = src.history_from_events(_event_stream(spark, sf))
    start_coverage(log, root, new_folder(spark, "stream-position")).awaitTermination()
    return state.read_state(spark, root, "coverage_daily").select(
        "d", "gateway_routed", "total", *ratio("coverage_ratio")
    )


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a file stream, whether they are one file or a folder of files."""
    path = f"{sf}/events.parquet"
    reader = spark.readStream.schema(src.EVENTS)
    file = spark.read.parquet(path).select("_metadata.file_name").first()
    if file is not None and path.endswith(f"/{file[0]}"):
        return reader.option("pathGlobFilter", file[0]).parquet(sf)
    return reader.parquet(path)


# Cost


@query
def waterfall_daily(spark: SparkSession, sf: str) -> DataFrame:
    return cost.waterfall_daily(src.billing(spark, sf), P).select(
        "d", "sku_name", "warehouse_id", *money("dbus", "usd"), "layer"
    )


@query
def waterfall_table(spark: SparkSession, sf: str) -> DataFrame:
    """The waterfall table after a recompute over 90 days and one over 30 that keeps older days."""
    root = new_folder(spark, "state")
    billing = src.billing(spark, sf)
    for lookback in (90, P.lookback):
        df = cost.waterfall_daily(billing, Params(P.as_of, lookback=lookback))
        state.overwrite(df.withColumn("updated_at", F.current_timestamp()), root, "waterfall_daily")
    return state.read_state(spark, root, "waterfall_daily").select(
        "d", "sku_name", "warehouse_id", *money("dbus", "usd"), "layer"
    )


@query
def waterfall_withdrawn_day(spark: SparkSession, sf: str) -> DataFrame:
    """The waterfall table after two recomputes; between them the usage of ten days was withdrawn."""
    root = new_folder(spark, "state")
    state.create_state(spark, root, ["waterfall_daily"])
    billing = src.billing(spark, sf)
    for usage in (billing, billing.where(~F.col("d").between(P.day(20), P.day(11)))):
        df = cost.waterfall_daily(usage, P).withColumn("updated_at", F.current_timestamp())
        state.overwrite(df, root, "waterfall_daily", replaced_from=P.ago(P.lookback))
    return state.read_state(spark, root, "waterfall_daily").select(
        "d", "sku_name", "warehouse_id", *money("dbus", "usd"), "layer"
    )


@query
def warehouse_cost(spark: SparkSession, sf: str) -> DataFrame:
    return cost.warehouse_cost(src.billing(spark, sf), P).select("d", "warehouse_id", *money("wh_usd"))


@query
def warehouse_duration(spark: SparkSession, sf: str) -> DataFrame:
    return cost.warehouse_duration(_prints(spark, sf), P)


@query
def attributed_cost(spark: SparkSession, sf: str) -> DataFrame:
    return cost.attributed_ranking(_prints(spark, sf), src.billing(spark, sf), P).select(
        "ck", "execs", *money("attributed_usd")
    )


@query
def attributed_cost_90(spark: SparkSession, sf: str) -> DataFrame:
    """The same over the whole log."""
    return cost.attributed_ranking(
        _prints(spark, sf), src.billing(spark, sf), Params(P.as_of, lookback=90)
    ).select("ck", "execs", *money("attributed_usd"))


# Coverage


@query
def coverage_daily(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.coverage_daily(src.history(spark, sf), P).select(
        "d", "gateway_routed", "total", *ratio("coverage_ratio")
    )


def _trend(spark: SparkSession, sf: str) -> DataFrame:
    return reports.coverage_trend(coverage.coverage_daily(src.history(spark, sf), P), P)


@query
def coverage_trend(spark: SparkSession, sf: str) -> DataFrame:
    return _trend(spark, sf)


@query
def coverage_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return reports.coverage_kpis(_trend(spark, sf)).select(
        *ratio("avg_coverage_pct", "untagged_pct"), "total_statements", "gateway_routed", "alert"
    )


# Savings


@query
def baseline_rate(spark: SparkSession, sf: str) -> DataFrame:
    return savings.baseline_rate(_prints(spark, sf), P).select(
        "ck", "rule_id", F.col("baseline_rate").cast("double").alias("baseline_rate")
    )


@query
def observed_execs(spark: SparkSession, sf: str) -> DataFrame:
    return savings.observed_execs(_prints(spark, sf), P)


@query
def rule_effectiveness(spark: SparkSession, sf: str) -> DataFrame:
    return _effect(spark, sf).select(*_effect_columns(), "observed", "avoided", *money("realized_usd"))


@query
def rule_effectiveness_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _effect(spark, sf, Params(P.as_of, exact_counts=True)).select(
        *_effect_columns(), "observed", "avoided", *money("realized_usd")
    )


@query
def effectiveness_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Newest of two comparison windows in the effectiveness table."""
    root = new_folder(spark, "state")
    for as_of in (P.as_of, P.ago(1)):
        effect = _effect(spark, sf, Params(as_of)).withColumn("updated_at", F.current_timestamp())
        state.append(effect, root, "rule_effectiveness")
    return rules.export_rows(state.read_state(spark, root, "rule_effectiveness")).select(
        "rule_id", "ck", "window", "avoided", *money("realized_usd")
    )


@query
def fully_avoided(spark: SparkSession, sf: str) -> DataFrame:
    return savings.fully_avoided(_prints(spark, sf), src.billing(spark, sf), P).select(
        *_effect_columns(), "avoided", *money("realized_usd")
    )


@query
def savings_layers(spark: SparkSession, sf: str) -> DataFrame:
    return savings.savings_layers(_prints(spark, sf), src.billing(spark, sf), P).select("layer", *money("usd"))


# Reports


@query
def redundant_top50(spark: SparkSession, sf: str) -> DataFrame:
    return _seconds(reports.redundant_top(_prints(spark, sf), P))


@query
def redundancy_table(spark: SparkSession, sf: str) -> DataFrame:
    return _seconds(reports.redundancy_table(_prints(spark, sf), P))


def _seconds(df: DataFrame) -> DataFrame:
    return df.withColumn("total_sec", F.col("total_sec").cast("double"))


@query
def redundant_count(spark: SparkSession, sf: str) -> DataFrame:
    return reports.redundant_count(reports.redundancy_table(_prints(spark, sf), P))


@query
def spend_by_sku(spark: SparkSession, sf: str) -> DataFrame:
    """All layers of the waterfall."""
    waterfall = savings.full_waterfall(_prints(spark, sf), src.billing(spark, sf), P)
    return reports.spend_by_sku(waterfall, P).select("d", "sku_name", *money("usd"), "layer")


@query
def savings_kpis(spark: SparkSession, sf: str) -> DataFrame:
    waterfall = cost.waterfall_daily(src.billing(spark, sf), P)
    return reports.savings_kpis(waterfall, _effect(spark, sf), P).select(
        *money("total_usd", "realized_usd", "savings_rate_pct")
    )


@query
def rule_attribution(spark: SparkSession, sf: str) -> DataFrame:
    described = reports.rule_attribution(_effect(spark, sf), src.rules(spark, sf))
    return described.withColumn("baseline_rate", F.col("baseline_rate").cast("double"))


@query
def route_mix(spark: SparkSession, sf: str) -> DataFrame:
    return reports.route_mix(_prints(spark, sf), P)


# The log with tags of all kinds and fingerprints that grow with it


@query
def route_mix_all(spark: SparkSession, sf: str) -> DataFrame:
    return reports.route_mix(to_prints(src.tagged_history(spark, sf)), P)


@query
def tag_audit_all(spark: SparkSession, sf: str) -> DataFrame:
    return rules.tag_audit(src.tagged_history(spark, sf))


@query
def redundant_top50_growing(spark: SparkSession, sf: str) -> DataFrame:
    """The screen cuts: there are many more redundant fingerprints than it shows."""
    return _seconds(reports.redundant_top(to_prints(src.tagged_history(spark, sf)), P))


@query
def redundant_count_growing(spark: SparkSession, sf: str) -> DataFrame:
    return reports.redundant_count(reports.redundancy_table(to_prints(src.tagged_history(spark, sf)), P))


# The shortest and the longest lookback


@query
def coverage_trend_7(spark: SparkSession, sf: str) -> DataFrame:
    params = Params(P.as_of, lookback=7)
    return reports.coverage_trend(coverage.coverage_daily(src.history(spark, sf), params), params)


@query
def redundant_top50_90(spark: SparkSession, sf: str) -> DataFrame:
    return _seconds(reports.redundant_top(_prints(spark, sf), Params(P.as_of, lookback=90)))


@query
def spend_by_sku_90(spark: SparkSession, sf: str) -> DataFrame:
    params = Params(P.as_of, lookback=90)
    waterfall = cost.waterfall_daily(src.billing(spark, sf), params)
    return reports.spend_by_sku(waterfall, params).select("d", "sku_name", *money("usd"), "layer")


# Rules and exchange


@query
def sync_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The sync job from rule files to effectiveness documents: what it stored, wrote and logged."""
    root, incoming, out = (new_folder(spark, n) for n in ("state", "rules", "export"))
    state.create_state(spark, root, ["rules", "rule_effectiveness", "sync_log"])
    src.rule_documents(spark, sf).write.text(incoming)
    effect = _effect(spark, sf).withColumn("updated_at", F.current_timestamp())
    state.overwrite(effect, root, "rule_effectiveness")
    run_sync(spark, root, incoming, out, src.midnight(1), multi_line=False)
    document = "reported_at string, effectiveness array<struct<rule_id: string>>"
    sent = spark.read.schema(document).json(out).agg(F.sum(F.size("effectiveness")).alias("n"))
    size = spark.read.text(out).agg(F.sum(F.octet_length("value")))
    stored = state.read_state(spark, root, "rules").agg(F.count("*"))
    return state.read_state(spark, root, "sync_log").select(
        "direction",
        "status",
        (F.col("payload_bytes") == size.scalar()).alias("size_agrees"),
        stored.scalar().alias("rules"),
        sent.scalar().alias("exported"),
    )


@query
def rules_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return rules.upsert_rules(src.rules(spark, sf), src.incoming_rules(spark, sf))


@query
def rules_table(spark: SparkSession, sf: str) -> DataFrame:
    """The rules table after two snapshots."""
    root = new_folder(spark, "state")
    state.create_state(spark, root, ["rules"])
    state.write_rules(src.rules(spark, sf), root, src.midnight(1))
    merged = rules.upsert_rules(state.read_state(spark, root, "rules"), src.incoming_rules(spark, sf))
    state.write_rules(merged, root, src.midnight(2))
    return state.read_state(spark, root, "rules")


@query
def rules_from_json(spark: SparkSession, sf: str) -> DataFrame:
    return rules.parse_rules(src.rule_documents(spark, sf), "value", F.lit(CUT))


@query
def rule_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of the rule documents that the schema doesn't name, and the types of those that it does."""
    return rules.rule_drift(rules.parse_rules(src.rule_documents(spark, sf), "value", F.lit(CUT)))


@query
def rules_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """Rule documents written as JSON lines and read by the file source."""
    path = new_folder(spark, "rules")
    src.rule_documents(spark, sf).write.text(path)
    return rules.read_rules(spark, path, F.lit(CUT), multi_line=False)


@query
def effectiveness_json(spark: SparkSession, sf: str) -> DataFrame:
    """Export documents made from the effectiveness table, written and read back."""
    root, path = new_folder(spark, "state"), new_folder(spark, "export")
    effect = _effect(spark, sf).withColumn("updated_at", F.current_timestamp())
    state.overwrite(effect, root, "rule_effectiveness")
    stored = state.read_state(spark, root, "rule_effectiveness")
    rules.export_documents(stored, "2024-03-31T00:00:00+00:00", rows_per_document=25).write.text(path)
    document = "reported_at string, effectiveness array<struct<{}>>".format(
        ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in EXPORT)
    )
    row = spark.read.schema(document).json(path).select("reported_at", F.explode("effectiveness").alias("e"))
    return row.select("reported_at", "e.rule_id", "e.ck", "e.window", "e.avoided", "e.realized_usd").withColumn(
        "realized_usd", F.round("realized_usd", 4)
    )


@query
def tag_audit(spark: SparkSession, sf: str) -> DataFrame:
    return rules.tag_audit(src.history(spark, sf))


@query
def recompute_waterfall(spark: SparkSession, sf: str) -> DataFrame:
    """The waterfall table after a second recompute that read changed days only."""
    root = _two_deliveries(spark, sf, recomputed=True)
    return state.read_state(spark, root, "waterfall_daily").select("d", "sku_name", "warehouse_id", *money("usd"), "layer")


@query
def recompute_coverage(spark: SparkSession, sf: str) -> DataFrame:
    root = _two_deliveries(spark, sf, recomputed=True)
    return state.read_state(spark, root, "coverage_daily").select("d", "gateway_routed", "total", *ratio("coverage_ratio"))


@query
def recompute_effectiveness(spark: SparkSession, sf: str) -> DataFrame:
    root = _two_deliveries(spark, sf, recomputed=True)
    return state.read_state(spark, root, "rule_effectiveness").select(
        "ck", "rule_id", "window", "baseline_rate", "observed", "avoided", *money("realized_usd")
    )


@query
def executions_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The roll-up of executions after both deliveries, each rolled up by its changed days."""
    return read_rollup(spark, _two_deliveries(spark, sf, recomputed=True))


@query
def rollup_redundancy(spark: SparkSession, sf: str) -> DataFrame:
    """The redundancy table from the stored roll-up."""
    root = new_folder(spark, "state")
    refresh_rollup(spark, root, _prints(spark, sf))
    return _seconds(reports.redundancy_table(read_rollup(spark, root), P))


@query
def rollup_fully_avoided(spark: SparkSession, sf: str) -> DataFrame:
    root = new_folder(spark, "state")
    refresh_rollup(spark, root, _prints(spark, sf))
    return savings.fully_avoided(read_rollup(spark, root), src.billing(spark, sf), P).select(
        *_effect_columns(), "avoided", *money("realized_usd")
    )


@query
def waterfall_layers(spark: SparkSession, sf: str) -> DataFrame:
    """USD per day and layer; each saving layer adds up to its total of ``savings_layers``."""
    waterfall = savings.full_waterfall(_prints(spark, sf), src.billing(spark, sf), P)
    return waterfall.groupBy("d", "layer").agg(F.round(F.sum("usd"), 4).alias("usd"))


@query
def recompute_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the three tables of one recompute."""
    tables = recompute(src.history(spark, sf), src.billing(spark, sf), _prints(spark, sf), P)
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out
