"""The three jobs over the state tables."""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import utc_day
from tallyframe.operators.cost import daily_usage
from tallyframe.operators.coverage import coverage_daily
from tallyframe.operators.ingest import FIRST_LOAD_DAYS, days_with_news, dedupe, first_load_from, to_prints
from tallyframe.operators.predicates import of_days, since
from tallyframe.operators.rules import export_documents, read_rules, upsert_rules
from tallyframe.operators.savings import full_waterfall, rule_effectiveness
from tallyframe.params import Params
from tallyframe.schemas import STATE
from tallyframe.sources.arrivals import new_files, read_files, short_splits
from tallyframe.sources.rollup import BUCKETS, read_rollup, refresh_rollup
from tallyframe.sources.state import append, log_sync, overwrite, read_state, write_rules


def run_ingest(
    spark: SparkSession,
    root: str,
    history: DataFrame,
    params: Params,
    first_load_days: int = FIRST_LOAD_DAYS,
) -> None:
    """Append the finished statements of any history that are not stored yet. Running it again changes nothing.

    What is new is found by id over the whole history, however late a statement finished or
    arrived; only the days with news are then read with their texts. :func:`run_ingest_files` needs
    neither, as it knows which files it has taken in.
    """
    prints = read_state(spark, root, "fingerprint_history")
    visible = since(history, first_load_from(params.as_of, first_load_days))
    first = params.as_of - timedelta(days=first_load_days)
    days = days_with_news(visible, prints.where(F.col("d") >= F.lit(first)))
    if days:
        append(dedupe(to_prints(of_days(visible, days)), prints, days), root, "fingerprint_history")


def run_ingest_files(
    spark: SparkSession,
    root: str,
    path: str,
    params: Params,
    now: datetime | None = None,
    first_load_days: int = FIRST_LOAD_DAYS,
) -> list[date]:
    """Take in the history files below ``path`` that arrived since the last run; the days they touch.

    Only new files are opened, however old the statements in them, and only the partitions of their days are
    looked up for known statements. The files are noted last: a run that breaks off before that is repeated, and
    finds its statements stored. The days are noted for :func:`run_recompute`.
    """
    now = now or datetime.now(timezone.utc)
    files = new_files(spark, path, read_state(spark, root, "ingested_files")).collect()
    if not files:
        return []
    arrived = since(read_files(spark, [f.path for f in files]), first_load_from(params.as_of, first_load_days))
    # At most one date per day that is still visible.
    days = sorted(r.d for r in arrived.select(utc_day("start_time").alias("d")).distinct().collect())
    if days:
        prints = read_state(spark, root, "fingerprint_history")
        with short_splits(spark):
            append(dedupe(to_prints(arrived), prints, days), root, "fingerprint_history")
        batch = uuid.uuid4().hex
        append(spark.createDataFrame([(d, batch, now) for d in days], STATE["changed_days"]), root, "changed_days")
    noted = spark.createDataFrame([(*f, now) for f in files], STATE["ingested_files"])
    append(noted, root, "ingested_files")
    return days


def pending_changes(spark: SparkSession, root: str) -> tuple[list[date] | None, list[str]]:
    """The days that ingest touched and no recompute has seen, None for all if there was no recompute yet; the batches."""
    log = read_state(spark, root, "recompute_log")
    seen = log.where("batch IS NOT NULL").select("batch")
    rows = read_state(spark, root, "changed_days").join(seen, "batch", "left_anti").select("d", "batch").collect()
    return None if log.isEmpty() else sorted({r.d for r in rows}), sorted({r.batch for r in rows})


def recompute(
    history: DataFrame, billing: DataFrame, prints: DataFrame, params: Params, days: list[date] | None = None
) -> dict[str, DataFrame]:
    """The three aggregate tables, in the order in which they are written; coverage of some ``days`` only, if given.

    ``prints`` are statements or their roll-up.
    """
    tables = {
        "waterfall_daily": full_waterfall(prints, billing, params),
        "coverage_daily": coverage_daily(history, params, days),
        "rule_effectiveness": rule_effectiveness(prints, billing, params),
    }
    return {name: df.withColumn("updated_at", F.current_timestamp()) for name, df in tables.items()}


def run_recompute(
    spark: SparkSession,
    root: str,
    history: DataFrame,
    billing: DataFrame,
    params: Params,
    keep_other_days: bool = True,
    only_changed: bool = False,
    now: datetime | None = None,
    buckets: int = BUCKETS,
) -> None:
    """Rebuild the aggregate tables from the roll-up of executions.

    The days of the lookback are replaced as a whole: one that has no rows any more is removed. Older
    days stay unless told otherwise. With ``only_changed`` the roll-up and the coverage are rebuilt for the days that
    :func:`run_ingest_files` touched since the last recompute, all else comes from the roll-up; the first run has
    them all. Repeating a run that broke off gives the same tables. The usage records are read once and added up per
    day, SKU and warehouse; all three tables are made from these few rows.
    """
    now = now or datetime.now(timezone.utc)
    days, batches = pending_changes(spark, root)
    days = days if only_changed else None
    refresh_rollup(spark, root, read_state(spark, root, "fingerprint_history"), days, buckets)
    usage = daily_usage(billing, params).persist()
    try:
        for table, df in recompute(history, usage, read_rollup(spark, root, buckets), params, days).items():
            part = table == "coverage_daily" and days is not None
            overwrite(df, root, table, keep_other_days or part, None if part else params.ago(params.lookback))
    finally:
        usage.unpersist()
    log = [(now, batch) for batch in batches or [None]]
    append(spark.createDataFrame(log, STATE["recompute_log"]), root, "recompute_log")


def run_sync(
    spark: SparkSession, root: str, rules_path: str, out_path: str, ts: datetime, multi_line: bool = True
) -> None:
    """Take in rule documents, write the effectiveness documents, and log the run.

    Without ``multi_line`` the rule files have one document per line. A failure is logged with its message and raised.
    """
    status, payload_bytes = "ok", 0
    try:
        incoming = read_rules(spark, rules_path, F.lit(ts), multi_line)
        if not incoming.isEmpty():
            write_rules(upsert_rules(read_state(spark, root, "rules"), incoming), root, ts)
        effectiveness = read_state(spark, root, "rule_effectiveness")
        sent = Observation()
        # Counted while it is written.
        size = F.sum(F.octet_length("value")).alias("bytes")
        export_documents(effectiveness, ts.isoformat()).observe(sent, size).write.text(out_path)
        payload_bytes = sent.get.get("bytes") or 0
    except Exception as exc:
        status = f"error: {exc}"
        raise
    finally:
        log_sync(spark, root, ts, payload_bytes, status)
