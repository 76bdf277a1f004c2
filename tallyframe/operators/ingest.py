"""Incremental ingest of the history into fingerprint rows; the statement text is not kept."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import fingerprint, tag_tokens, to_second, token_value, utc_day, utc_midnight
from tallyframe.operators.predicates import finished, since
from tallyframe.schemas import FINGERPRINT_HISTORY

# Days the first load goes back: everything the history view shows.
FIRST_LOAD_DAYS = 90


def first_load_from(as_of: date, days: int = FIRST_LOAD_DAYS) -> Column:
    return utc_midnight(as_of - timedelta(days=days))


def checkpoint(prints: DataFrame, default: Column) -> DataFrame:
    """One row: start of the newest ingested statement, or the default for an empty table."""
    return prints.agg(F.coalesce(F.max("start_time"), default).alias("checkpoint"))


def to_prints(history: DataFrame, ingested_at: Column | None = None, whole_seconds: bool = False) -> DataFrame:
    """Fingerprint rows of the finished statements that have an id and a start time: no shuffle.

    A statement without an id can't be told from its copies; ``unnamed`` counts these.     ``whole_seconds`` cuts the start time to seconds, as a log loaded through formatted strings has it.
    """
    start = to_second(F.col("start_time")) if whole_seconds else F.col("start_time")
    return (
        finished(history)
        .where("start_time IS NOT NULL AND statement_id IS NOT NULL")
        .withColumn("_tokens", tag_tokens(F.col("statement_text")))
        .select(
            fingerprint(F.col("statement_text")).alias("ck"),
            "statement_id",
            utc_day("start_time").alias("d"),
            start.alias("start_time"),
            "warehouse_id",
            "total_duration_ms",
            token_value(F.col("_tokens"), "route").alias("route"),
            token_value(F.col("_tokens"), "rule").alias("rule_id"),
            (F.current_timestamp() if ingested_at is None else ingested_at).alias("ingested_at"),
        )
    )


def unnamed(history: DataFrame) -> DataFrame:
    """One row: finished statements that an ingest leaves out, as they have no id or no start time."""
    left_out = F.count_if(F.col("statement_id").isNull() | F.col("start_time").isNull())
    return finished(history).agg(left_out.alias("left_out"))


def ingest_batch(
    history: DataFrame,
    position: datetime | Column,
    ingested_at: Column | None = None,
    whole_seconds: bool = False,
) -> DataFrame:
    """Fingerprint rows of the finished statements started after the position."""
    return to_prints(since(history, position), ingested_at, whole_seconds)


def unique_statements(prints: DataFrame) -> DataFrame:
    """One row per ``statement_id``: the one with the greatest start time, then the other columns.

    An aggregation, so copies collapse before the shuffle; a statement delivered very often costs
    one row per task.
    """
    rest = [c for c in FINGERPRINT_HISTORY.names if c not in ("statement_id", "start_time")]
    kept = prints.groupBy("statement_id").agg(F.max(F.struct("start_time", *rest)).alias("r"))
    return kept.select(*[c if c == "statement_id" else f"r.{c}" for c in FINGERPRINT_HISTORY.names])


def dedupe(new: DataFrame, prints: DataFrame, days: Iterable[date] | None = None) -> DataFrame:
    """Rows of ``new`` whose statement is not in ``prints`` yet, one per statement.

    The start time of a statement never changes, so known statements are looked up only in the
    partitions of the ``days`` that occur in the batch. Both sides are narrow and unique per key: the
    text was dropped before, and no key can be hot.
    """
    known = prints if days is None else prints.where(F.col("d").isin(*days))
    return unique_statements(new).join(known.select("d", "statement_id"), ["d", "statement_id"], "left_anti").select(
        *FINGERPRINT_HISTORY.names
    )


def days_with_news(history: DataFrame, prints: DataFrame) -> list[date]:
    """The days on which ``history`` has finished statements that ``prints`` lacks, by ids alone.

    At most one date per day of the history is returned; statement texts are not read.
    """
    seen = finished(history).where("start_time IS NOT NULL AND statement_id IS NOT NULL")
    seen = seen.select(utc_day("start_time").alias("d"), "statement_id")
    missing = seen.join(prints.select("d", "statement_id"), ["d", "statement_id"], "left_anti")
    return sorted(r.d for r in missing.select("d").distinct().collect())
