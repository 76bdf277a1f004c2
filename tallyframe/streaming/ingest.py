from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyframe.operators.ingest import dedupe, to_prints
from tallyframe.schemas import FINGERPRINT_HISTORY, QUERY_HISTORY, STATE
from tallyframe.sources.state import append, create_state, read_state
from tallyframe.sources.views import HISTORY_DAYS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def history_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """History files as they arrive. ``files_per_batch`` bounds a batch when much has piled up."""
    reader = spark.readStream.schema(QUERY_HISTORY)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def unique_prints(history: DataFrame, keep_days: int = HISTORY_DAYS, until: datetime | None = None) -> DataFrame:
    """Fingerprint rows of a stream of statements, each statement once within ``keep_days``.

    The texts become fingerprints before anything is moved. State holds an id for ``keep_days`` after its statement
    started, as measured by the newest statement. A start after ``until``, by default in the future, counts as that
    moment, so that it can't age the others.
    """
    seen_at = F.least("start_time", F.current_timestamp() if until is None else F.lit(until))
    prints = to_prints(history).withColumn("_seen_at", seen_at).withWatermark("_seen_at", f"{keep_days} days")
    return prints.dropDuplicatesWithinWatermark(["statement_id"]).select(*FINGERPRINT_HISTORY.names)


def rows_too_late(query: StreamingQuery) -> int:
    """Rows of the run that came after their statement's time in the state had passed; they were not added."""
    operators = (op for progress in query.recentProgress for op in progress.stateOperators)
    return sum(op.numRowsDroppedByWatermark for op in operators)


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """State on the disks of the executors, with the session as it was afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def start_ingest(
    history: DataFrame,
    root: str,
    checkpoint_dir: str,
    keep_days: int = HISTORY_DAYS,
    until: datetime | None = None,
) -> StreamingQuery:
    """Add all that has arrived to ``fingerprint_history``, each statement once, and stop.

    What is known is kept in the state of the stream for the days that the history shows, so a batch does not read the
    table. It is looked up there in two cases only: for a batch that was begun before and is repeated after a
    failure, and for a stream that began on a table with rows, as one does that lost its position. Statements that
    come later than ``keep_days`` are not added; ``rows_too_late`` counts them. One writer at a time.
    """
    spark = history.sparkSession
    create_state(spark, root, ["stream_batches"])

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        prints = read_state(session, root, "fingerprint_history")
        own = read_state(session, root, "stream_batches").where(F.col("position") == F.lit(checkpoint_dir))
        # One row per batch of this stream.
        begun = {r.batch: r.on_rows for r in own.where(F.col("batch").isin(0, number)).collect()}
        on_rows = begun[0] if 0 in begun else not prints.isEmpty()
        if number not in begun:
            row = (checkpoint_dir, number, on_rows, datetime.now(timezone.utc))
            append(session.createDataFrame([row], STATE["stream_batches"]), root, "stream_batches")
        if on_rows or number in begun:
            days = [r.d for r in batch.select("d").distinct().collect()]
            batch = dedupe(batch, prints, days) if days else batch
        append(batch, root, "fingerprint_history")

    with _rocksdb(spark):
        return (
            unique_prints(history, keep_days, until)
            .writeStream.foreachBatch(add)
            .option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True)
            .start()
        )
