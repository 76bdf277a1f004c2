from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.coverage import coverage_daily
from tallyframe.operators.ingest import to_prints
from tallyframe.params import Params
from tallyframe.schemas import QUERY_HISTORY
from tallyframe.sources import driver_tables as src
from tallyframe.sources.state import create_state, read_state
from tallyframe.streaming import history_stream, rows_too_late, start_coverage, start_ingest
from tallyframe.streaming import ingest as streaming_ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def arriving(spark, tmp_path):
    """The log in daily deliveries, each repeated in the next one."""
    folder = str(tmp_path / "log")
    log = src.history(spark, SF).where("start_time < '2024-01-11'").cache()
    days = [datetime(2024, 1, 1) + timedelta(days=i) for i in range(10)]

    def deliver(part):
        for d in days[part]:
            late = (F.col("start_time") >= d - timedelta(days=1)) & (F.col("start_time") < d + timedelta(days=1))
            log.where(late).coalesce(1).write.mode("append").parquet(folder)

    return folder, log, deliver


def test_ingest_stream_equals_batch(spark, tmp_path, arriving):
    folder, log, deliver = arriving
    root, position = str(tmp_path / "state"), str(tmp_path / "position")
    create_state(spark, root)
    for part in (slice(0, 4), slice(4, 10)):
        deliver(part)
        start_ingest(history_stream(spark, folder, files_per_batch=2), root, position).awaitTermination()
    start_ingest(history_stream(spark, folder), root, position).awaitTermination()
    # A lost position makes the stream deliver everything again.
    start_ingest(history_stream(spark, folder), root, position + "-new").awaitTermination()
    got = read_state(spark, root, "fingerprint_history").drop("ingested_at")
    want = to_prints(log).drop("ingested_at")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_coverage_stream_equals_batch(spark, tmp_path):
    folder, root, position = (str(tmp_path / n) for n in ("log", "state", "position"))
    create_state(spark, root)
    log = src.history(spark, SF).where("start_time < '2024-01-11'").cache()
    for i in range(4):
        # Every delivery touches every day, so each batch rewrites all of them.
        part = F.pmod(F.xxhash64("statement_id"), F.lit(4)) == i
        log.where(part & (F.col("start_time") < f"2024-01-{4 + 2 * i:02d}")).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: history_stream(spark, folder, files_per_batch=1)
    start_coverage(stream(), root, position).awaitTermination()
    got = read_state(spark, root, "coverage_daily").drop("updated_at")
    arrived = spark.read.schema(QUERY_HISTORY).parquet(folder)
    want = coverage_daily(arrived, Params(src.AS_OF, lookback=90))
    assert sorted(got.collect()) == sorted(want.collect())
    assert got.count() == 9


def test_coverage_stream_counts_late_statements(spark, tmp_path):
    folder, root, position = (str(tmp_path / n) for n in ("log", "state", "position"))
    create_state(spark, root)
    for i, day in enumerate((10, 20, 10)):
        row = (f"s{i}", "u", "w", "SELECT", "FINISHED", 1, 1, datetime(2024, 3, day), None, "SELECT 1")
        spark.createDataFrame([row], QUERY_HISTORY).write.mode("append").parquet(folder)
        start_coverage(history_stream(spark, folder), root, position).awaitTermination()
    rows = read_state(spark, root, "coverage_daily").collect()
    assert {r.d.day: r.total for r in rows} == {10: 2, 20: 1}


def statement(i, start, status="FINISHED"):
    return (f"s{i}", "u", "w", "SELECT", status, 1, 1, start, None, "SELECT 1")


def add_file(spark, folder, *rows):
    spark.createDataFrame(rows, QUERY_HISTORY).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, root, position, **options):
    query = start_ingest(history_stream(spark, folder, files_per_batch=1), root, position, **options)
    query.awaitTermination()
    return query


def ids(spark, root):
    return sorted(r.statement_id for r in read_state(spark, root, "fingerprint_history").collect())


def test_state_replaces_the_look_up(spark, tmp_path, monkeypatch):
    """Copies in one batch, in later batches and runs, late ones and a start in the future; the table is not asked."""
    folder, root, position = (str(tmp_path / n) for n in ("log", "state", "position"))
    create_state(spark, root)
    monkeypatch.setattr(streaming_ingest, "dedupe", None)
    now, until = datetime(2024, 3, 30, 10), datetime(2024, 3, 31, tzinfo=timezone.utc)
    add_file(spark, folder, statement(1, now), statement(1, now), statement(2, datetime(2030, 1, 1)), statement(3, now, "RUNNING"))
    run(spark, folder, root, position, until=until)
    assert ids(spark, root) == ["s1", "s2"]
    add_file(spark, folder, statement(1, now), statement(3, now), statement(4, now - timedelta(days=40)))
    add_file(spark, folder, statement(4, now - timedelta(days=40)), statement(5, now - timedelta(hours=30)))
    query = run(spark, folder, root, position, until=until)
    assert ids(spark, root) == ["s1", "s2", "s3", "s4", "s5"] and rows_too_late(query) == 0
    assert read_state(spark, root, "stream_batches").count() >= 3
    assert any("rocksdb" in k.lower() for k in query.lastProgress.stateOperators[0].customMetrics)


def test_rows_older_than_the_state_are_counted(spark, tmp_path):
    folder, root, position = (str(tmp_path / n) for n in ("log", "state", "position"))
    create_state(spark, root)
    now = datetime(2024, 3, 30, 10)
    add_file(spark, folder, statement(1, now))
    run(spark, folder, root, position, keep_days=5)
    add_file(spark, folder, statement(2, now - timedelta(days=9)), statement(3, now - timedelta(days=4)))
    query = run(spark, folder, root, position, keep_days=5)
    assert ids(spark, root) == ["s1", "s3"] and rows_too_late(query) == 1


def test_a_repeated_batch_adds_nothing(spark, tmp_path, monkeypatch):
    folder, root, position = (str(tmp_path / n) for n in ("log", "state", "position"))
    create_state(spark, root)
    add_file(spark, folder, *(statement(i, datetime(2024, 3, 30, i)) for i in range(5)))
    write = streaming_ingest.append

    def failing(df, root, table):
        write(df, root, table)
        if table == "fingerprint_history":
            raise OSError("lost after the write")

    monkeypatch.setattr(streaming_ingest, "append", failing)
    with pytest.raises(Exception, match="lost after the write"):
        run(spark, folder, root, position)
    assert ids(spark, root) == [f"s{i}" for i in range(5)]
    monkeypatch.setattr(streaming_ingest, "append", write)
    run(spark, folder, root, position)
    assert ids(spark, root) == [f"s{i}" for i in range(5)]
