"""Ingest by arrival and the recompute of changed days."""

import os
import shutil
from datetime import date, datetime, timedelta

import data
import pytest
from pyspark.sql import functions as F

from tallyframe.operators.ingest import to_prints
from tallyframe.params import Params
from tallyframe.plans import jobs, registry
from tallyframe.schemas import QUERY_HISTORY
from tallyframe.sources import arrivals, state
from tallyframe.sources import driver_tables as src
from tallyframe.sources.rollup import read_rollup, refresh_rollup, rollup_gaps, rolled_up

SF = "/root/testdata/sf0.001"
START = datetime(2024, 3, 30, 10)


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path / "state")
    state.create_state(spark, path)
    return path


def statement(i, start, status="FINISHED", text="SELECT 1"):
    return (f"s{i}", "u1", "wh0", "SELECT", status, 5, 1, start, start, text)


def deliver(spark, folder, rows, name):
    """One file of the given name."""
    made = f"{folder.replace("/log", "/made")}-{name}"
    spark.createDataFrame(rows, QUERY_HISTORY).coalesce(1).write.parquet(made)
    (part,) = [f for f in os.listdir(made) if f.endswith(".parquet")]
    os.makedirs(folder, exist_ok=True)
    shutil.copy(f"{made}/{part}", f"{folder}/{name}.parquet")


def stored(spark, root):
    return sorted(r.statement_id for r in state.read_state(spark, root, "fingerprint_history").collect())


def names(df):
    return sorted(r.path.rsplit("/", 1)[1] for r in df.collect())


def test_only_new_files_are_listed(spark, root, tmp_path):
    folder = str(tmp_path / "log")
    deliver(spark, folder, [statement(1, START)], "a")

    def found():
        return names(arrivals.new_files(spark, folder, state.read_state(spark, root, "ingested_files")))

    assert found() == ["a.parquet"]
    jobs.run_ingest_files(spark, root, folder, data.P)
    assert found() == []
    deliver(spark, f"{folder}/sub", [statement(2, START)], "b")
    open(f"{folder}/_SUCCESS", "w").close()
    assert found() == ["b.parquet"]
    # A file that was written again counts as new.
    os.utime(f"{folder}/a.parquet", (2_000_000_000, 2_000_000_000))
    assert found() == ["a.parquet", "b.parquet"]


def test_old_files_are_not_listed_again(spark, tmp_path):
    folder = str(tmp_path / "log")
    for n, name in enumerate("abc"):
        deliver(spark, folder, [statement(n, START)], name)
        moment = 1_700_000_000 + n * 86_400
        os.utime(f"{folder}/{name}.parquet", (moment, moment))
    newest = datetime.fromtimestamp(1_700_000_000 + 2 * 86_400).astimezone()
    assert names(arrivals.listed_files(spark, folder, newest - timedelta(hours=6))) == ["c.parquet"]
    assert names(arrivals.listed_files(spark, folder)) == ["a.parquet", "b.parquet", "c.parquet"]


def test_second_run_reads_the_new_file_only(spark, root, tmp_path, monkeypatch):
    """Statements 30 hours and 40 days late, one that had been running, and repeated ones."""
    folder, opened = str(tmp_path / "log"), []
    read = arrivals.read_files

    def watched(spark, paths):
        df = read(spark, paths)
        opened.append(sorted(f.rsplit("/", 1)[1] for f in df.inputFiles()))
        return df

    monkeypatch.setattr(jobs, "read_files", watched)
    running = statement(7, START - timedelta(hours=3), "RUNNING")
    too_old = statement(8, START - timedelta(days=95))
    deliver(spark, folder, [statement(1, START), running, too_old], "first")
    assert jobs.run_ingest_files(spark, root, folder, data.P) == [date(2024, 3, 30)]
    assert stored(spark, root) == ["s1"]
    late = [statement(2, START - timedelta(hours=30)), statement(3, START - timedelta(days=40))]
    again = [statement(1, START), statement(7, START - timedelta(hours=3))]
    deliver(spark, folder, [*late, *again, *late], "second")
    assert jobs.run_ingest_files(spark, root, folder, data.P) == [date(2024, 2, 19), date(2024, 3, 29), date(2024, 3, 30)]
    assert stored(spark, root) == ["s1", "s2", "s3", "s7"]
    assert jobs.run_ingest_files(spark, root, folder, data.P) == []
    assert opened == [["first.parquet"], ["second.parquet"]]


def test_a_run_that_breaks_off_is_repeated(spark, root, tmp_path, monkeypatch):
    folder = str(tmp_path / "log")
    deliver(spark, folder, [statement(i, START) for i in range(5)], "a")
    add = jobs.append

    def failing(df, root, table):
        if table == "ingested_files":
            raise OSError("lost")
        add(df, root, table)

    monkeypatch.setattr(jobs, "append", failing)
    with pytest.raises(OSError):
        jobs.run_ingest_files(spark, root, folder, data.P)
    monkeypatch.setattr(jobs, "append", add)
    assert jobs.run_ingest_files(spark, root, folder, data.P) == [date(2024, 3, 30)]
    assert stored(spark, root) == [f"s{i}" for i in range(5)]
    assert state.read_state(spark, root, "ingested_files").count() == 1


def test_files_without_visible_statements(spark, root, tmp_path):
    folder = str(tmp_path / "log")
    nameless = (None, *statement(0, START)[1:])
    deliver(spark, folder, [], "empty")
    deliver(spark, folder, [statement(1, START - timedelta(days=100))], "old")
    assert jobs.run_ingest_files(spark, root, folder, data.P) == []
    deliver(spark, folder, [nameless, statement(2, None)], "nameless")
    assert jobs.run_ingest_files(spark, root, folder, data.P) == [date(2024, 3, 30)]
    assert stored(spark, root) == [] and jobs.run_ingest_files(spark, root, folder, data.P) == []


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def values(df, *drop):
    rows = (tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.drop(*drop).collect())
    return sorted(rows, key=str)


def test_changed_days_give_the_tables_of_a_whole_run(spark, tmp_path):
    log, billing = src.history(spark, SF).cache(), src.billing(spark, SF)
    late = (F.to_date("start_time") == F.lit("2024-03-28").cast("date")) | (F.to_date("start_time") == F.lit("2024-02-20").cast("date"))
    roots = [str(tmp_path / name) for name in ("whole", "parts")]
    folder = str(tmp_path / "log")
    for root in roots:
        state.create_state(spark, root)
    log.where(~late).write.parquet(folder)
    jobs.run_ingest_files(spark, roots[1], folder, data.P)
    jobs.run_recompute(spark, roots[1], log.where(~late), billing, data.P, only_changed=True)
    files = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "parts" / "executions_daily_8").rglob("*.parquet")}
    log.where(late).write.mode("append").parquet(folder)
    jobs.run_ingest_files(spark, roots[1], folder, data.P)
    days, _ = jobs.pending_changes(spark, roots[1])
    assert days == [date(2024, 2, 20), date(2024, 3, 28)]
    jobs.run_recompute(spark, roots[1], log, billing, data.P, only_changed=True)
    # Other days of the roll-up were not written again.
    kept = {f.name for f in (tmp_path / "parts" / "executions_daily_8").rglob("*.parquet") if "2024-03-28" not in str(f) and "2024-02-20" not in str(f)}
    assert kept and kept <= set(files)
    assert jobs.pending_changes(spark, roots[1]) == ([], [])
    state.append(to_prints(log), roots[0], "fingerprint_history")
    jobs.run_recompute(spark, roots[0], log, billing, data.P)
    for table in ("waterfall_daily", "coverage_daily", "rule_effectiveness"):
        whole, parts = (values(state.read_state(spark, r, table), "updated_at") for r in roots)
        assert whole == parts and whole
    whole, parts = (values(read_rollup(spark, r)) for r in roots)
    assert whole == parts
    assert rollup_gaps(read_rollup(spark, roots[1]), state.read_state(spark, roots[1], "fingerprint_history")).isEmpty()


def test_gaps_are_found(spark, tmp_path):
    rows = data.prints_rows(n=300)
    prints = data.prints_df(spark, rows)
    root = str(tmp_path / "state")
    refresh_rollup(spark, root, prints, [data.day(0), data.day(15)], buckets=2)
    gaps = {r.d for r in rollup_gaps(read_rollup(spark, root, 2), prints).collect()}
    assert gaps == {r[2] for r in rows} - {data.day(0), data.day(15)}
    refresh_rollup(spark, root, prints, [], buckets=2)
    refresh_rollup(spark, root, prints, buckets=2)
    assert values(read_rollup(spark, root, 2)) == values(rolled_up(prints))


def test_reports_from_the_rollup_equal_those_from_statements(spark, tmp_path):
    from tallyframe.operators import cost, reports, savings

    prints = data.prints_df(spark, data.prints_rows())
    billing = data.billing_df(spark, data.billing_rows())
    root = str(tmp_path / "state")
    refresh_rollup(spark, root, prints)
    rollup = read_rollup(spark, root)
    for params in (data.P, Params(data.AS_OF, lookback=90, exact_counts=True)):
        for made in (
            lambda p, params=params: cost.warehouse_duration(p, params),
            lambda p, params=params: cost.attributed_cost(p, billing, params),
            lambda p, params=params: savings.baseline_rate(p, params),
            lambda p, params=params: savings.observed_execs(p, params),
            lambda p, params=params: savings.rule_effectiveness(p, billing, params),
            lambda p, params=params: savings.fully_avoided(p, billing, params),
            lambda p, params=params: savings.full_waterfall(p, billing, params),
            lambda p, params=params: reports.redundancy_table(p, params),
        ):
            assert values(made(rollup)) == values(made(prints))


def test_no_exchange_by_fingerprint(spark, tmp_path):
    """Buckets place the roll-up by fingerprint: the savings comparison groups and joins without moving it again."""
    from tallyframe.operators import savings

    prints = data.prints_df(spark, data.prints_rows())
    root = str(tmp_path / "state")
    refresh_rollup(spark, root, prints)
    rollup = read_rollup(spark, root)
    billing = data.billing_df(spark, data.billing_rows()).where("usage_quantity > 0")
    billing.write.parquet(str(tmp_path / "billing"))
    billing = spark.read.parquet(str(tmp_path / "billing"))
    for df in (savings.baseline_rate(rollup, data.P), savings.observed_execs(rollup, data.P)):
        assert "Exchange" not in plan(df) and "Bucketed: true" in plan(df)
    text = plan(savings.rule_effectiveness(rollup, billing, data.P))
    assert "Bucketed: true" in text
    assert not [line for line in text.splitlines() if "hashpartitioning(ck" in line]
    assert "hashpartitioning(ck" in plan(savings.rule_effectiveness(prints, billing, data.P))


def test_rollup_of_another_session_is_found(spark, tmp_path):
    prints = data.prints_df(spark, data.prints_rows(n=100))
    root = str(tmp_path / "it's state")
    refresh_rollup(spark, root, prints, buckets=3)
    from tallyframe.sources.rollup import rollup_table

    spark.sql(f"DROP TABLE {rollup_table(spark, root, 3)}")
    assert values(read_rollup(spark, root, 3)) == values(rolled_up(prints))


def test_usage_records_are_read_once(spark, root):
    """One recompute makes three tables and their layers from one pass over the usage records."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(_):
        read.add(1)
        return True

    history, billing = src.history(spark, SF), src.billing(spark, SF)
    state.append(to_prints(history), root, "fingerprint_history")
    watched = billing.where(counted.asNondeterministic()("usage_quantity"))
    jobs.run_recompute(spark, root, history, watched, src.PARAMS)
    assert read.value == billing.count()
    spend = state.read_state(spark, root, "waterfall_daily").where("layer = 'raw'").agg(F.round(F.sum("usd"), 4))
    known = billing.where((F.col("d") >= src.PARAMS.since) & F.col("warehouse_id").isNotNull())
    assert spend.first()[0] == known.agg(F.round(F.sum(F.col("usage_quantity").cast("double")) * 0.7, 4)).first()[0]


def test_deliveries_are_even_files(spark, tmp_path):
    """The events are one row group, which is one task; their texts are made and read by many."""
    assert src.table(spark, SF, "events").rdd.getNumPartitions() == 1
    folder = str(tmp_path / "log")
    first, _ = registry._deliveries(spark, SF)[0]
    first.write.parquet(folder)
    rows = [r["count"] for r in spark.read.parquet(folder).groupBy(F.input_file_name()).count().collect()]
    assert len(rows) > spark.sparkContext.defaultParallelism and max(rows) * len(rows) <= 2 * sum(rows)


def test_texts_are_read_in_short_splits(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    with pytest.raises(OSError), arrivals.short_splits(spark):
        assert int(spark.conf.get("spark.sql.files.maxPartitionBytes")) == arrivals.TEXT_SPLIT
        raise OSError("lost")
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
