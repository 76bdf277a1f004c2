"""The six state tables as Parquet below one root folder.

Daily tables are partitioned by ``d``. Rows are rebalanced by ``d`` before a write, so a day gets
few files, while a day larger than the advisory partition size is split over several tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.schemas import PARTITIONED_BY, RULES, STATE, SYNC_LOG

# The rules table keeps every version of itself as a partition.
RULE_SNAPSHOTS = T.StructType([*RULES.fields, T.StructField("snapshot", T.LongType())])


def state_path(root: str, table: str) -> str:
    return f"{root}/{table}"


def conform(df: DataFrame, table: str) -> DataFrame:
    """Declared columns in declared order and type; a NULL in a NOT NULL column fails the job."""
    schema = STATE[table]
    missing = set(schema.names) - set(df.columns)
    if missing:
        raise ValueError(f"{table} lacks columns {sorted(missing)}")
    out = []
    for field in schema:
        col = F.col(field.name).cast(field.dataType)
        if not field.nullable:
            col = F.coalesce(col, F.raise_error(F.lit(f"NULL in {table}.{field.name}")).cast(field.dataType))
        out.append(col.alias(field.name))
    return df.select(*out)


def _writer(df: DataFrame, table: str, mode: str):
    key = PARTITIONED_BY.get(table)
    balanced = df.hint("rebalance", key) if key else df.hint("rebalance")
    writer = balanced.write.mode(mode)
    return writer.partitionBy(key) if key else writer


def create_state(spark: SparkSession, root: str, tables: Iterable[str] = tuple(STATE)) -> None:
    """Create the tables that do not exist yet, empty."""
    for table in tables:
        schema, key = STATE[table], PARTITIONED_BY.get(table)
        if table == "rules":
            schema, key = RULE_SNAPSHOTS, "snapshot"
        # A query without rows, unlike an empty list, needs no Python worker to be written.
        empty = spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
        writer = empty.coalesce(1).write.mode("ignore")
        (writer.partitionBy(key) if key else writer).parquet(state_path(root, table))


def read_state(spark: SparkSession, root: str, table: str) -> DataFrame:
    if table == "rules":
        return _read_rules(spark, root)
    return spark.read.schema(STATE[table]).parquet(state_path(root, table)).select(*STATE[table].names)


def append(df: DataFrame, root: str, table: str) -> None:
    _writer(conform(df, table), table, "append").parquet(state_path(root, table))


def overwrite(
    df: DataFrame, root: str, table: str, keep_other_days: bool = True, replaced_from: date | None = None
) -> None:
    """Replace the table, or by default only the days that ``df`` has.

    With ``replaced_from``, ``df`` is all there is from that day on: stored days it lacks are removed.
    Tables without partitions are replaced as a whole. ``df`` must not read the table itself.
    """
    spark, dynamic = df.sparkSession, keep_other_days and table in PARTITIONED_BY
    before: set[date] = set()
    if dynamic and replaced_from is not None:
        df = df.where(F.col("d") >= F.lit(replaced_from)).persist()
        before = _days(read_state(spark, root, table).where(F.col("d") >= F.lit(replaced_from)))
        before -= _days(df)
    (
        _writer(conform(df, table), table, "overwrite")
        .option("partitionOverwriteMode", "dynamic" if dynamic else "static")
        .parquet(state_path(root, table))
    )
    for day in before:
        _remove(spark, f"{state_path(root, table)}/{PARTITIONED_BY[table]}={day.isoformat()}")
    df.unpersist()


def _days(df: DataFrame) -> set[date]:
    return {r.d for r in df.select("d").distinct().collect()}


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _read_rules(spark: SparkSession, root: str) -> DataFrame:
    """The newest snapshot. File names tell its number, so no other is read."""
    snapshots = spark.read.schema(RULE_SNAPSHOTS).parquet(state_path(root, "rules"))
    numbers = (re.search(r"/snapshot=([0-9]+)/", f) for f in snapshots.inputFiles())
    newest = max((int(n[1]) for n in numbers if n), default=0)
    return snapshots.where(F.col("snapshot") == F.lit(newest)).select(*RULES.names)


def write_rules(df: DataFrame, root: str, ts: datetime) -> None:
    """Add a snapshot of all rules. The one being read stays as it is."""
    number = int(ts.timestamp() * 1_000_000)
    conform(df, "rules").hint("rebalance").write.parquet(f"{state_path(root, 'rules')}/snapshot={number}")


def log_sync(
    spark: SparkSession, root: str, ts: datetime, payload_bytes: int, status: str, direction: str = "push_pull"
) -> None:
    """Add one row to the sync audit."""
    row = spark.createDataFrame([(ts.date(), ts, direction, payload_bytes, status)], SYNC_LOG)
    append(row, root, "sync_log")
