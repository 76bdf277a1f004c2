"""The roll-up of executions as a bucketed table.

Buckets by fingerprint let reports group and join by it without an exchange; partitions by day let a run replace
just the days that changed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.schemas import EXECUTIONS_DAILY
from tallyframe.sources.state import state_path

# Near the number of cores that read the table.
BUCKETS = 8
_OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def rollup_table(spark: SparkSession, root: str, buckets: int = BUCKETS) -> str:
    """The name of the roll-up below ``root`` in the session's catalog, which is told of it if need be.

    The number of buckets is part of the folder's name, as files of different numbers can't be mixed.
    """
    path = state_path(root, f"executions_daily_{buckets}")
    name = f"executions_daily_{hashlib.sha256(path.encode()).hexdigest()[:16]}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EXECUTIONS_DAILY)
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (d) "
            f"CLUSTERED BY (ck) SORTED BY (ck) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
        if _exists(spark, path):
            spark.sql(f"MSCK REPAIR TABLE {name}")
    return name


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_rollup(spark: SparkSession, root: str, buckets: int = BUCKETS) -> DataFrame:
    return spark.table(rollup_table(spark, root, buckets))


def rolled_up(prints: DataFrame) -> DataFrame:
    """Executions and milliseconds per day, fingerprint, rule and warehouse."""
    return (
        prints.groupBy("ck", "rule_id", "warehouse_id", "d")
        .agg(F.count("*").alias("n"), F.sum("total_duration_ms").alias("ms"))
        .select(*EXECUTIONS_DAILY.names)
    )


def refresh_rollup(
    spark: SparkSession, root: str, prints: DataFrame, days: Iterable[date] | None = None, buckets: int = BUCKETS
) -> None:
    """Roll the ``days`` (by default all) of ``prints`` up again and put them in the place of the stored ones.

    Doing it twice changes nothing. Only the partitions of these days are read and written.
    """
    name = rollup_table(spark, root, buckets)
    if days is not None:
        days = sorted(days)
        if not days:
            return
        prints = prints.where(F.col("d").isin(*days))
    before = spark.conf.get(_OVERWRITE)
    # An insert takes the mode from the session only.
    spark.conf.set(_OVERWRITE, "dynamic")
    try:
        rolled_up(prints).repartition(buckets, "ck").write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(_OVERWRITE, before)


def rollup_gaps(rollup: DataFrame, prints: DataFrame) -> DataFrame:
    """Days on which the roll-up does not count the stored statements: ``d``, ``stored``, ``rolled_up``.

    From row counts alone; no column of the statements is read.
    """
    stored = prints.groupBy("d").agg(F.count("*").alias("stored"))
    counted = rollup.groupBy("d").agg(F.sum("n").alias("rolled_up"))
    both = stored.join(counted, "d", "full")
    return both.where("NOT (stored <=> rolled_up)")
