"""Files of the history in the order of their arrival."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.schemas import QUERY_HISTORY

# How long after its modification time a file may still turn up in the listing of its folder.
SETTLE = timedelta(hours=6)

# Bytes of a file that one task reads at most where each text is worked on; 16 MB are some 400,000 short statements.
TEXT_SPLIT = 16 << 20
_SPLIT = "spark.sql.files.maxPartitionBytes"


def listed_files(spark: SparkSession, path: str, after: datetime | None = None) -> DataFrame:
    """``path``, ``modified``, ``length`` of the Parquet files below ``path``, from the listing alone.

    Hidden files, such as those of a write that is not finished, are left out. ``after`` cuts the listing to files
    modified since then.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    if after is not None:
        moment = after.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
        reader = reader.option("modifiedAfter", moment).option("timeZone", "UTC")
    return reader.load(path).select("path", F.col("modificationTime").alias("modified"), "length")


def new_files(spark: SparkSession, path: str, seen: DataFrame, settle: timedelta = SETTLE) -> DataFrame:
    """The files below ``path`` that ``seen`` lacks; a file that was written again counts as new.

    Only files modified since ``settle`` before the newest one seen are compared, so the cost of a run does not grow
    with the age of the folder.
    """
    newest = seen.agg(F.unix_micros(F.max("modified"))).first()[0]
    after = None
    if newest is not None:
        after = datetime.fromtimestamp(newest / 1_000_000, timezone.utc) - settle
        seen = seen.where(F.col("modified") > F.lit(after))
    return listed_files(spark, path, after).join(seen, ["path", "modified", "length"], "left_anti")


@contextmanager
def short_splits(spark: SparkSession) -> Iterator[None]:
    """Scans that run within have splits of at most ``TEXT_SPLIT``.

    Texts are packed well and take long, so splits as for other scans make too few tasks to fill the cores evenly.
    """
    before = spark.conf.get(_SPLIT)
    size = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before))
    spark.conf.set(_SPLIT, str(min(size, TEXT_SPLIT)))
    try:
        yield
    finally:
        spark.conf.set(_SPLIT, before)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The history in the given files. Their names are all that the driver holds, as for any scan."""
    return spark.read.schema(QUERY_HISTORY).parquet(*paths)
