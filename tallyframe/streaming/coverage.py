from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyframe.functions import utc_day
from tallyframe.operators.coverage import coverage_counts, coverage_ratio
from tallyframe.sources.state import overwrite


def coverage_stream(history: DataFrame) -> DataFrame:
    """Coverage per UTC day, brought up to date by every batch.

    State is one counter pair per day and never expires, so a statement counts however late it arrives.
    """
    return (
        history.where("start_time IS NOT NULL")
        .groupBy(utc_day("start_time").alias("d"))
        .agg(*coverage_counts())
        .select("d", "gateway_routed", "total", coverage_ratio())
    )


def start_coverage(history: DataFrame, root: str, checkpoint_dir: str) -> StreamingQuery:
    """Keep ``coverage_daily`` up to date: a batch rewrites the days it changed.

    An update carries the whole count of a day, so a batch that is repeated after a failure writes
    the same rows again.
    """

    def replace_days(batch: DataFrame, _: int) -> None:
        overwrite(batch.withColumn("updated_at", F.current_timestamp()), root, "coverage_daily")

    return (
        coverage_stream(history)
        .writeStream.foreachBatch(replace_days)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
