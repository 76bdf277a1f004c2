"""Share of the statements that came through the gateway."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import is_gateway_routed, utc_day, utc_midnight
from tallyframe.operators.predicates import of_days
from tallyframe.params import Params


def coverage_counts() -> list[Column]:
    return [
        F.count_if(is_gateway_routed(F.col("statement_text"))).alias("gateway_routed"),
        F.count("*").alias("total"),
    ]


def coverage_ratio() -> Column:
    """Decimal division first, as the ratio is rounded to 16 digits before it becomes a double."""
    exact = F.col("gateway_routed") * F.lit("1.0").cast("decimal(2,1)") / F.col("total")
    return exact.cast("double").alias("coverage_ratio")


def coverage_daily(history: DataFrame, params: Params, days: list[date] | None = None) -> DataFrame:
    """Routed and total statements per day; statements of every status count. ``days`` picks some of the lookback."""
    seen = history.where(F.col("start_time") >= utc_midnight(params.ago(params.lookback)))
    if days is not None:
        seen = of_days(seen, days)
    return (
        seen.groupBy(utc_day("start_time").alias("d"))
        .agg(*coverage_counts())
        .select("d", "gateway_routed", "total", coverage_ratio())
    )
