"""Row filters shared by the operators."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import utc_day, utc_midnight
from tallyframe.params import Params


def finished(history: DataFrame) -> DataFrame:
    return history.where(F.col("execution_status") == "FINISHED")


def since(history: DataFrame, position: datetime | Column) -> DataFrame:
    """Statements started strictly after the position."""
    bound = position if isinstance(position, Column) else F.lit(position)
    return history.where(F.col("start_time") > bound.cast("timestamp"))


def of_days(history: DataFrame, days: list[date]) -> DataFrame:
    """The statements of these days; the range of the days reaches the scan."""
    if not days:
        return history.limit(0)
    start = F.col("start_time")
    span = (start >= utc_midnight(min(days))) & (start < utc_midnight(max(days) + timedelta(days=1)))
    return history.where(span & utc_day("start_time").isin(*days))


def last_days(df: DataFrame, params: Params, days: int) -> DataFrame:
    """Rows from day ``-days`` on. Both ends count, so 30 days span 31 dates; no upper bound."""
    return df.where(F.col("d") >= params.day(days))


def between_days(df: DataFrame, params: Params, oldest: int, newest: int) -> DataFrame:
    """Rows from day ``-oldest`` to day ``-newest``, both included."""
    return df.where(F.col("d").between(params.day(oldest), params.day(newest)))


def latest_window(effectiveness: DataFrame) -> DataFrame:
    """Rows of the newest comparison window; ISO labels sort by date as strings."""
    return effectiveness.where(F.col("window") == effectiveness.agg(F.max("window")).scalar())
