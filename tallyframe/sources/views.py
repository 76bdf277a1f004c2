"""The two source relations as views."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import utc_midnight
from tallyframe.params import Params
from tallyframe.schemas import BILLING_USAGE, QUERY_HISTORY

# Fixed value: days of history the view exposes.
HISTORY_DAYS = 90


def query_history(raw: DataFrame, params: Params, days: int = HISTORY_DAYS) -> DataFrame:
    """The ten history columns of the statements started in the last ``days`` days.

    The bound is a literal, so it reaches the scan as a pushed filter.
    """
    since = utc_midnight(params.as_of - timedelta(days=days))
    return raw.select(*QUERY_HISTORY.names).where(F.col("start_time") >= since)


def query_history_self(history: DataFrame, user: str | Column | None = None) -> DataFrame:
    """The rows of one user, by default of the session's user."""
    who = F.current_user() if user is None else user if isinstance(user, Column) else F.lit(user)
    return history.where(F.col("executed_by") == who)


def billing_usage(raw: DataFrame, params: Params) -> DataFrame:
    """Usage records of the lookback window that name a warehouse."""
    return raw.select(*BILLING_USAGE.names).where(
        (F.col("d") >= params.since) & F.col("warehouse_id").isNotNull()
    )


def register_views(history: DataFrame, billing: DataFrame, user: str | None = None) -> None:
    """Temporary views under the names report SQL uses."""
    history.createOrReplaceTempView("query_history_v")
    query_history_self(history, user).createOrReplaceTempView("query_history_self_v")
    billing.createOrReplaceTempView("billing_usage_v")
