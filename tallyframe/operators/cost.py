"""Priced usage and its attribution to fingerprints by duration share."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.joins import spread_join
from tallyframe.params import CURRENT_FROM, Params

_DAY = ["d", "warehouse_id"]


def executions(prints: DataFrame) -> DataFrame:
    """Rows with a number of executions ``n`` and their milliseconds ``ms``.

    Statements count as one each; a roll-up has both columns and is taken as it is. All that counts executions
    works on either.
    """
    if {"n", "ms"} <= set(prints.columns):
        return prints
    return prints.withColumns({"n": F.lit(1).cast("long"), "ms": F.col("total_duration_ms")})


def _usage() -> Column:
    return F.sum(F.col("usage_quantity").cast("double"))


def _within(df: DataFrame, lo: date, hi: date | None) -> DataFrame:
    df = df.where(F.col("d") >= F.lit(lo))
    return df if hi is None else df.where(F.col("d") <= F.lit(hi))


def daily_usage(billing: DataFrame, params: Params) -> DataFrame:
    """The usage records of the lookback window, added up per day, SKU and warehouse.

    The reports of that window need no more of the records than this; the sums of decimals are exact, so they are the same.
    """
    return (
        billing.where((F.col("d") >= params.since) & F.col("warehouse_id").isNotNull())
        .groupBy("d", "sku_name", "warehouse_id")
        .agg(F.sum("usage_quantity").alias("usage_quantity"))
    )


def waterfall_daily(billing: DataFrame, params: Params) -> DataFrame:
    """Units and USD per day, SKU and warehouse."""
    return (
        billing.where((F.col("d") >= params.since) & F.col("warehouse_id").isNotNull())
        .groupBy("d", "sku_name", "warehouse_id")
        .agg(_usage().alias("dbus"))
        .withColumn("usd", F.col("dbus") * params.rate)
        .withColumn("layer", F.lit("raw"))
    )


def warehouse_cost(
    billing: DataFrame, params: Params, lo: date | None = None, hi: date | None = None
) -> DataFrame:
    """USD per warehouse-day, over all SKUs."""
    return (
        _within(billing, lo or params.ago(params.lookback), hi)
        .where(F.col("warehouse_id").isNotNull())
        .groupBy(*_DAY)
        .agg((_usage() * params.rate).alias("wh_usd"))
    )


def warehouse_duration(
    prints: DataFrame, params: Params, lo: date | None = None, hi: date | None = None
) -> DataFrame:
    """Milliseconds per warehouse-day; a NULL warehouse is a group of its own."""
    return (
        _within(executions(prints), lo or params.ago(params.lookback), hi)
        .groupBy(*_DAY)
        .agg(F.sum("ms").alias("tot_ms"))
    )


def warehouse_rate(
    prints: DataFrame, billing: DataFrame, params: Params, lo: date | None = None, hi: date | None = None
) -> DataFrame:
    """Cost and duration of the warehouse-days that have both, one row each."""
    cost = warehouse_cost(billing, params, lo, hi)
    # Only the narrow duration columns are read here, never the text.
    duration = warehouse_duration(prints, params, lo, hi)
    return cost.join(duration, _DAY)


def _priced_units(
    prints: DataFrame, rate: DataFrame, params: Params, lo: date, hi: date | None, how: str
) -> DataFrame:
    """Statements rolled up to (ck, day, warehouse), with their share of the warehouse-day cost.

    The share is linear in the duration, so rolling up before the join gives the per-statement sum
    while the join sees one row per fingerprint and warehouse-day instead of one per statement.
    """
    units = (
        _within(executions(prints), lo, hi)
        .groupBy("ck", *_DAY)
        .agg(F.sum("n").alias("n"), F.sum("ms").alias("ms"))
    )
    share = F.col("ms") / F.nullif(F.col("tot_ms"), F.lit(0))
    return spread_join(units, rate, _DAY, F.col("ck"), how).withColumn("usd", F.col("wh_usd") * share)


def attributed_cost(
    prints: DataFrame, billing: DataFrame, params: Params, lo: date | None = None, hi: date | None = None
) -> DataFrame:
    """Executions and attributed USD per fingerprint, over warehouse-days with cost and statements.

    ``execs`` counts statements without a duration as well; they get no cost.
    """
    lo = lo or params.ago(params.lookback)
    rate = warehouse_rate(prints, billing, params, lo, hi)
    return (
        _priced_units(prints, rate, params, lo, hi, "inner")
        .groupBy("ck")
        .agg(F.sum("n").alias("execs"), F.sum("usd").alias("attributed_usd"))
    )


def attributed_ranking(prints: DataFrame, billing: DataFrame, params: Params) -> DataFrame:
    """:func:`attributed_cost`, dearest first."""
    return attributed_cost(prints, billing, params).orderBy(F.desc("attributed_usd"), "ck")


def current_costs(prints: DataFrame, billing: DataFrame, params: Params) -> DataFrame:
    """Per fingerprint: executions observed now, and execs / attributed_usd of the lookback window.

    One pass over the statements serves both. The two windows differ only if the lookback is not 30;
    a fingerprint of one window alone has NULL in the columns of the other.
    """
    lo = params.ago(max(params.lookback, CURRENT_FROM))
    rate = warehouse_rate(prints, billing, params)
    matched = F.col("wh_usd").isNotNull()
    return (
        _priced_units(prints, rate, params, lo, None, "left")
        .groupBy("ck")
        .agg(
            F.sum(F.when(F.col("d") >= params.day(CURRENT_FROM), F.col("n"))).alias("observed"),
            F.sum(F.when(matched, F.col("n"))).alias("execs"),
            F.sum("usd").alias("attributed_usd"),
        )
    )
