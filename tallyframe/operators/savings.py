"""Baseline against current window: avoided executions and realized savings."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.apportion import apportion
from tallyframe.operators.cost import attributed_cost, current_costs, executions, warehouse_cost, waterfall_daily
from tallyframe.operators.predicates import between_days, last_days
from tallyframe.params import BASELINE_DAYS, BASELINE_FROM, BASELINE_TO, CURRENT_FROM, Params

# Savings are shared out over days in units of so many USD.
UNIT = 0.0001


def _baseline_counts(prints: DataFrame, params: Params) -> DataFrame:
    return (
        between_days(executions(prints), params, BASELINE_FROM, BASELINE_TO)
        .groupBy("ck", "rule_id")
        .agg(F.sum("n").alias("n"))
    )


def _rate(n: Column) -> Column:
    """Executions per day as decimal(27,6): rounded to six decimals."""
    return n / F.lit(Decimal(f"{BASELINE_DAYS}.0"))


def baseline_rate(prints: DataFrame, params: Params) -> DataFrame:
    """Executions per day in the baseline window, per fingerprint and rule; no rule is a group."""
    return _baseline_counts(prints, params).select("ck", "rule_id", _rate(F.col("n")).alias("baseline_rate"))


def observed_execs(prints: DataFrame, params: Params) -> DataFrame:
    return (
        last_days(executions(prints), params, CURRENT_FROM).groupBy("ck").agg(F.sum("n").alias("observed"))
    )


def _expected(params: Params) -> Column:
    """Executions the baseline predicts for the current window.

    The rounded daily rate makes ``avoided`` one too small for some counts; ``exact_counts`` takes
    the baseline count itself.
    """
    if params.exact_counts:
        return F.col("n").cast("decimal(31,6)")
    return _rate(F.col("n")) * F.lit(BASELINE_DAYS)


def rule_effectiveness(prints: DataFrame, billing: DataFrame, params: Params) -> DataFrame:
    """Per fingerprint and baseline rule: rate, observed, avoided executions and realized USD.

    Every rule of a fingerprint is held against all its current executions. Fingerprints without
    current executions drop out here; :func:`fully_avoided` has them.
    """
    return _effectiveness(prints, current_costs(prints, billing, params), params)


def _effectiveness(prints: DataFrame, costs: DataFrame, params: Params) -> DataFrame:
    current = costs.where(F.col("observed").isNotNull())
    gap = _expected(params) - F.col("observed")
    per_exec = F.coalesce(F.col("attributed_usd") / F.nullif(F.col("execs"), F.lit(0)), F.lit(0.0))
    return (
        _baseline_counts(prints, params)
        .join(current, "ck")
        .select(
            "ck",
            "rule_id",
            F.lit(params.window).alias("window"),
            _rate(F.col("n")).alias("baseline_rate"),
            "observed",
            F.greatest(F.lit(0).cast("long"), gap.cast("long")).alias("avoided"),
            (F.greatest(F.lit(Decimal("0.0")), gap) * per_exec).alias("realized_usd"),
        )
    )


def fully_avoided(prints: DataFrame, billing: DataFrame, params: Params) -> DataFrame:
    """Fingerprints of the baseline that are not seen at all in the current window.

    Their executions are priced by the average attributed cost of the baseline window.
    """
    lo, hi = params.ago(BASELINE_FROM), params.ago(BASELINE_TO)
    priced = attributed_cost(prints, billing, params, lo, hi)
    gone = _baseline_counts(prints, params).join(observed_execs(prints, params), "ck", "left_anti")
    per_exec = F.coalesce(F.col("attributed_usd") / F.nullif(F.col("execs"), F.lit(0)), F.lit(0.0))
    return gone.join(priced, "ck", "left").select(
        "ck",
        "rule_id",
        F.lit(params.window).alias("window"),
        _rate(F.col("n")).alias("baseline_rate"),
        F.col("n").alias("avoided"),
        (F.col("n") * per_exec).alias("realized_usd"),
    )


def _layer_totals(prints: DataFrame, billing: DataFrame, params: Params) -> list[tuple[str, DataFrame]]:
    """The layers and their totals over the lookback window, each a frame of one ``usd``."""
    raw = warehouse_cost(billing, params).agg(F.sum("wh_usd").alias("usd"))
    repeats = F.col("attributed_usd") * (F.col("execs") - 1) / F.col("execs")
    # Both savings layers read the same costs, whose shuffles are then shared.
    costs = current_costs(prints, billing, params)
    projected = costs.agg(F.sum(repeats).alias("usd"))
    realized = _effectiveness(prints, costs, params).agg(F.sum("realized_usd").alias("usd"))
    return [("raw", raw), ("projected_saving", projected), ("realized_saving", realized)]


def savings_layers(prints: DataFrame, billing: DataFrame, params: Params) -> DataFrame:
    """USD per waterfall layer over the lookback window.

    ``realized_saving`` is the table-wide sum of realized USD. The reported tables define no formula
    for ``projected_saving``; here it is the cost of the repeat executions, all but one per
    fingerprint.
    """
    out = None
    for name, df in _layer_totals(prints, billing, params):
        row = df.select(F.lit(name).alias("layer"), F.coalesce("usd", F.lit(0.0)).alias("usd"))
        out = row if out is None else out.unionByName(row)
    return out


def saving_waterfall(prints: DataFrame, billing: DataFrame, params: Params) -> DataFrame:
    """The saving layers as rows of the waterfall: each total of :func:`savings_layers` per day and SKU.

    A total, in units of ``UNIT`` USD, is apportioned to the days of the lookback window by their usage and then,
    within a day, to its SKUs; so the rows of a layer add up to its total. They name no warehouse and no units.
    """
    micros = F.greatest(F.sum("usage_quantity"), F.lit(0)) * 1_000_000
    usage = (
        billing.where((F.col("d") >= params.since) & F.col("warehouse_id").isNotNull())
        .groupBy("d", "sku_name")
        .agg(micros.cast("decimal(19,0)").alias("weight"))
    )
    totals = dict(_layer_totals(prints, billing, params))
    layers = [
        F.struct(
            F.lit(name).alias("layer"),
            F.greatest(F.round(F.coalesce(totals[name].scalar(), F.lit(0.0)) / UNIT, 0), F.lit(0.0))
            .cast("decimal(19,0)")
            .alias("total"),
        )
        for name in ("projected_saving", "realized_saving")
    ]
    daily = usage.groupBy("d").agg(F.sum("weight").cast("decimal(19,0)").alias("weight"))
    daily = daily.withColumn("layers", F.array(*layers)).select("d", "weight", F.inline("layers"))
    days = apportion(daily, ["layer"], ["d"]).select("d", "layer", F.col("units").cast("decimal(19,0)").alias("total"))
    shares = apportion(usage.join(days, "d"), ["layer", "d"], ["sku_name"])
    return shares.select(
        "d",
        "sku_name",
        F.lit(None).cast("string").alias("warehouse_id"),
        F.lit(None).cast("double").alias("dbus"),
        (F.col("units") * UNIT).alias("usd"),
        "layer",
    )


def full_waterfall(prints: DataFrame, billing: DataFrame, params: Params) -> DataFrame:
    """The raw layer and the saving layers: all rows of the waterfall table."""
    return waterfall_daily(billing, params).unionByName(saving_waterfall(prints, billing, params))
