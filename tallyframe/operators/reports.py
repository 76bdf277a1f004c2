"""The report screens as typed DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.cost import executions
from tallyframe.operators.joins import spread_join
from tallyframe.operators.predicates import last_days
from tallyframe.params import Params
from tallyframe.schemas import ROUTES

# Rows of the redundancy screen, percent of untagged statements that raises the alert.
TOP_ROWS = 50
UNTAGGED_ALERT_PCT = 10


def coverage_trend(coverage: DataFrame, params: Params) -> DataFrame:
    return (
        last_days(coverage, params, params.lookback)
        .select("d", "gateway_routed", "total", F.round(F.col("coverage_ratio") * 100, 1).alias("coverage_pct"))
        .orderBy("d")
    )


def coverage_kpis(trend: DataFrame) -> DataFrame:
    """Plain mean of the rounded daily percentages, statement totals, untagged share and alert."""
    return (
        trend.agg(
            F.avg("coverage_pct").alias("avg_coverage_pct"),
            F.sum("total").alias("total_statements"),
            F.sum("gateway_routed").alias("gateway_routed"),
        )
        .withColumn("untagged_pct", 100 - F.col("avg_coverage_pct"))
        .withColumn("alert", F.col("untagged_pct") > UNTAGGED_ALERT_PCT)
    )


def redundancy_table(prints: DataFrame, params: Params) -> DataFrame:
    """Fingerprints executed more than once in the lookback window.

    Counts are rolled up per (ck, rule) first: a maximum over strings has no hash aggregation, so it
    only sees one row per rule. Seconds are a decimal sum, rounded half up.
    """
    per_rule = (
        last_days(executions(prints), params, params.lookback)
        .groupBy("ck", "rule_id")
        .agg(
            F.sum("n").alias("n"),
            F.sum("ms").alias("ms"),
            F.min("d").alias("lo"),
            F.max("d").alias("hi"),
        )
    )
    return (
        per_rule.groupBy("ck")
        .agg(
            F.sum("n").alias("execs"),
            F.round(F.sum("ms") / F.lit("1000.0").cast("decimal(5,1)"), 1).alias("total_sec"),
            F.min("lo").alias("first_seen"),
            F.max("hi").alias("last_seen"),
            F.coalesce(F.max("rule_id"), F.lit("unmatched")).alias("rule_id"),
        )
        .where(F.col("execs") > 1)
    )


def redundant_top(prints: DataFrame, params: Params, rows: int = TOP_ROWS) -> DataFrame:
    """The most repeated fingerprints; ties are ordered by fingerprint."""
    return redundancy_table(prints, params).orderBy(F.desc("execs"), "ck").limit(rows)


def redundant_count(table: DataFrame, rows: int = TOP_ROWS) -> DataFrame:
    """How many fingerprints are redundant, and how many of them the screen shows."""
    counted = table.agg(F.count("*").alias("redundant_fingerprints"))
    return counted.withColumn("rows_shown", F.least("redundant_fingerprints", F.lit(rows).cast("long")))


def spend_by_sku(waterfall: DataFrame, params: Params) -> DataFrame:
    return (
        last_days(waterfall, params, params.lookback)
        .groupBy("d", "sku_name", "layer")
        .agg(F.sum("usd").alias("usd"))
        .orderBy("d", "sku_name", "layer")
    )


def savings_kpis(waterfall: DataFrame, effectiveness: DataFrame, params: Params) -> DataFrame:
    """Raw spend of the lookback window, realized savings of the whole table, and their ratio.

    The ratio is NULL if either is zero.
    """
    spend = (
        last_days(waterfall, params, params.lookback)
        .where(F.col("layer") == "raw")
        .agg(F.coalesce(F.sum("usd"), F.lit(0.0)).alias("total_usd"))
    )
    saved = effectiveness.agg(F.coalesce(F.sum("realized_usd"), F.lit(0.0)))
    rate = F.nullif(F.col("realized_usd"), F.lit(0.0)) / F.nullif(F.col("total_usd"), F.lit(0.0)) * 100
    return spend.withColumn("realized_usd", saved.scalar()).withColumn("savings_rate_pct", rate)


def rule_attribution(effectiveness: DataFrame, rules: DataFrame) -> DataFrame:
    """Effectiveness with rule descriptions, largest savings first; unmatched rules are kept.

    Most savings are zero; fingerprint and rule order these, so the sort can split them.
    """
    described = spread_join(
        effectiveness, rules.select("rule_id", "description"), ["rule_id"], F.col("ck"), "left"
    )
    in_order = described.withColumn("realized_usd", F.round("realized_usd", 2)).orderBy(
        F.desc_nulls_last("realized_usd"), "ck", "rule_id"
    )
    return in_order.select(
        "rule_id",
        "description",
        "window",
        "baseline_rate",
        "observed",
        "avoided",
        "realized_usd",
        *[c for c in ("updated_at",) if c in effectiveness.columns],
    )


def route_mix(prints: DataFrame, params: Params) -> DataFrame:
    """Statements per day and route; ``untagged`` has those without one."""
    counts = [F.count_if(F.col("route") == r).alias(r) for r in ROUTES]
    return (
        last_days(prints, params, params.lookback)
        .groupBy("d")
        .agg(*counts, F.count_if(F.col("route").isNull()).alias("untagged"))
    )
