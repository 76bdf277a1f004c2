"""Query history, billing usage and rules derived from the test tables.

The test tables hold no query log, so every event becomes a statement, every order a usage record
and every supplier a rule. ``FIXTURES.md`` §3 has the mapping.
"""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import fingerprint
from tallyframe.params import Params
from tallyframe.schemas import BILLING_USAGE, QUERY_HISTORY

# Fixed values of the mapping.
AS_OF = date(2024, 3, 31)
FIRST_DAY = date(2024, 1, 1)
PARAMS = Params(AS_OF)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def midnight(day: int) -> datetime:
    return datetime(2024, 3, day, tzinfo=timezone.utc)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(x: Column) -> Column:
    return x.cast("string")


def history_from_events(events: DataFrame) -> DataFrame:
    """One statement per event over 90 days; every third event moves 30 or 60 days on."""
    event, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    base = events.withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn(
        "start_time", (F.col("ts") + F.make_dt_interval(days=(event % 3 * 30).cast("int"))).cast("timestamp")
    )
    k = F.col("k")
    route = F.when(k % 2 == 0, "warehouse").otherwise("cache_miss")
    tag = F.concat(F.lit("/* abx v=1 ck=x rule=r"), _s(k % 10), F.lit(" route="), route, F.lit(" */ "))
    prefix = F.when(user % 3 == 0, tag).when(user % 3 == 1, "  /* bi dash */ ").otherwise("")
    verb = F.when(user % 2 == 0, "SELECT").otherwise("select")
    # In the last third of the period some patterns vanish and some become rare.
    moved = (event % 3 == 2) & ((k % 10 == 7) | ((k % 10).isin(2, 5) & (event % 7 != 0)))
    text = F.concat(
        prefix,
        verb,
        F.lit("  a, b FROM "),
        kind,
        F.lit("_t"),
        F.when(moved, "z").otherwise(""),
        _s(k % 10),
        F.lit(" WHERE id = "),
        _s(event),
        F.lit(" AND s = 'u"),
        _s(user),
        F.lit("' -- k"),
        _s(k),
    )
    duration = F.when(k % 50 != 0, F.floor(F.col("value") * 1000))
    ended = F.unix_micros("start_time") + F.coalesce(duration, F.lit(0)) * 1000
    return base.select(
        F.concat(F.lit("s"), _s(event)).alias("statement_id"),
        F.concat(F.lit("u"), _s(user)).alias("executed_by"),
        F.when(user % 17 != 0, F.concat(F.lit("wh"), _s(user % 5))).alias("warehouse_id"),
        kind.alias("statement_type"),
        F.when(kind == "error", "FAILED").otherwise("FINISHED").alias("execution_status"),
        duration.alias("total_duration_ms"),
        (k * 1024).alias("read_bytes"),
        F.col("start_time"),
        F.timestamp_micros(ended).alias("end_time"),
        F.when(k != 99, text).alias("statement_text"),
    ).select(*QUERY_HISTORY.names)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_from_events(table(spark, sf_dir, "events"))


def tagged_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log once more, with statements on ever more tables and tags of all kinds.

    Every forty statements there is a new table, so fingerprints grow with the log. By statement number modulo six the
    tag is right, has another fingerprint, none, another version, a token without an equals sign, or is not there.
    """
    log = history(spark, sf_dir)
    number = F.substring("statement_id", 2, 20).cast("long")
    body = F.concat("statement_text", F.lit("\n JOIN u"), _s(F.floor(number / 40)), F.lit(" USING (a)"))
    ck = fingerprint(body)
    kind = number % 6

    def tag(*parts: Column | str) -> Column:
        return F.concat(F.lit("/* abx "), *(p if isinstance(p, Column) else F.lit(p) for p in parts), F.lit(" */ "))

    prefix = (
        F.when(kind == 0, tag("v=1 ck=", ck, " rule=r1 route=warehouse"))
        .when(kind == 1, tag("v=1 ck=q4tz route=bypass rule=r2"))
        .when(kind == 2, tag("v=1 route=smaller_wh"))
        .when(kind == 3, tag("v=2 ck=", ck, " route=cache_miss"))
        .when(kind == 4, tag("v=1 nightly ck=", ck))
        .otherwise("-- nothing\n")
    )
    return log.withColumn("statement_text", F.concat(prefix, body))


def billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One usage record per order, on day ``o_orderkey % 90``; ``wh5`` has cost but no statements."""
    orders = table(spark, sf_dir, "orders")
    day = F.date_add(F.lit(FIRST_DAY), (F.col("o_orderkey") % 90).cast("int"))
    return orders.select(
        day.alias("d"),
        F.concat(F.lit("SKU_"), F.substring("o_orderpriority", 1, 1)).alias("sku_name"),
        F.when(
            F.col("o_custkey") % 13 != 0, F.concat(F.lit("wh"), _s(F.col("o_custkey") % 6))
        ).alias("warehouse_id"),
        F.round(F.col("o_totalprice") / 1000, 3).cast("decimal(18,6)").alias("usage_quantity"),
        day.cast("timestamp").alias("usage_start_time"),
        F.date_add(day, 1).cast("timestamp").alias("usage_end_time"),
        F.lit("SQL").alias("billing_origin_product"),
    ).select(*BILLING_USAGE.names)


def _rule_type(key: Column) -> Column:
    return F.when(key % 3 == 0, "cache").when(key % 3 == 1, "bypass").otherwise("smaller_wh")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule with an even number per supplier; odd rule numbers in tags stay unmatched."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("r"), _s(key * 2)).alias("rule_id"),
        _rule_type(key).alias("rule_type"),
        F.col("s_name").alias("description"),
        F.concat(F.lit('{"nation":'), _s(F.col("s_nationkey")), F.lit("}")).alias("config_json"),
        F.lit("2024-03-01 00:00:00").cast("timestamp").alias("pulled_at"),
    )


def incoming_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions per rule number divisible by three, a customer each; the later key is newer."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("r"), _s(F.floor(key / 2) * 3)).alias("rule_id"),
        _rule_type(key).alias("rule_type"),
        F.col("c_name").alias("description"),
        F.concat(F.lit('{"nation":'), _s(F.col("c_nationkey")), F.lit("}")).alias("config_json"),
        (F.lit("2024-03-02 00:00:00").cast("timestamp") + F.make_dt_interval(secs=key)).alias("pulled_at"),
    )


def rule_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document with two rules per supplier; some rules lack a type or a description."""
    key = F.col("s_suppkey")

    def rule(number: Column, kind: Column, text: Column) -> Column:
        return F.struct(
            F.concat(F.lit("r"), _s(number)).alias("rule_id"),
            kind.alias("rule_type"),
            text.alias("description"),
            F.col("s_nationkey").alias("nation"),
        )

    pair = F.array(
        rule(key * 2, F.when(key % 3 != 2, _rule_type(key)), F.col("s_name")),
        rule(key * 2 + 1, _rule_type(key), F.when(key % 2 == 0, F.col("s_name"))),
    )
    return table(spark, sf_dir, "supplier").select(F.to_json(F.struct(pair.alias("rules"))).alias("value"))
