from collections import defaultdict

import data
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import cost
from tallyframe.operators.joins import spread_join
from tallyframe.params import Params

PRINTS, BILLING = data.prints_rows(), data.billing_rows()


@pytest.fixture(scope="module")
def tables(spark):
    return data.prints_df(spark, PRINTS).cache(), data.billing_df(spark, BILLING).cache()


def same(got, want):
    assert got.keys() == want.keys()
    for key, values in want.items():
        mine = got[key] if isinstance(values, tuple) else (got[key],)
        theirs = values if isinstance(values, tuple) else (values,)
        for a, b in zip(mine, theirs, strict=True):
            assert a == (b if b is None else pytest.approx(b, rel=1e-9, abs=1e-9)), key


def as_dict(rows):
    return {r.ck: (r.execs, r.attributed_usd) for r in rows}


@pytest.mark.parametrize("lookback", [7, 30, 60, 90])
def test_attribution_equals_statement_level_sum(tables, lookback):
    prints, billing = tables
    got = cost.attributed_cost(prints, billing, Params(data.AS_OF, lookback=lookback))
    same(as_dict(got.collect()), data.attributed(PRINTS, BILLING, lookback))


def test_attribution_of_a_closed_window(tables):
    prints, billing = tables
    got = cost.attributed_cost(prints, billing, data.P, data.day(60), data.day(31))
    same(as_dict(got.collect()), data.attributed(PRINTS, BILLING, 60, 31))


def test_cost_of_used_warehouse_days_is_fully_allocated(tables):
    prints, billing = tables
    allocated = cost.attributed_cost(prints, billing, data.P).agg(F.sum("attributed_usd")).first()[0]
    rate = cost.warehouse_rate(prints, billing, data.P).where("tot_ms > 0")
    assert allocated == pytest.approx(rate.agg(F.sum("wh_usd")).first()[0])


def test_ranking_is_ordered(tables):
    usd = [r.attributed_usd for r in cost.attributed_ranking(*tables, data.P).collect() if r.attributed_usd]
    assert usd == sorted(usd, reverse=True)


def test_waterfall_and_warehouse_cost_agree(tables):
    _, billing = tables
    waterfall = cost.waterfall_daily(billing, data.P)
    want = defaultdict(float)
    for d, sku, warehouse, q in BILLING:
        if d >= data.day(30) and warehouse is not None:
            want[d, sku, warehouse] += q / 1000
    same({(r.d, r.sku_name, r.warehouse_id): r.dbus for r in waterfall.collect()}, dict(want))
    total = waterfall.agg(F.sum("usd")).first()[0]
    assert total == pytest.approx(cost.warehouse_cost(billing, data.P).agg(F.sum("wh_usd")).first()[0])
    assert {r.layer for r in waterfall.select("layer").distinct().collect()} == {"raw"}


def test_warehouse_duration_keeps_the_null_group(tables):
    prints, _ = tables
    want = defaultdict(list)
    for row in PRINTS:
        if row[2] >= data.day(30):
            want[row[2], row[4]].append(row[5])
    want = {k: sum(x for x in v if x is not None) if any(x is not None for x in v) else None for k, v in want.items()}
    got = {(r.d, r.warehouse_id): r.tot_ms for r in cost.warehouse_duration(prints, data.P).collect()}
    assert got == want


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_plain_join(spark, how):
    left = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("k")
    )
    right = spark.createDataFrame([("hot", 1), ("4", 2), ("5", 3), (None, 4)], "k string, v int")
    got = spread_join(left, right, ["k"], F.col("id"), how)
    want = left.join(right, "k", how)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_spread_join_spreads_hot_and_null_keys(spark):
    """Without broadcasts, no reducer gets much more than its share."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = spark.range(32_000).select("id", F.when(F.col("id") % 2 == 0, F.lit("hot")).alias("k"))
        right = spark.createDataFrame([("hot", 1)], "k string, v int")
        out = spread_join(left, right, ["k"], F.col("id"), "left")
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 32_000
    assert max(sizes) < 32_000 / 2
