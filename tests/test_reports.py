from collections import defaultdict
from datetime import date, datetime, timedelta

import data
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import coverage, reports
from tallyframe.params import Params
from tallyframe.schemas import QUERY_HISTORY, RULES
from tallyframe.sources import views

PRINTS = data.prints_rows(seed=9)


def history_row(i, start, text="SELECT 1", status="FINISHED", user="u1"):
    return (f"s{i}", user, "wh0", "SELECT", status, 5, 1, start, start, text)


@pytest.fixture(scope="module")
def prints(spark):
    return data.prints_df(spark, PRINTS).cache()


def test_redundancy(prints):
    want = defaultdict(list)
    for row in PRINTS:
        if row[2] >= data.day(30):
            want[row[0]].append(row)
    rows = reports.redundancy_table(prints, data.P).collect()
    assert {r.ck for r in rows} == {ck for ck, group in want.items() if len(group) > 1}
    for r in rows:
        group = want[r.ck]
        rules = [g[7] for g in group if g[7] is not None]
        ms = [g[5] for g in group if g[5] is not None]
        assert r.execs == len(group)
        assert (r.first_seen, r.last_seen) == (min(g[2] for g in group), max(g[2] for g in group))
        assert r.rule_id == (max(rules) if rules else "unmatched")
        assert abs(float(r.total_sec) * 1000 - sum(ms)) <= 50


def test_top_is_ordered_and_counted(prints):
    rows = reports.redundant_top(prints, data.P, rows=5).collect()
    assert [(-r.execs, r.ck) for r in rows] == sorted((-r.execs, r.ck) for r in rows)
    assert rows[0].ck == "hot" and len(rows) == 5
    table = reports.redundancy_table(prints, data.P)
    assert reports.redundant_count(table, rows=5).first()[:] == (table.count(), 5)


def test_lookback_is_a_parameter(prints):
    week = reports.redundancy_table(prints, Params(data.AS_OF, lookback=7)).agg(F.sum("execs")).first()[0]
    quarter = reports.redundancy_table(prints, Params(data.AS_OF, lookback=90)).agg(F.sum("execs")).first()[0]
    assert week < quarter == len(PRINTS)


def test_seconds_round_half_up(spark):
    start = datetime(2024, 3, 30)
    rows = [("c", f"s{i}", start.date(), start, None, ms, None, None, start) for i, ms in enumerate([200, 50])]
    assert str(reports.redundancy_table(data.prints_df(spark, rows), data.P).first().total_sec) == "0.3"


def test_coverage(spark):
    start = datetime(2024, 3, 1, 0, 0, 0)
    rows = [
        history_row(0, start, "/* abx v=1 */ SELECT 1"),
        history_row(1, start, "SELECT 1", status="FAILED"),
        history_row(2, start, None),
        history_row(3, start - timedelta(microseconds=1), "/* abx v=1 */"),
        history_row(4, datetime(2024, 3, 31, 23, 59), "/* abx "),
    ]
    df = coverage.coverage_daily(spark.createDataFrame(rows, QUERY_HISTORY), data.P)
    got = {r.d: (r.gateway_routed, r.total, r.coverage_ratio) for r in df.collect()}
    assert got == {date(2024, 3, 1): (1, 3, 0.3333333333333333), date(2024, 3, 31): (1, 1, 1.0)}
    trend = reports.coverage_trend(df, data.P)
    assert [(r.d.day, r.coverage_pct) for r in trend.collect()] == [(1, 33.3), (31, 100.0)]
    kpis = reports.coverage_kpis(trend).first()
    assert (kpis.total_statements, kpis.gateway_routed, kpis.alert) == (4, 2, True)
    assert kpis.avg_coverage_pct == pytest.approx(66.65) and kpis.untagged_pct == pytest.approx(33.35)


def test_alert_needs_more_than_ten_percent(spark):
    rows = [(date(2024, 3, 30), 90, 100, 90.0)]
    trend = spark.createDataFrame(rows, "d date, gateway_routed long, total long, coverage_pct double")
    assert reports.coverage_kpis(trend).first().alert is False


def test_savings_kpis(spark):
    waterfall = spark.createDataFrame(
        [
            (date(2024, 3, 30), "a", 60.0, "raw"),
            (date(2024, 3, 1), "b", 40.0, "raw"),
            (date(2024, 2, 1), "a", 999.0, "raw"),
            (date(2024, 3, 30), "a", 7.0, "realized_saving"),
        ],
        "d date, sku_name string, usd double, layer string",
    )
    saved = spark.createDataFrame([(20.0,), (5.0,)], "realized_usd double")
    row = reports.savings_kpis(waterfall, saved, data.P).first()
    assert (row.total_usd, row.realized_usd, row.savings_rate_pct) == (100.0, 25.0, 25.0)
    for no_spend, no_saving in [(True, False), (False, True)]:
        row = reports.savings_kpis(
            waterfall.where(F.lit(not no_spend)), saved.where(F.lit(not no_saving)), data.P
        ).first()
        assert row.savings_rate_pct is None
    spend = reports.spend_by_sku(waterfall, data.P).collect()
    assert [(r.d.day, r.sku_name, r.usd, r.layer) for r in spend] == [
        (1, "b", 40.0, "raw"),
        (30, "a", 60.0, "raw"),
        (30, "a", 7.0, "realized_saving"),
    ]


def test_rule_attribution_keeps_unmatched_rules(spark):
    effect = spark.createDataFrame(
        [("c1", "r1", "w", 1.0, 2, 3, 1.005), ("c2", None, "w", 1.0, 2, 3, None), ("c3", "rX", "w", 1.0, 2, 3, 9.126)],
        "ck string, rule_id string, window string, baseline_rate double, observed long, avoided long, realized_usd double",
    )
    now = datetime(2024, 3, 1)
    rules = spark.createDataFrame([("r1", "cache", "one", "{}", now)], RULES)
    rows = reports.rule_attribution(effect, rules).collect()
    assert [(r.rule_id, r.description, r.realized_usd) for r in rows] == [
        ("rX", None, 9.13),
        ("r1", "one", 1.01),
        (None, None, None),
    ]
    stamped = reports.rule_attribution(effect.withColumn("updated_at", F.lit(now)), rules)
    assert stamped.columns[-1] == "updated_at"


def test_route_mix(prints):
    rows = reports.route_mix(prints, data.P).collect()
    total = sum(r.warehouse + r.cache_miss + r.smaller_wh + r.bypass + r.untagged for r in rows)
    assert total == sum(row[2] >= data.day(30) for row in PRINTS)


def test_views(spark):
    rows = [
        history_row(0, datetime(2024, 1, 1), user="u1"),
        history_row(1, datetime(2023, 12, 31, 23, 59, 59), user="u1"),
        history_row(2, datetime(2024, 3, 31), user="u2"),
        history_row(3, None, user="u2"),
    ]
    raw = spark.createDataFrame(rows, QUERY_HISTORY).withColumn("extra", F.lit(1))
    history = views.query_history(raw, data.P)
    assert history.columns == QUERY_HISTORY.names
    assert {r.statement_id for r in history.collect()} == {"s0", "s2"}
    assert {r.statement_id for r in views.query_history_self(history, "u2").collect()} == {"s2"}
    me = spark.sql("SELECT current_user()").first()[0]
    mine = spark.createDataFrame([history_row(9, datetime(2024, 3, 1), user=me)], QUERY_HISTORY)
    assert views.query_history_self(history.unionByName(mine)).count() == 1
    billing = data.billing_df(spark, data.billing_rows())
    assert views.billing_usage(billing, data.P).where("warehouse_id IS NULL OR d < '2024-03-01'").count() == 0
    views.register_views(history, billing, "u1")
    assert spark.sql("SELECT statement_id FROM query_history_self_v").first()[0] == "s0"
