"""Largest remainder against an independent integer computation, and the saving layers built on it."""

import random
from collections import defaultdict

import data
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import cost, reports, savings
from tallyframe.operators.apportion import apportion


def brute(rows):
    """{(group, key): units} for rows (group, key, weight, total), unit by unit."""
    groups = defaultdict(list)
    for group, key, weight, total in rows:
        groups[group].append((key, weight, total))
    out = {}
    for group, members in groups.items():
        whole, total = sum(w for _, w, _ in members), members[0][2]
        if not whole:
            continue
        for key, weight, _ in members:
            out[group, key] = total * weight // whole
        by_rest = sorted(members, key=lambda m: (-(total * m[1] % whole), m[0]))
        for key, _, _ in by_rest[: total - sum(out[group, m[0]] for m in members)]:
            out[group, key] += 1
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, k int, w long, t long").select(
        "g", "k", F.col("w").cast("decimal(19,0)").alias("weight"), F.col("t").cast("decimal(19,0)").alias("total")
    )


def result(df):
    return {(r.g, r.k): r.units for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_against_unit_by_unit(spark, seed):
    rng = random.Random(seed)
    rows = []
    for g in "abcdef":
        total = rng.choice([0, 1, 2, 7, 1000, 10**12])
        for k in range(rng.randint(1, 40)):
            rows.append((g, k, rng.choice([0, 1, 1, 3, 10**6, 10**15]), total))
    got = result(apportion(frame(spark, rows).repartition(5), ["g"], ["k"]))
    assert got == brute(rows)
    for g in {r[0] for r in rows if any(x[2] for x in rows if x[0] == r[0])}:
        assert sum(v for (group, _), v in got.items() if group == g) == next(r[3] for r in rows if r[0] == g)


def test_ties_go_to_the_first_and_empty_groups_get_nothing(spark):
    rows = [("a", k, 1, 2) for k in range(3)] + [("b", 0, 0, 5)]
    assert result(apportion(frame(spark, rows), ["g"], ["k"])) == {("a", 0): 1, ("a", 1): 1, ("a", 2): 0}
    assert apportion(frame(spark, []), ["g"], ["k"]).count() == 0


@pytest.mark.parametrize("lookback", [7, 30, 90])
def test_layers_add_up(spark, lookback):
    params = data.Params(data.AS_OF, lookback=lookback)
    prints, billing = data.prints_df(spark, data.prints_rows()), data.billing_df(spark, data.billing_rows())
    totals = {r.layer: r.usd for r in savings.savings_layers(prints, billing, params).collect()}
    rows = savings.full_waterfall(prints, billing, params).collect()
    found = defaultdict(float)
    for r in rows:
        found[r.layer] += r.usd
        assert r.d >= data.day(lookback) and r.sku_name is not None and (r.layer == "raw") == (r.dbus is not None)
    assert set(found) == {"raw", "projected_saving", "realized_saving"}
    for layer, usd in found.items():
        assert usd == pytest.approx(totals[layer], abs=1e-4 if layer != "raw" else 1e-6)
    # A day without usage gets no saving, and more usage never gets less.
    usage = defaultdict(int)
    for d, sku, warehouse, quantity in data.billing_rows():
        if warehouse is not None:
            usage[d] += quantity
    daily = defaultdict(float)
    for r in rows:
        if r.layer == "projected_saving":
            daily[r.d] += r.usd
    days = sorted(daily, key=lambda d: usage[d])
    assert all(daily[a] <= daily[b] + 2e-4 for a, b in zip(days, days[1:], strict=False))


def test_screen_shows_all_layers_and_kpis_only_raw(spark):
    prints, billing = data.prints_df(spark, data.prints_rows()), data.billing_df(spark, data.billing_rows())
    whole = savings.full_waterfall(prints, billing, data.P)
    assert {r.layer for r in reports.spend_by_sku(whole, data.P).collect()} == {
        "raw", "projected_saving", "realized_saving",
    }
    effect = savings.rule_effectiveness(prints, billing, data.P)
    raw = cost.waterfall_daily(billing, data.P)
    assert reports.savings_kpis(whole, effect, data.P).first() == reports.savings_kpis(raw, effect, data.P).first()


def test_no_billing(spark):
    prints = data.prints_df(spark, data.prints_rows(n=50))
    assert savings.full_waterfall(prints, data.billing_df(spark, []), data.P).count() == 0
