from datetime import datetime, timedelta

import data
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import savings
from tallyframe.params import Params

PRINTS, BILLING = data.prints_rows(seed=5), data.billing_rows(seed=6)


@pytest.fixture(scope="module")
def tables(spark):
    return data.prints_df(spark, PRINTS).cache(), data.billing_df(spark, BILLING).cache()


@pytest.mark.parametrize("lookback", [7, 30, 90])
@pytest.mark.parametrize("exact", [False, True])
def test_effectiveness_equals_brute_force(tables, lookback, exact):
    params = Params(data.AS_OF, lookback=lookback, exact_counts=exact)
    rows = savings.rule_effectiveness(*tables, params).collect()
    got = {(r.ck, r.rule_id): (float(r.baseline_rate), r.observed, r.avoided, r.realized_usd) for r in rows}
    want = data.effectiveness(PRINTS, BILLING, lookback, exact)
    assert len(rows) == len(want) and got.keys() == want.keys()
    for key, values in want.items():
        assert got[key] == pytest.approx(values, rel=1e-6, abs=1e-6), key
    assert {r.window for r in rows} == {"2024-03-01/2024-03-31"}


def test_rounded_rate_loses_one_execution(spark):
    """A baseline count of 1 modulo 3 is one execution short, unless counts are exact."""
    rows = []

    def add(ck, ago, times):
        d = data.day(ago)
        start = datetime(d.year, d.month, d.day)
        rows.extend((ck, f"{ck}-{ago}-{i}", d, start, "wh0", 10, None, "r1", start) for i in range(times))

    counts = [(10, 5), (11, 5), (12, 5), (13, 5), (31, 1), (7, 9)]
    for base, now in counts:
        add(f"c{base}", 40, base)
        add(f"c{base}", 10, now)
    prints, billing = data.prints_df(spark, rows), data.billing_df(spark, [])
    loose = savings.rule_effectiveness(prints, billing, data.P).collect()
    exact = savings.rule_effectiveness(prints, billing, Params(data.AS_OF, exact_counts=True)).collect()
    assert {r.ck: r.avoided for r in loose} == {"c10": 4, "c11": 6, "c12": 7, "c13": 7, "c31": 29, "c7": 0}
    assert {r.ck: r.avoided for r in exact} == {f"c{b}": max(0, b - n) for b, n in counts}
    assert {r.realized_usd for r in loose} == {0.0}  # no billing, so nothing is priced


def test_window_edges(spark):
    """Baseline is day -60 to -31, the current window starts at day -30."""
    rows = []
    for ago in (61, 60, 31, 30, 0):
        d = data.day(ago)
        start = datetime(d.year, d.month, d.day) + timedelta(hours=23)
        rows.append(("c", f"s{ago}", d, start, None, 1, None, None, start))
    prints = data.prints_df(spark, rows)
    assert savings.baseline_rate(prints, data.P).first().baseline_rate * 30 == pytest.approx(2, abs=1e-4)
    assert savings.observed_execs(prints, data.P).first().observed == 2


def test_vanished_fingerprints(tables):
    rows = savings.fully_avoided(*tables, data.P).collect()
    assert {r.ck for r in rows} == {"ck1", "ck2"}
    counts = {}
    for row in PRINTS:
        if row[0] in ("ck1", "ck2") and data.day(60) <= row[2] <= data.day(31):
            counts[row[0], row[7]] = counts.get((row[0], row[7]), 0) + 1
    assert {(r.ck, r.rule_id): r.avoided for r in rows} == counts
    priced = data.attributed(PRINTS, BILLING, 60, 31)
    for r in rows:
        execs, usd = priced[r.ck]
        assert r.realized_usd == pytest.approx(r.avoided * usd / execs)
    shown = {r.ck for r in savings.rule_effectiveness(*tables, data.P).collect()}
    assert shown.isdisjoint({"ck1", "ck2"})


def test_layers(tables):
    layers = {r.layer: r.usd for r in savings.savings_layers(*tables, data.P).collect()}
    cost = data.attributed(PRINTS, BILLING, 30)
    assert layers["projected_saving"] == pytest.approx(sum(u * (n - 1) / n for n, u in cost.values() if u))
    assert layers["realized_saving"] == pytest.approx(sum(v[3] for v in data.effectiveness(PRINTS, BILLING).values()))
    assert layers["raw"] == pytest.approx(sum(q / 1000 * 0.7 for d, _, w, q in BILLING if w and d >= data.day(30)))


def test_no_data(spark):
    prints, billing = data.prints_df(spark, []), data.billing_df(spark, [])
    assert savings.rule_effectiveness(prints, billing, data.P).count() == 0
    assert savings.fully_avoided(prints, billing, data.P).count() == 0
    assert {r.usd for r in savings.savings_layers(prints, billing, data.P).collect()} == {0.0}


def test_types(tables):
    types = dict(savings.rule_effectiveness(*tables, data.P).dtypes)
    assert types["baseline_rate"] == "decimal(27,6)"
    assert types["avoided"] == "bigint" and types["realized_usd"] == "double"
    assert tables[0].agg(F.count("*")).first()[0] == len(PRINTS)
