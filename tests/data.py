"""Small fingerprint and billing tables with every awkward case, and their brute-force results."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

from tallyframe.params import Params
from tallyframe.schemas import BILLING_USAGE, FINGERPRINT_HISTORY

AS_OF = date(2024, 3, 31)
P = Params(AS_OF)


def day(ago):
    return AS_OF - timedelta(days=ago)


def prints_rows(seed=1, n=4000):
    """A third of the rows share one fingerprint, one warehouse and one rule."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 1 / 3
        ago = rng.choice([0, 15, 29, 30, 31, 32, 45, 60, 61, 70])
        ck = "hot" if hot else f"ck{rng.randint(0, 30)}"
        if not hot and ck in ("ck1", "ck2") and ago <= 30:
            ck = "ck3"  # ck1 and ck2 vanish
        warehouse = "wh0" if hot else rng.choice([None, "wh0", "wh1", "wh2", "idle"])
        rule = "r0" if hot else rng.choice([None, "r0", "r1", "r2"])
        ms = 0 if warehouse == "idle" else rng.choice([None, 0, 1, 250, 100_000])
        d = day(ago)
        start = datetime(d.year, d.month, d.day, rng.randint(0, 23), rng.randint(0, 59), 7, 123456)
        route = rng.choice([None, "warehouse", "cache_miss", "bypass", "smaller_wh"])
        rows.append((ck, f"s{i}", d, start, warehouse, ms, route, rule, start))
    return rows


def billing_rows(seed=2, n=600):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        d = day(rng.choice([0, 15, 29, 30, 31, 45, 60]))
        warehouse = rng.choice([None, "wh0", "wh1", "idle", "unused"])  # wh2 has no cost
        quantity = rng.randint(0, 9_999_999)
        rows.append((d, f"sku{rng.randint(0, 2)}", warehouse, quantity))
    return rows


def prints_df(spark, rows):
    return spark.createDataFrame(rows, FINGERPRINT_HISTORY)


def billing_df(spark, rows):
    from decimal import Decimal

    full = []
    for d, sku, warehouse, q in rows:
        start = datetime(d.year, d.month, d.day)
        full.append((d, sku, warehouse, Decimal(q).scaleb(-3), start, start, "SQL"))
    return spark.createDataFrame(full, BILLING_USAGE)


def attributed(prints, billing, lo, hi=-10_000, rate=0.7):
    """Statement by statement: {ck: (execs, usd or None)} for the days from -lo to -hi."""
    cost, total = defaultdict(float), defaultdict(int)
    has_total = set()
    inside = lambda d: day(lo) <= d <= day(hi)
    for d, _, warehouse, q in billing:
        if inside(d) and warehouse is not None:
            cost[d, warehouse] += q / 1000 * rate
    for _, _, d, _, warehouse, ms, *_ in prints:
        if inside(d) and warehouse is not None:
            has_total.add((d, warehouse))
            total[d, warehouse] += ms or 0
    out = {}
    for ck, _, d, _, warehouse, ms, *_ in prints:
        key = (d, warehouse)
        if not inside(d) or key not in cost or key not in has_total:
            continue
        execs, usd = out.get(ck, (0, None))
        if ms is not None and total[key]:
            usd = (usd or 0.0) + cost[key] * ms / total[key]
        out[ck] = (execs + 1, usd)
    return out


def effectiveness(prints, billing, lookback=30, exact=False):
    """{(ck, rule): (rate, observed, avoided, usd)} by the definition, with whole micro-units."""
    base, observed = defaultdict(int), defaultdict(int)
    for row in prints:
        ck, d, rule = row[0], row[2], row[7]
        if day(60) <= d <= day(31):
            base[ck, rule] += 1
        if d >= day(30):
            observed[ck] += 1
    cost = attributed(prints, billing, lookback)
    out = {}
    for (ck, rule), n in base.items():
        if ck not in observed:
            continue
        rate = (n * 1_000_000 * 2 + 30) // 60  # micro-executions per day, half up
        gap = (n * 1_000_000 if exact else rate * 30) - observed[ck] * 1_000_000
        execs, usd = cost.get(ck, (0, None))
        per_exec = usd / execs if usd is not None else 0.0
        out[ck, rule] = (rate / 1e6, observed[ck], max(0, gap) // 1_000_000, max(0, gap) / 1e6 * per_exec)
    return out
