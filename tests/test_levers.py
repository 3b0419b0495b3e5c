"""Exit and size levers of specifications, and the spread over orders, against plain Python."""

import hashlib
import random
from datetime import date, timedelta
from statistics import fmean, pstdev

import pytest
from pyspark.sql import functions as F

from insidertrail.operators import levers as V
from insidertrail.operators import research as R
from insidertrail.params import SignalParams

DAY = date(2020, 1, 1)


def specs(spark, rows):
    return spark.createDataFrame([(i, None, atoms, 20, "train", exits, size) for i, atoms, exits, size in rows], R.LEVER_SCHEMA)


def test_specs_with_levers(spark):
    rows = [("plain", [], None, None), ("both", ["first_buy"], ["b", "a"], ("csuite", 0.5)), ("odd", [], ["c"], None),
            ("size", [], [], ("csuite", 0.7)), ("ban", ["nothing"], ["a"], ("csuite", 0.5)), ("round", [], ["a"], ("csuite", 0.50001))]
    windows = spark.createDataFrame([("train", None, None)], R.WINDOW_SCHEMA)
    sizes = [R.FLAT, ("csuite", 0.5)]
    good, bad = R.resolve_specs(specs(spark, rows), windows, exits=["a", "b"], sizes=sizes,
                                banned={"no such region": F.array_contains("atoms", "nothing")})
    assert {r.id: (r.exit_bits, r.size_index, r.core_key, r.complexity) for r in good.collect()} == {
        "plain": (0, 0, "cluster_buy||0.0|", 0), "both": (3, 1, "cluster_buy|csuite|0.5|a,b", 1),
        "round": (1, 1, "cluster_buy|csuite|0.5|a", 0)}
    assert {r.id: r.reason for r in bad.collect()} == {
        "odd": "unknown exit", "size": "unknown sizing", "ban": "banned spec: no such region"}
    plain = specs(spark, rows[:1]).drop("exits", "sizing")
    assert R.resolve_specs(plain, windows)[0].first()["core_key"] == "cluster_buy||0.0|"


def test_lattice_takes_the_first_exit_of_a_set(spark):
    prices = [("T", DAY + timedelta(d), 100.0 + d) for d in range(12)]
    px = spark.createDataFrame(prices, "ticker string, date date, adj_close double")
    flagged = spark.createDataFrame([(1, 7, "T", DAY, DAY, "CEO", 1e6), (2, 8, "T", DAY + timedelta(9), None, "Director", 1e6)],
                                    "txn_id long, insider_id int, ticker string, transaction_date date, filing_date date, role_title string, total_value double")

    def event(day, trigger, at):
        return ("T", DAY + timedelta(day), (DAY + timedelta(trigger), (DAY + timedelta(at), 100.0 + at)))

    kind = "ticker string, date date, xq struct<trigger: date, row: struct<date: date, adj_close: double>>"
    exits = {"a": spark.createDataFrame([event(3, 3, 4), event(0, 0, 0)], kind), "b": spark.createDataFrame([event(2, 3, 3)], kind)}
    atoms = {"always": lambda: F.lit(True)}
    rows = V.trade_lattice(flagged, px, [5, 30], F.lit(False), exits=exits, sizes=[R.FLAT, ("csuite", 0.5)], atoms=atoms)
    got = {(r.txn_id, p.hold_days, p.exit_bits): ((p.exit_date - DAY).days, p.forced) for r in rows.collect() for p in r.lattice}
    assert got == {(1, 5, 0): (5, False), (1, 5, 1): (4, False), (1, 5, 2): (3, False), (1, 5, 3): (3, False),
                   (1, 30, 0): (11, True), (1, 30, 1): (4, False), (1, 30, 2): (3, False), (1, 30, 3): (3, False),
                   **{(2, h, m): (11, True) for h in (5, 30) for m in range(4)}}
    assert {r.txn_id: r.sizes for r in rows.collect()} == {1: [500.0, 750.0], 2: [500.0, 500.0]}
    assert {r.own for r in rows.collect()} == {1}


def folded(trades, seeds, per_insider, per_ticker, capital=10_000.0):
    """(mean, cv) per (required, point) by taking trades one after another for each seed."""
    out = {}
    for point in range(2):
        for size in range(2):
            returns = []
            for seed in seeds:
                total, tickers = 0.0, {t["ticker"] for t in trades}
                for ticker in tickers:
                    mine = [t for t in trades if t["ticker"] == ticker]
                    mine.sort(key=lambda t: (t["day"], hashlib.md5(f"{seed}:{t['txn']}".encode()).hexdigest(), t["txn"]))
                    held = []
                    for t in mine:
                        closes, pct, forced = t["points"][point]
                        held = [h for h in held if h[2] or h[1] > t["day"]]
                        if len(held) < per_ticker and sum(h[0] == t["who"] for h in held) < per_insider:
                            held.append((t["who"], closes, forced))
                            total += t["sizes"][size] * pct
                returns.append(total / capital)
            mean = fmean(returns)
            out[point, size] = (round(mean, 9), round(pstdev(returns) / mean if mean else 0.0, 6))
    return out


@pytest.mark.parametrize("per_insider,per_ticker,seeds", [(1, 2, [0, 1, 2]), (2, 3, [5]), (1, 1, list(range(20)))])
def test_spread_equals_one_order_after_another(spark, per_insider, per_ticker, seeds):
    rng = random.Random(per_ticker)
    trades, txn = [], 0
    for day in range(25):
        for ticker in ("A", "B"):
            crowd = rng.sample(range(30), rng.choice([0, 1, 2, 12]))
            for who in crowd:
                txn += 1
                points = [(day + rng.randint(1, 9), rng.uniform(-0.2, 0.3), rng.random() < 0.01) for _ in range(2)]
                trades.append({"txn": txn, "who": who, "ticker": ticker, "day": day, "points": points, "sizes": [500.0, rng.choice([500.0, 750.0])]})
    rows = [(1, False, "train", t["txn"], t["who"], t["ticker"], DAY + timedelta(t["day"]), t["sizes"],
             [(h, 0, DAY + timedelta(c), pct, forced) for h, (c, pct, forced) in zip((20, 60), t["points"])]) for t in trades]
    counted = spark.createDataFrame(rows, "bits int, exact boolean, window string, txn_id long, insider_id int, ticker string, known_on date, "
                                          "sizes array<double>, lattice array<struct<hold_days: int, exit_bits: int, exit_date: date, pnl_pct: double, forced: boolean>>")
    limits = SignalParams(max_per_insider_ticker=per_insider, max_per_ticker=per_ticker)
    got = V.order_spread(counted, [1, 2], seeds=seeds, p=limits).collect()
    want = folded(trades, seeds, per_insider, per_ticker)
    assert {({20: 0, 60: 1}[r.hold_days], r.size_index): (round(r.mean_ret, 9), round(r.cv, 6)) for r in got} == want
    assert {r.required for r in got} == {1}
    assert len(seeds) == 1 or any(cv for _, cv in want.values())
