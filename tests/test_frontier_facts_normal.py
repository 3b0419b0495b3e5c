"""The frontier, facts in one merge, and the normal distribution against plain Python."""

import math
import random
from datetime import date, timedelta
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from insidertrail.functions.distributions import normal_cdf, normal_quantile
from insidertrail.operators import facts, research

OBJECTIVES = {"a": 1, "b": 1, "c": -1}


def frontier(points):
    return {i for i, p in points.items() if not any(
        all(x >= y for x, y in zip(q, p)) and any(x > y for x, y in zip(q, p)) for q in points.values())}


@pytest.mark.parametrize("block", [4096, 16])
@pytest.mark.parametrize("kind", ["random", "ties", "all on it"])
def test_frontier_equals_all_pairs(spark, block, kind):
    rng = random.Random(block)
    if kind == "random":
        rows = [(i, rng.random(), rng.random(), rng.random()) for i in range(400)]
    elif kind == "ties":
        rows = [(i, float(rng.randint(0, 3)), float(rng.randint(0, 3)), rng.choice([None, 0.0, 1.0])) for i in range(300)]
    else:
        rows = [(i, x := rng.random(), 1 - x, 0.5) for i in range(200)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows] + [(9999, 9.0, 9.0, -9.0, 0.0)], "id long, a double, b double, c double, val_trades double")
    got = research.pareto_frontier(df.repartition(5), OBJECTIVES, block=block)
    want = frontier({str(i): (a, b, -(1.0 if c is None else c)) for i, a, b, c in rows})
    assert sorted(r.id for r in got.collect()) == sorted(want)


def test_frontier_of_nothing(spark):
    df = spark.createDataFrame([], "id long, a double, b double, c double, val_trades double")
    assert research.pareto_frontier(df, OBJECTIVES).count() == 0


def test_few_comparisons_on_many_points(spark, monkeypatch):
    # The first cut alone: a million random points of five objectives against the frontier of the strongest block.
    points = np.random.default_rng(1).random((1_000_000, 5))
    strongest = points[np.argsort(-points.sum(axis=1))[:research.FRONTIER_BLOCK]]
    first = strongest[research._own_frontier(strongest, 512)]
    left = sum(int((~research._beaten(points[at:at + 20_000], first)).sum()) for at in range(0, 100_000, 20_000)) * 10
    compared = len(points) * len(first) + len(strongest) ** 2 + left * left
    assert compared <= 0.05 * len(points) ** 2


def test_facts_of_all_concepts(spark):
    rng = random.Random(2)
    day = date(2020, 1, 1)
    rows = [(rng.randint(1, 3), rng.choice("xyz"), day + timedelta(rng.choice([0, 30, 60])), day + timedelta(rng.randint(40, 140)), float(rng.randint(1, 9)))
            for _ in range(120)] + [(1, "x", None, day, 1.0), (None, "x", day, day, 1.0), (2, "y", day, None, 1.0)]
    trades = [(rng.randint(1, 4), day + timedelta(rng.randint(0, 160))) for _ in range(60)] + [(None, day), (1, None)]
    df = facts.facts_as_of(spark.createDataFrame(trades, "company_id int, transaction_date date"),
                           spark.createDataFrame(rows, "company_id int, concept string, period_end date, filed_date date, value double"),
                           {"x": "ex", "y": "why"})
    got = {(r.company_id, r.transaction_date): tuple(r[c] and tuple(r[c]) for c in ("ex", "why")) for r in df.collect()}
    want = {}
    for company, on in set(trades):
        if company is not None and on is not None:
            known = [[f[2:] for f in rows if f[0] == company and f[1] == c and f[3] is not None and f[3] <= on] for c in "xy"]
            want[company, on] = tuple(max(k, key=lambda f: (f[0] is not None, f[0] or day, f[1], f[2]), default=None) for k in known)
    assert got == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") <= 3 and "SortMergeJoin" not in plan


def test_normal_distribution_and_quantile(spark):
    probabilities = [10.0 ** -k for k in range(1, 13)] + [1 - 10.0 ** -k for k in range(1, 13)] + [i / 997 for i in range(1, 997)]
    rows = spark.createDataFrame([(p,) for p in probabilities], "p double").withColumn("z", normal_quantile("p")).withColumn("back", normal_cdf("z"))
    for r in rows.collect():
        want = NormalDist().inv_cdf(r.p)
        assert math.isclose(r.z, want, rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(r.back, r.p, rel_tol=1e-9)
        assert math.isclose(1 - r.back, 1 - r.p, rel_tol=1e-4 if r.p > 1 - 1e-11 else 1e-6, abs_tol=1e-15)
    odd = spark.createDataFrame([(0.0,), (1.0,), (-1.0,), (None,), (float("nan"),)], "p double")
    assert [r[0] for r in odd.select(normal_quantile("p")).collect()] == [None] * 5
    ends = spark.createDataFrame([(-40.0,), (40.0,), (0.0,), (7.5,), (None,), (float("nan"),)], "z double").select(normal_cdf("z"))
    assert [r[0] for r in ends.collect()][:3] == [0.0, 1.0, 0.5] and [r[0] for r in ends.collect()][4:] == [None, None]


def test_chance_sharpe_follows_the_ledger(spark):
    records = [("a", 1, 0.1), ("b", 1, 0.3), ("c", 2, None), ("d", 2, 0.5), ("e", 3, 0.2), ("f", 3, 0.4), ("g", 3, 0.9)]
    trials = research.ledger_trials(spark.createDataFrame(records, "id string, batch int, sr_hat double"))
    n, v = spark.range(1).select(trials["n_trials"], trials["sr_variance"]).first()
    assert n == 7 and v == round(0.5 * round(0.5 * 0.01, 6) + 0.5 * float(np.var([0.2, 0.4, 0.9])), 6)
    empty = research.ledger_trials(spark.createDataFrame([], "id string, batch int, sr_hat double"))
    row = spark.range(1).select(empty["n_trials"].alias("n"), empty["chance"].alias("s")).first()
    assert (row.n, row.s) == (0, 0.0)
    q, n = NormalDist().inv_cdf, 50
    want = 0.1 * ((1 - research.EULER_GAMMA) * q(1 - 1 / n) + research.EULER_GAMMA * q(1 - 1 / (n * math.e)))
    assert math.isclose(spark.range(1).select(research.expected_max_sharpe(F.lit(n), F.lit(0.01))).first()[0], want, rel_tol=1e-9)
