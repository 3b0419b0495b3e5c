"""Operators against brute force on small fixtures, including skewed keys."""

import datetime as dt
import math
import random
import zipfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from insidertrail.operators import asof, clusters, events as E, ledger as L, research as R, scores as SC, signals as G
from insidertrail.operators.quantiles import exact_quantiles
from insidertrail.params import SIGNALS
from insidertrail.sources import bulk, documents, loading

D0 = dt.date(2020, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


def price_rows(seed, tickers=("A", "B"), days=200):
    rng = random.Random(seed)
    return [(t, day(i), 50 + rng.random() * 10) for t in tickers for i in range(days) if rng.random() < 0.6]


def test_bracket_against_brute_force(spark):
    rows = price_rows(1)
    prices = spark.createDataFrame(rows, "ticker string, date date, adj_close double")
    asked = [(t, day(i)) for t in ("A", "B", "Z") for i in range(-3, 205, 2)]
    reqs = spark.createDataFrame(asked, "ticker string, as_of date")
    for strict in (False, True):
        got = {(r.ticker, r.as_of): (r.prev and r.prev.date, r.next and r.next.date)
               for r in asof.bracket(reqs, prices, strict=strict).collect()}
        for t, d in asked:
            before = [x for k, x, _ in rows if k == t and (x < d if strict else x <= d)]
            after = [x for k, x, _ in rows if k == t and (x > d if strict else x >= d)]
            assert got[(t, d)] == (max(before, default=None), min(after, default=None))


def test_nearest_prefers_the_later_row(spark):
    prices = spark.createDataFrame([("A", day(0), 1.0), ("A", day(4), 2.0)], "ticker string, date date, adj_close double")
    reqs = spark.createDataFrame([("A", day(2)), ("A", day(1)), ("A", day(10)), ("A", day(9))], "ticker string, as_of date")
    got = {r.as_of: r.v for r in asof.bracket(reqs, prices).select("as_of", asof.nearest(
        F.col("as_of"), F.col("prev"), F.col("next"), "adj_close").alias("v")).collect()}
    assert got == {day(2): 2.0, day(1): 1.0, day(10): None, day(9): 2.0}


@pytest.mark.parametrize("before,after", [(7, 0), (7, 7)])
def test_cluster_counts_with_a_hot_company(spark, before, after):
    rng = random.Random(before + after)
    # One company holds most rows, one insider most of its rows.
    rows = [(0 if rng.random() < 0.6 else rng.randint(1, 5), 0 if rng.random() < 0.4 else rng.randint(1, 30),
             day(rng.randint(0, 60))) for _ in range(600)]
    df = spark.createDataFrame(rows, "company_id int, insider_id int, transaction_date date")
    got = {(r.company_id, r.transaction_date): r.n_members
           for r in clusters.visible_members(df, df, before=before, after=after).collect()}
    for c, _, d in rows:
        want = {i for k, i, x in rows if k == c and -before <= (x - d).days <= after}
        assert got[(c, d)] == len(want)


def test_exact_quantiles_with_a_hot_value(spark):
    rng = random.Random(5)
    xs = [7.0 if rng.random() < 0.35 else rng.random() * 20 for _ in range(997)]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    probs = [0.0, 0.2, 0.5, 0.77, 1.0]
    edges = exact_quantiles(df.repartition(5), "v", probs).first().edges
    xs.sort()
    for p, e in zip(probs, edges):
        pos = p * (len(xs) - 1)
        lo, hi = xs[math.floor(pos)], xs[math.ceil(pos)]
        assert e == pytest.approx(lo + (hi - lo) * (pos - math.floor(pos)), abs=1e-12)


def test_lot_collapse_skips_nulls(spark):
    schema = ("txn_id bigint, insider_id int, company_id int, transaction_date date, shares double, total_value double, "
              "price_per_share double, shares_owned_after double")
    df = spark.createDataFrame([
        (1, 1, 1, day(0), 10.0, None, None, 5.0), (2, 1, 1, day(0), 5.0, None, 3.0, None),
        (3, 1, 1, day(0), 1.0, None, 4.0, 9.0), (4, None, 1, day(0), 1.0, 1.0, 1.0, 1.0)], schema)
    [r] = E.collapse_lots(df).collect()
    assert (r.txn_id, r.shares, r.total_value, r.price_per_share, r.shares_owned_after) == (1, 16.0, 0.0, 3.0, 9.0)
    big = spark.createDataFrame([(1, 1, 1, day(0), 10.0), (2, 1, 1, day(0), 30.0), (3, 1, 1, day(0), 30.0)],
                                "txn_id bigint, insider_id int, company_id int, transaction_date date, total_value double")
    [b] = E.largest_lots(big).collect()
    assert (b.txn_id, b.event_total_value) == (2, 70.0)


def test_confidence_matches_recurrence(spark):
    pairs = [(18, 2), (0, 5), (3, 0), (0, 0), (400, 300), (6000, 5000)]
    df = spark.createDataFrame([(h, h + m) for h, m in pairs], "hits int, n int")
    got = [r[0] for r in df.select(SC.confidence_above_baseline(F.col("hits"), F.col("n"))).collect()]
    assert got[0] == pytest.approx(0.99678892920117, abs=1e-10)
    assert got[1] == pytest.approx(0.07358804439947, abs=1e-10)
    assert got[2] == pytest.approx(0.78991548599263, abs=1e-10)
    assert all(0 <= g <= 1 for g in got)


def test_score_ordering_and_minimum_sample(spark):
    def record(insider, n, hits, up, down):
        return [(i, insider, 1, day(30 * i), 100.0, up if i < hits else down, i < hits, None) for i in range(n)]

    rows = record(1, 20, 18, 0.50, -0.07) + record(2, 10, 5, 0.06, -0.06) + record(3, 8, 2, 0.03, -0.10) + record(4, 2, 2, 0.5, 0)
    df = spark.createDataFrame(rows, "txn_id bigint, insider_id int, company_id int, transaction_date date, total_value double, "
                                     "excess_return_60d double, hit_60d boolean, prior_momentum_20d double")
    got = {r.insider_id: r for r in SC.score_columns(SC.track_records(df)).collect()}
    assert got[1].tier == "Elite" and got[4].tier == "Insufficient" and got[4].skill_score == 0.0
    assert got[1].skill_score > got[2].skill_score > got[3].skill_score and got[3].tier == "Weak"
    # Scores as of a date ignore later events.
    asked = spark.createDataFrame([(1, day(95)), (1, day(0))], "insider_id int, as_of date")
    before = {r.as_of: r.n for r in SC.as_of_scores(asked, df).collect()}
    assert before == {day(95): 4, day(0): 0}


def brute_concentration(rows, per_insider=1, per_ticker=2):
    opened, entries, taken = [], set(), []
    for txn, ticker, insider, known, closes, forced, entry in sorted(rows, key=lambda r: (r[3], r[0])):
        opened = [o for o in opened if o[3] or o[2] > known]
        here = [o for o in opened if o[0] == ticker]
        if (len(here) < per_ticker and sum(o[1] == insider for o in here) < per_insider
                and (ticker, insider, entry) not in entries):
            opened.append((ticker, insider, closes, forced))
            entries.add((ticker, insider, entry))
            taken.append(txn)
    return sorted(taken)


CONCENTRATION = ("txn_id bigint, ticker string, insider_id int, known_on date, exit_date date, forced boolean, entry_date date")


@pytest.mark.parametrize("seed, limits", [(0, (1, 2)), (1, (1, 2)), (2, (2, 3)), (3, (3, 5))])
def test_concentration_with_a_hot_ticker(spark, seed, limits):
    rng = random.Random(seed)
    rows = [(i, "HOT" if rng.random() < 0.5 else f"T{rng.randint(0, 3)}", rng.randint(0, 6), day(k := rng.randint(0, 40)),
             day(k + rng.randint(3, 9)), rng.random() < 0.05, day(k + 2 - k % 3)) for i in range(500)]
    got = L.limit_concentration(spark.createDataFrame(rows, CONCENTRATION),
                                replace(SIGNALS, max_per_insider_ticker=limits[0], max_per_ticker=limits[1]))
    assert sorted(r.txn_id for r in got.collect()) == brute_concentration(rows, *limits)


def test_a_refused_filing_does_not_block_a_later_one(spark):
    rows = [(1, "T", 1, day(0), day(4), False, day(0)), (2, "T", 2, day(1), day(30), False, day(1)),
            (3, "T", 3, day(3), day(30), False, day(5)), (4, "T", 3, day(5), day(30), False, day(5)),
            (5, "T", 3, day(5), day(30), False, day(5))]
    got = L.limit_concentration(spark.createDataFrame(rows, CONCENTRATION))
    assert sorted(r.txn_id for r in got.collect()) == brute_concentration(rows) == [1, 2, 4]


def test_pareto_frontier_against_brute_force(spark):
    rng = random.Random(3)
    names = list(R.OBJECTIVES)
    rows = [(f"s{i}", *[round(rng.random(), 1) for _ in names], 10.0) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, " + ", ".join(f"{n} double" for n in names) + ", val_trades double")
    signs = list(R.OBJECTIVES.values())
    pts = {r[0]: [v * s for v, s in zip(r[1:], signs)] for r in rows}
    want = {i for i, p in pts.items() if not any(
        all(x >= y for x, y in zip(q, p)) and any(x > y for x, y in zip(q, p)) for q in pts.values())}
    assert {r.id for r in R.pareto_frontier(df.repartition(5)).collect()} == want


def test_deflated_sharpe(spark):
    df = spark.createDataFrame([("a", 0.5, 100, 0.0, 3.0), ("b", 0.0, 100, 0.0, 3.0), ("c", 0.5, 1, 0.0, 3.0)],
                               "id string, sr_hat double, n_obs int, skew double, kurtosis double")
    got = {r.id: r.deflated_sharpe for r in R.with_deflated_sharpe(df, 1, 0.0).collect()}
    assert got["a"] > 0.999 and got["b"] == pytest.approx(0.5) and got["c"] == 0.0
    stricter = {r.id: r.deflated_sharpe for r in R.with_deflated_sharpe(df, 1000, 0.02).collect()}
    assert stricter["a"] < got["a"]


def test_spec_resolution(spark):
    specs = spark.createDataFrame([
        ("ok", None, ["value_100k", "first_buy"], None, "train"), ("base", "cluster_buy", [], 20, "train"),
        ("x", "nope", [], 20, "train"), ("y", None, ["bogus"], 20, "train"), ("z", None, [], 20, "nowhere")], R.SPEC_SCHEMA)
    windows = spark.createDataFrame([("train", None, day(0))], R.WINDOW_SCHEMA)
    good, bad = R.resolve_specs(specs, windows)
    assert {r.id: (r.required, r.complexity, r.hold_days) for r in good.collect()} == {
        "ok": (4 + 32, 2, 60), "base": (64, 0, 20)}
    assert {r.id for r in bad.collect()} == {"x", "y", "z"}
    locked = specs.withColumn("window", F.lit("test"))
    with pytest.raises(PermissionError):
        R.refuse_locked_window(locked)
    assert R.refuse_locked_window(locked, allow_test=True) is locked


def test_registry_rejects_duplicates(spark):
    with pytest.raises(ValueError):
        G.signal_registry(spark, [G.SignalType("a"), G.SignalType("a")])
    s = G.cluster_buy()
    assert s.names(tradeable=True) == ["cluster_buy"] and s.names(visible=False) == ["filtered_out"]


def test_entry_limits_as_columns(spark):
    df = spark.createDataFrame([(-1, -1), (0, 0), (1, 1), (0, 2)], "open_for_insider_ticker int, open_in_ticker int")
    assert [r[0] for r in df.select(G.concentration_reason()).collect()] == [None, None, "insider_ticker_limit", "ticker_limit"]


FOOTNOTES = ("ACCESSION_NUMBER\tFOOTNOTE_ID\tFOOTNOTE_TXT\n"
             'A1\tF1\t"say ""hi"""\n' "A1\tF2\n" 'A1\tF3\tpursuant to the "Plan"\textra\n'
             'A1\tF4\t"a\ttab and\na line"\n')
OTHER_HEADER = "FOOTNOTE_TXT\tNEW_COLUMN\tACCESSION_NUMBER\nplain\tx\tA2\n"
FOOTNOTE_ROWS = [("A1", "F1", 'say "hi"'), ("A1", "F2", None), ("A1", "F3", 'pursuant to the "Plan"'),
                 ("A1", "F4", "a\ttab and\na line"), ("A2", None, "plain")]


def in_order(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_members_of_archives(spark, tmp_path):
    for name, members in (("q1", {"FOOTNOTES.tsv": FOOTNOTES}), ("q2", {"OTHER.tsv": "x\n"}),
                          ("q3", {"FOOTNOTES.tsv": OTHER_HEADER}), ("q4", {"FOOTNOTES.tsv": ""})):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for member, text in members.items():
                z.writestr(member, text)
    rows = bulk.read_archives(spark, str(tmp_path / "*.zip"), "FOOTNOTES")
    assert in_order(rows) == FOOTNOTE_ROWS
    assert sorted(r.text for r in bulk.footnote_rows(rows).collect()) == ["a\ttab and\na line", 'pursuant to the "Plan"', 'say "hi"']


def test_extracted_members(spark, tmp_path):
    for name, text in (("q1", FOOTNOTES), ("q2", OTHER_HEADER)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "FOOTNOTES.tsv").write_text(text)
    assert in_order(bulk.read_member(spark, str(tmp_path), "FOOTNOTES")) == FOOTNOTE_ROWS
    assert bulk.read_member(spark, str(tmp_path), "DERIV_TRANS").count() == 0
    texts = spark.createDataFrame([(FOOTNOTES,), (OTHER_HEADER,), (None,)], "text string")
    assert in_order(bulk.members_from_texts(texts, "FOOTNOTES")) == FOOTNOTE_ROWS


def test_ownership_documents_from_files(spark, tmp_path):
    xml = ("<ownershipDocument><issuer><issuerCik>0000320193</issuerCik><issuerName>Acme</issuerName>"
           "<issuerTradingSymbol>ACME</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId>"
           "<rptOwnerCik>0001</rptOwnerCik><rptOwnerName>Doe</rptOwnerName></reportingOwnerId>"
           "<reportingOwnerRelationship><isOfficer>1</isOfficer></reportingOwnerRelationship></reportingOwner>"
           "<nonDerivativeTable>{}</nonDerivativeTable></ownershipDocument>")
    move = ("<nonDerivativeTransaction><transactionDate><value>2025-03-10</value></transactionDate><transactionCoding>"
            "<transactionCode>{}</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>{}</value>"
            "</transactionShares><transactionPricePerShare><value>{}</value></transactionPricePerShare></transactionAmounts>"
            "</nonDerivativeTransaction>")
    (tmp_path / "acc1.xml").write_text(xml.format(move.format("P", 1000, 185.5) + move.format("M", 500, 0)))
    (tmp_path / "acc2.xml").write_text("<ownershipDocument><broken")
    docs = documents.read_form4(spark, str(tmp_path)).select(
        "*", F.lit("acc1").alias("accession"), F.lit("2025-03-12").cast("date").alias("filing_date"))
    got = {r.transaction_code: r for r in documents.form4_transactions(docs).collect()}
    assert got["P"].total_value == 185500.0 and got["P"].accession_number == "acc1_P_2025-03-10_1000.0"
    assert got["M"].total_value is None and got["P"].is_officer and got["P"].company_cik == "320193"


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (2, "b", 3.0)], "k int, n string, v double")
    none = rows.where("false")
    loading.append_absent(path, none, rows, ["k", "n"], order="v")
    loading.append_absent(path, spark.read.parquet(path), rows, ["k", "n"], order="v")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a", 1.0), (2, "b", 3.0)]


def test_ledger_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "T", "s", day(0), day(5), 10.123, 11.0, 2.0, 1.0, 0.1, 60, False)],
                               "txn_id bigint, ticker string, signal_type string, entry_date date, exit_date date, entry_price double, "
                               "exit_price double, shares_held double, pnl double, pnl_pct double, hold_days int, forced boolean")
    L.export_trades(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["entry_price"] == "10.123"
    L.export_trades(df, str(tmp_path / "json"), fmt="json")
    assert spark.read.json(str(tmp_path / "json")).first()["entry_price"] == 10.12
    assert L.ledger_diff(df, df, ["txn_id", "pnl"]).count() == 0


def test_features_of_a_few_rows_equal_those_of_all(spark):
    from insidertrail.plans.adapter import Tables
    from insidertrail.plans.helpers import scores

    t = Tables(spark, "/root/testdata/sf0.001")
    rows = t.transactions.where("is_discretionary AND txn_id % 400 = 1")
    args = (t.transactions, t.insiders, t.companies, t.roles, t.prices, scores(t))
    whole, cut = (G.live_features(rows, *args, few=few) for few in (False, True))
    assert in_order(whole.select(sorted(whole.columns))) == in_order(cut.select(sorted(cut.columns))) != []


def test_alerts_read_prices_and_people_once(spark, tmp_path):
    from insidertrail.plans.adapter import Tables
    from insidertrail.plans.helpers import compute_outcomes
    from insidertrail.plans.scores_and_signals import _live, live_strategy

    rng = random.Random(5)
    spark.createDataFrame([(i, rng.randrange(300), rng.choice("OFP"), 1000.0 + rng.randrange(90_000),
                            dt.datetime(1996, 1, 1) + dt.timedelta(days=rng.randrange(300))) for i in range(400)],
                          "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
                          "o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(i % 25, float(rng.randrange(1, 50)), dt.datetime(1996, 1, 1) + dt.timedelta(days=i // 25))
                           for i in range(25 * 400)], "l_partkey bigint, l_quantity double, l_shipdate timestamp"
                          ).write.parquet(str(tmp_path / "lineitem.parquet"))
    t = Tables(spark, str(tmp_path))
    staged, direct = _live(t), (t.transactions, t.insiders, t.companies, t.roles, t.prices, _live(t)[-1])
    found = G.buy_alerts(live_strategy(), *staged)
    assert not any("lineitem.parquet" in f for df in (found, compute_outcomes(t)) for f in df.inputFiles())
    assert in_order(found) == in_order(G.buy_alerts(live_strategy(), *direct)) != []


def test_person_alerts_shuffle_no_trade_without_an_alert(spark):
    trades = spark.createDataFrame([(1, True), (1, True), (2, False), (3, None), (None, True), (5, True)],
                                   "txn_id bigint, is_common_stock boolean")
    people = spark.createDataFrame([(7, False), (8, True), (None, False)], "insider_id int, is_institution boolean")
    alerts = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (3, 7), (None, 7), (4, 7), (5, 8), (5, None)],
                                   "transaction_id bigint, insider_id int")
    out = G.person_alerts(alerts, trades, people)
    assert sorted(r.transaction_id for r in out.collect()) == [1, 1, 3]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 3  # people, common trades, and those trades cut down to alerted ones


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from insidertrail.session import shared_folder

    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError):
        shared_folder(Elsewhere)
    Elsewhere.conf.get = staticmethod(lambda key, default=None: "hdfs:///shared/")
    assert shared_folder(Elsewhere) == "hdfs:///shared"
