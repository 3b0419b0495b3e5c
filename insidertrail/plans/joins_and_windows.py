"""Queries on loading joins, as-of lookups, clusters, flags and window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from insidertrail.operators import asof, flags as FL
from insidertrail.operators import events as E
from insidertrail.operators import prices as P
from insidertrail.operators.clusters import rows_in_window, visible_members
from insidertrail.operators.outcomes import prior_momentum
from insidertrail.operators.quantiles import exact_quantiles
from insidertrail.plans.helpers import big, buy_events, compute_buy_events, compute_flagged, compute_outcomes, outcomes, rounded
from insidertrail.plans.oracle_views import CSUITE_SQL
from insidertrail.plans.registry import query

# --- joins ------------------------------------------------------------------


@query("j01_matured_buys", """
SELECT txn_id, insider_id, company_id, ticker, insider_name, transaction_date, filing_date,
       round(excess_return_60d, 6) AS excess_return_60d, hit_60d FROM ox_lots""")
def j01(t):
    lots = E.matured_buys(t.transactions, outcomes(t), t.companies, t.insiders)
    return rounded(lots.select("txn_id", "insider_id", "company_id", "ticker", "insider_name",
                               "transaction_date", "filing_date", "excess_return_60d", "hit_60d"),
                   "excess_return_60d")


@query("j02_role_title", """
SELECT t.txn_id, t.insider_id, t.company_id, r.role_title
FROM fx_transactions t LEFT JOIN fx_roles r USING (insider_id, company_id) WHERE t.is_discretionary""")
def j02(t):
    buys = t.transactions.where("is_discretionary")
    return E.with_role_title(buys, t.roles).select("txn_id", "insider_id", "company_id", "role_title")


@query("j03_pending_outcomes", """
SELECT txn_id, insider_id, transaction_date FROM fx_transactions t
WHERE is_discretionary AND NOT EXISTS (SELECT 1 FROM ox_outcomes o WHERE o.txn_id = t.txn_id)""")
def j03(t):
    rows = t.transactions.where("is_discretionary").select("txn_id", "insider_id", "transaction_date")
    return E.without_matches(rows, outcomes(t), ["txn_id"])


@query("j04_asof_backward", """
SELECT t.txn_id, p.date AS price_date, p.adj_close FROM
 (SELECT txn_id, transaction_date, ticker FROM fx_transactions JOIN fx_companies USING (company_id)) t
 ASOF LEFT JOIN fx_prices p ON p.ticker = t.ticker AND t.transaction_date >= p.date""")
def j04(t):
    rows = t.transactions.join(t.companies, "company_id").select("txn_id", "ticker", "transaction_date")
    asked = rows.select("ticker", F.col("transaction_date").alias("as_of"))
    found = asof.bracket(asked, t.prices, next=False)
    return asof.attach(rows, found, on="transaction_date").select(
        "txn_id", F.col("prev.date").alias("price_date"), F.col("prev.adj_close").alias("adj_close"))


@query("j05_asof_forward", """
SELECT t.txn_id, p.date AS price_date, p.adj_close FROM
 (SELECT txn_id, filing_date, ticker FROM fx_transactions JOIN fx_companies USING (company_id)) t
 ASOF LEFT JOIN fx_prices p ON p.ticker = t.ticker AND t.filing_date <= p.date""")
def j05(t):
    rows = t.transactions.join(t.companies, "company_id").select("txn_id", "ticker", "filing_date")
    asked = rows.select("ticker", F.col("filing_date").alias("as_of"))
    found = asof.bracket(asked, t.prices, prev=False)
    return asof.attach(rows, found, on="filing_date").select(
        "txn_id", F.col("next.date").alias("price_date"), F.col("next.adj_close").alias("adj_close"))


@query("j06_n_rows_later", """
SELECT t.txn_id, p.date AS entry_date, q.date AS exit_date, q.adj_close AS exit_price FROM
 (SELECT txn_id, filing_date, ticker FROM fx_transactions JOIN fx_companies USING (company_id)) t
 ASOF LEFT JOIN ox_px p ON p.ticker = t.ticker AND t.filing_date <= p.date
 LEFT JOIN ox_px q ON q.ticker = p.ticker AND q.rn = p.rn + 60""")
def j06(t):
    rows = t.transactions.join(t.companies, "company_id").select("txn_id", "ticker", "filing_date")
    asked = rows.select("ticker", F.col("filing_date").alias("as_of"))
    found = asof.bracket(asked, asof.with_leads(t.prices, [60]), values=["adj_close", "fwd60"], prev=False)
    return asof.attach(rows, found, on="filing_date").select(
        "txn_id", F.col("next.date").alias("entry_date"), F.col("next.fwd60.date").alias("exit_date"),
        F.col("next.fwd60.adj_close").alias("exit_price"))


@query("j07_nearest_price", """
SELECT t.txn_id, (SELECT arg_min(p.adj_close, abs(p.date - t.transaction_date) * 2
                                 + CASE WHEN p.date < t.transaction_date THEN 1 ELSE 0 END)
  FROM fx_prices p WHERE p.ticker = t.ticker
   AND p.date BETWEEN t.transaction_date - 5 AND t.transaction_date + 5) AS price
FROM (SELECT * FROM fx_transactions JOIN fx_companies USING (company_id)) t""")
def j07(t):
    rows = t.transactions.join(t.companies, "company_id").select("txn_id", "ticker", "transaction_date")
    asked = rows.select("ticker", F.col("transaction_date").alias("as_of"))
    found = asof.bracket(asked, t.prices)
    near = asof.nearest(F.col("transaction_date"), F.col("prev"), F.col("next"), "adj_close")
    return asof.attach(rows, found, on="transaction_date").select("txn_id", near.alias("price"))


@query("j08_kth_event_after", """
SELECT t.txn_id,
  (SELECT min(e.earnings_date) FROM fx_earnings e WHERE e.ticker = t.ticker AND e.earnings_date > t.filing_date)
    AS first_after,
  (SELECT e.earnings_date FROM fx_earnings e WHERE e.ticker = t.ticker AND e.earnings_date > t.filing_date
   ORDER BY e.earnings_date LIMIT 1 OFFSET 1) AS second_after
FROM (SELECT * FROM fx_transactions JOIN fx_companies USING (company_id)) t""")
def j08(t):
    rows = t.transactions.join(t.companies, "company_id").select("txn_id", "ticker", "filing_date")
    days = asof.nth_after(t.earnings.withColumnRenamed("earnings_date", "date"), k=2)
    found = asof.bracket(rows.select("ticker", F.col("filing_date").alias("as_of")), days,
                         values=["kth_date"], prev=False, strict=True)
    return asof.attach(rows, found, on="filing_date").select(
        "txn_id", F.col("next.date").alias("first_after"), F.col("next.kth_date").alias("second_after"))


@query("j09_other_insider_buys", """
SELECT b.txn_id, count(DISTINCT o.insider_id) AS other_insiders_before,
       count(o.txn_id) AS other_buys_before,
       (SELECT count(DISTINCT s.insider_id) FROM fx_transactions s WHERE s.is_discretionary
        AND s.company_id = b.company_id AND s.insider_id <> b.insider_id
        AND s.transaction_date BETWEEN b.transaction_date - 7 AND b.transaction_date + 7) AS other_insiders_around
FROM (SELECT * FROM fx_transactions WHERE is_discretionary) b
LEFT JOIN (SELECT * FROM fx_transactions WHERE is_discretionary) o
  ON o.company_id = b.company_id AND o.insider_id <> b.insider_id
 AND o.transaction_date BETWEEN b.transaction_date - 7 AND b.transaction_date
GROUP BY b.txn_id, b.company_id, b.insider_id, b.transaction_date""")
def j09(t):
    buys = t.transactions.where("is_discretionary").select(
        "txn_id", "insider_id", "company_id", "transaction_date")
    before = visible_members(buys, buys, before=7, after=0)
    around = visible_members(buys, buys, before=7, after=7).withColumnRenamed("n_members", "n_around")
    day = ["company_id", "transaction_date"]
    everyone = rows_in_window(buys, group=["company_id"], name="n_all")
    own = rows_in_window(buys, group=["company_id", "insider_id"], name="n_own")
    return (buys.join(before, day).join(around, day).join(everyone, day)
            .join(own, ["company_id", "insider_id", "transaction_date"])
            .select("txn_id", (F.col("n_members") - 1).alias("other_insiders_before"),
                    (F.col("n_all") - F.col("n_own")).alias("other_buys_before"),
                    (F.col("n_around") - 1).alias("other_insiders_around")))


@query("j10_csuite_sell_days", f"""
SELECT DISTINCT c.ticker, t.transaction_date AS date FROM fx_transactions t
JOIN fx_companies c USING (company_id) JOIN fx_roles r USING (insider_id, company_id)
WHERE t.transaction_code = 'S' AND {CSUITE_SQL}""")
def j10(t):
    return E.csuite_sell_days(t.transactions, t.companies, t.roles)


@query("j11_same_day_sell", """
SELECT t.txn_id, EXISTS (SELECT 1 FROM fx_transactions s WHERE s.transaction_code IN ('S', 'F')
  AND s.insider_id = t.insider_id AND s.company_id = t.company_id
  AND s.transaction_date = t.transaction_date) AS has_same_day_sell
FROM fx_transactions t WHERE t.is_discretionary""")
def j11(t):
    buys = t.transactions.where("is_discretionary")
    return E.mark_same_day_sells(buys, E.same_day_sells(t.transactions)).select("txn_id", "has_same_day_sell")


@query("j12_point_in_time_facts", """
SELECT txn_id, period_end, round(value, 2) AS revenues FROM (
  SELECT t.txn_id, f.period_end, f.value,
         row_number() OVER (PARTITION BY t.txn_id ORDER BY f.period_end DESC NULLS LAST, f.filed_date DESC) AS pick
  FROM fx_transactions t LEFT JOIN fx_fundamentals f
    ON f.company_id = t.company_id AND f.filed_date <= t.transaction_date AND f.concept = 'us-gaap:Revenues'
  WHERE t.is_discretionary) WHERE pick = 1""")
def j12(t):
    from insidertrail.operators.facts import facts_as_of

    buys = t.transactions.where("is_discretionary").select("txn_id", "company_id", "transaction_date")
    wide = facts_as_of(buys, t.fundamentals, {"us-gaap:Revenues": "revenues"})
    return buys.join(wide, ["company_id", "transaction_date"], "left").select(
        "txn_id", F.col("revenues.period_end").alias("period_end"),
        F.round("revenues.value", 2).alias("revenues"))


_CONCEPTS = {"us-gaap:Revenues": "revenues", "us-gaap:NetIncomeLoss": "income", "us-gaap:Assets": "assets"}
_FACTS_SQL = """
SELECT company_id, concept, period_end, filed_date, value FROM fx_fundamentals
UNION ALL SELECT company_id, 'us-gaap:NetIncomeLoss', period_end, filed_date + CAST(company_id % 40 AS INT), value * 3 FROM fx_fundamentals
UNION ALL SELECT company_id, 'us-gaap:Assets', period_end, filed_date + 3, value * 4 FROM fx_fundamentals
UNION ALL SELECT company_id, concept, period_end, filed_date + 100, value + 1 FROM fx_fundamentals"""


@query("j12_facts_in_one_merge", f"""
SELECT t.company_id, t.d AS transaction_date, f.concept, f.period_end, round(f.value, 2) AS value
FROM (SELECT DISTINCT company_id, transaction_date AS d FROM fx_transactions WHERE is_discretionary) t
JOIN ({_FACTS_SQL}) f ON f.company_id = t.company_id AND f.filed_date <= t.d
QUALIFY row_number() OVER (PARTITION BY t.company_id, t.d, f.concept ORDER BY f.period_end DESC, f.filed_date DESC) = 1""")
def j12_all(t):
    """Three concepts with different delays; each report is amended a hundred days later."""
    from insidertrail.operators.facts import facts_as_of

    facts = t.spark.sql(_FACTS_SQL.replace("FROM fx_fundamentals", "FROM {fx_fundamentals}"), fx_fundamentals=t.fundamentals)
    wide = facts_as_of(t.transactions.where("is_discretionary"), facts, _CONCEPTS)
    slots = F.array(*[F.struct(F.lit(c).alias("concept"), F.col(name).alias("fact")) for c, name in _CONCEPTS.items()])
    rows = wide.select("company_id", "transaction_date", F.explode(slots).alias("x")).where("x.fact is not null")
    return rows.select("company_id", "transaction_date", "x.concept", "x.fact.period_end", F.round("x.fact.value", 2).alias("value"))


@query("j13_short_pressure", """
SELECT e.accession_id, s.date AS pressure_date, round(s.short_volume / nullif(s.total_volume, 0), 6) AS short_ratio
FROM (SELECT accession_id, concat('T', CAST(company_id AS STRING)) AS ticker, CAST(filed_at AS DATE) AS d
      FROM fx_filing_stream WHERE transaction_code = 'P') e
ASOF LEFT JOIN fx_short_volume s ON s.ticker = e.ticker AND e.d > s.date""")
def j13(t):
    from insidertrail.operators.facts import short_pressure

    rows = t.filing_stream.where("transaction_code = 'P'").select(
        "accession_id", F.concat(F.lit("T"), F.col("company_id").cast("string")).alias("ticker"),
        F.col("filed_at").cast("date").alias("trade_date"))
    return short_pressure(rows, t.short_volume).select(
        "accession_id", "pressure_date", F.round("short_ratio", 6).alias("short_ratio"))


@query("j16_filing_event_context", """
SELECT t.txn_id,
  (SELECT min(e.filing_date) FROM ox_filing_events e WHERE e.company_id = t.company_id AND e.form_type = '8-K'
    AND e.items LIKE '%2.02%' AND e.filing_date > t.filed) AS next_results,
  (SELECT max(e.filing_date) FROM ox_filing_events e WHERE e.company_id = t.company_id AND e.form_type = 'SC 13D'
    AND e.filing_date <= t.filed) AS last_activist
FROM (SELECT accession_id AS txn_id, company_id, CAST(filed_at AS DATE) AS filed FROM fx_filing_stream
      WHERE transaction_code = 'P') t""")
def j16(t):
    from insidertrail.operators.facts import filing_event_context
    from insidertrail.plans.raw_inputs import filing_events

    rows = t.filing_stream.where("transaction_code = 'P'").select(
        F.col("accession_id").alias("txn_id"), "company_id", F.col("filed_at").cast("date").alias("filed"))
    return filing_event_context(rows, filing_events(t), on="filed").select(
        "txn_id", "next_results", "last_activist")


# --- lot collapse and outcomes ---------------------------------------------


@query("a01_collapse_lots", """
SELECT txn_id, insider_id, company_id, transaction_date, filing_date, ticker, shares,
       round(total_value, 2) AS total_value, round(price_per_share, 6) AS price_per_share, shares_owned_after,
       is_10b5_1_plan, round(excess_return_60d, 6) AS excess_return_60d, hit_60d FROM ox_buys""")
def a01(t):
    out = compute_buy_events(t).select("txn_id", "insider_id", "company_id", "transaction_date", "filing_date", "ticker",
                               "shares", "total_value", "price_per_share", "shares_owned_after",
                               "is_10b5_1_plan", "excess_return_60d", "hit_60d")
    return rounded(rounded(out, "price_per_share", "excess_return_60d"), "total_value", digits=2)


@query("a02_largest_lots", """
SELECT txn_id, insider_id, company_id, transaction_date, total_value,
       round(event_total_value, 2) AS event_total_value FROM (
  SELECT *, row_number() OVER w AS pick,
         sum(coalesce(total_value, 0)) OVER (PARTITION BY insider_id, company_id, transaction_date) AS event_total_value
  FROM fx_transactions WHERE is_discretionary
  WINDOW w AS (PARTITION BY insider_id, company_id, transaction_date
               ORDER BY coalesce(total_value, 0) DESC, txn_id)) WHERE pick = 1""")
def a02(t):
    out = E.largest_lots(t.transactions.where("is_discretionary"))
    return rounded(out.select("txn_id", "insider_id", "company_id", "transaction_date", "total_value",
                              "event_total_value"), "event_total_value", digits=2)


@query("a03_first_outcome_per_day", """
SELECT insider_id, transaction_date, txn_id, hit_60d, round(excess_return_60d, 6) AS excess_return_60d FROM (
  SELECT t.insider_id, t.transaction_date, t.txn_id, o.hit_60d, o.excess_return_60d,
         row_number() OVER (PARTITION BY t.insider_id, t.transaction_date ORDER BY t.txn_id) AS pick
  FROM fx_transactions t JOIN ox_outcomes o USING (txn_id)
  WHERE t.is_discretionary AND o.excess_return_60d IS NOT NULL) WHERE pick = 1""")
def a03(t):
    from insidertrail.operators.scores import cached_as_of_events

    out = cached_as_of_events(t.transactions, outcomes(t)).select(
        "insider_id", "transaction_date", "txn_id", "hit_60d", "excess_return_60d")
    return rounded(out, "excess_return_60d")


_OUTCOME_COLS = [f"{n}_{h}d" for h in (20, 60, 120)
                 for n in ("stock_return", "benchmark_return", "sector_return", "excess_return")]


@query("a14_trade_outcomes", "SELECT txn_id, round(prior_momentum_20d, 6) AS prior_momentum_20d, hit_20d, hit_60d, "
       "hit_120d, " + ", ".join(f"round({c}, 6) AS {c}" for c in _OUTCOME_COLS) + " FROM ox_outcomes")
def a14(t):
    out = compute_outcomes(t).select("txn_id", "prior_momentum_20d", "hit_20d", "hit_60d", "hit_120d", *_OUTCOME_COLS)
    return rounded(out, "prior_momentum_20d", *_OUTCOME_COLS)


# --- clusters, medians, holdings -------------------------------------------


@query("a15_cluster_flags", """
SELECT txn_id, cluster_size, is_cluster, CAST(cluster_role_diversity AS BIGINT) AS cluster_role_diversity,
       cluster_has_mixed_roles, cluster_has_ceo_and_cfo FROM ox_flagged""")
def a15(t):
    out = FL.with_cluster(buy_events(t), t.roles)
    return out.select("txn_id", *big("cluster_size"), "is_cluster", *big("cluster_role_diversity"),
                      "cluster_has_mixed_roles", "cluster_has_ceo_and_cfo")


@query("a15_cluster_flags_symmetric", """
SELECT b.txn_id, count(DISTINCT o.insider_id) AS cluster_size
FROM ox_buys b JOIN ox_buys o ON o.company_id = b.company_id
 AND o.transaction_date BETWEEN b.transaction_date - 7 AND b.transaction_date + 7 GROUP BY b.txn_id""")
def a15_symmetric(t):
    out = FL.with_cluster(buy_events(t), t.roles, causal=False)
    return out.select("txn_id", *big("cluster_size"))


@query("a16_live_cluster_counts", """
SELECT t.txn_id,
  (SELECT count(DISTINCT o.insider_id) FROM fx_transactions o JOIN fx_insiders i USING (insider_id)
   WHERE NOT i.is_institution AND o.is_discretionary AND o.company_id = t.company_id
     AND o.transaction_date BETWEEN t.transaction_date - 7 AND t.transaction_date + 7) AS unique_buyers,
  (SELECT count(DISTINCT o.insider_id) FROM fx_transactions o JOIN fx_insiders i USING (insider_id)
   WHERE NOT i.is_institution AND o.transaction_code = 'S' AND o.company_id = t.company_id
     AND o.transaction_date BETWEEN t.transaction_date - 7 AND t.transaction_date + 7) AS unique_sellers
FROM fx_transactions t""")
def a16(t):
    from insidertrail.operators.signals import live_cluster_counts

    return (t.transactions.join(live_cluster_counts(t.transactions, t.insiders),
                                ["company_id", "transaction_date"])
            .select("txn_id", *big("unique_buyers", "unique_sellers")))


@query("a17_median_buy_value", """
SELECT insider_id, round(day_value, 2) AS median_value FROM (
  SELECT insider_id, day_value, row_number() OVER (PARTITION BY insider_id ORDER BY day_value, transaction_date) AS i,
         count(*) OVER (PARTITION BY insider_id) AS n
  FROM (SELECT insider_id, transaction_date, sum(total_value) AS day_value FROM fx_transactions
        WHERE is_discretionary AND total_value > 0 GROUP BY 1, 2)) WHERE i = n // 2 + 1""")
def a17(t):
    return rounded(E.median_buy_value(t.transactions), "median_value", digits=2)


@query("a18_same_day_total", """
SELECT t.txn_id, round(coalesce(nullif(s.total, 0), nullif(t.total_value, 0),
                                t.shares * coalesce(t.price_per_share, 0)), 2) AS txn_value
FROM fx_transactions t LEFT JOIN (
  SELECT insider_id, company_id, transaction_date, sum(total_value) AS total FROM fx_transactions
  WHERE is_discretionary AND total_value IS NOT NULL GROUP BY 1, 2, 3) s
USING (insider_id, company_id, transaction_date) WHERE t.is_discretionary""")
def a18(t):
    totals = E.event_value(t.transactions, F.col("is_discretionary"))
    return (t.transactions.where("is_discretionary").join(totals, E.EVENT_KEY, "left")
            .select("txn_id", F.round(E.event_value_or_fallback(), 2).alias("txn_value")))


@query("a19_sold_fraction", """
SELECT insider_id, company_id, transaction_date,
       round(sum(shares) / (arg_max(shares_owned_after, txn_id) + sum(shares)), 6) AS sell_pct
FROM fx_transactions WHERE transaction_code = 'S' GROUP BY 1, 2, 3""")
def a19(t):
    return rounded(E.sold_fraction(t.transactions), "sell_pct")


@query("a28_volume_quintile", """
SELECT txn_id, CAST(liquidity_quintile AS DOUBLE) AS liquidity_quintile FROM ox_flagged""")
def a28(t):
    return FL.with_liquidity_quintile(FL.with_price_flags(buy_events(t), t.prices)).select(
        "txn_id", "liquidity_quintile")


@query("a28_exact_quantile_edges", """
SELECT count(o_totalprice) AS n, round(quantile_cont(o_totalprice, 0.2), 6) AS q20,
       round(quantile_cont(o_totalprice, 0.5), 6) AS q50, round(quantile_cont(o_totalprice, 0.99), 6) AS q99
FROM orders""")
def a28_edges(t):
    e = exact_quantiles(t.base("orders"), "o_totalprice", [0.2, 0.5, 0.99])
    return e.select("n", *[F.round(F.col("edges")[i], 6).alias(name) for i, name in enumerate(["q20", "q50", "q99"])])


# --- window features --------------------------------------------------------

_BUYS_SQL = """(SELECT b.*, p.ret_60, p.ret_5, p.avg_volume_20d AS av FROM
 (SELECT t.txn_id, t.transaction_date, c.ticker FROM fx_transactions t JOIN fx_companies c USING (company_id)
  WHERE is_discretionary) b
 ASOF LEFT JOIN ox_panel p ON b.ticker = p.ticker AND b.transaction_date >= p.date)"""


def _buys(t):
    return (t.transactions.where("is_discretionary").join(t.companies, "company_id")
            .select("txn_id", "ticker", "transaction_date", "filing_date"))


@query("w01_prior_return_60", f"""
SELECT txn_id, round(ret_60, 6) AS prior_return_60td, coalesce(ret_60 <= -0.15, false) AS drawdown_flag,
       CASE WHEN ret_60 <= -0.40 THEN 'crash' WHEN ret_60 <= -0.25 THEN 'severe' WHEN ret_60 <= -0.15 THEN 'moderate_dd'
            WHEN ret_60 <= -0.05 THEN 'moderate_dip' WHEN ret_60 <= 0.10 THEN 'neutral'
            WHEN ret_60 IS NOT NULL THEN 'strength' END AS drawdown_severity FROM {_BUYS_SQL}""")
def w01(t):
    out = FL.with_price_flags(_buys(t), t.prices)
    return rounded(out.select("txn_id", "prior_return_60td", "drawdown_flag", "drawdown_severity"),
                   "prior_return_60td")


@query("w02_short_momentum", f"""
SELECT txn_id, round(ret_5, 6) AS short_momentum_5d,
       coalesce(ret_60 <= -0.15 AND ret_5 < 0, false) AS still_falling FROM {_BUYS_SQL}""")
def w02(t):
    out = FL.with_price_flags(_buys(t), t.prices)
    return rounded(out.select("txn_id", "short_momentum_5d", "still_falling"), "short_momentum_5d")


@query("w03_trailing_volume", f"SELECT txn_id, round(av, 4) AS avg_volume_20d FROM {_BUYS_SQL}")
def w03(t):
    out = FL.with_price_flags(_buys(t), t.prices)
    return rounded(out.select("txn_id", "avg_volume_20d"), "avg_volume_20d", digits=4)


@query("w04_realized_vol", """
SELECT b.txn_id, round(p.realized_vol, 6) AS realized_vol FROM
 (SELECT t.txn_id, t.filing_date, c.ticker FROM fx_transactions t JOIN fx_companies c USING (company_id)
  WHERE is_discretionary) b ASOF LEFT JOIN ox_panel p ON b.ticker = p.ticker AND b.filing_date > p.date""")
def w04(t):
    buys = _buys(t)
    found = asof.bracket(buys.select("ticker", F.col("filing_date").alias("as_of")), P.price_panel(t.prices),
                         values=["realized_vol"], next=False, strict=True)
    return asof.attach(buys, found, on="filing_date").select(
        "txn_id", F.round("prev.realized_vol", 6).alias("realized_vol"))


@query("w05_drawdown_52w", """
SELECT b.txn_id, round((b.adj_close - p.high_52w) / p.high_52w, 6) AS drawdown_52w FROM
 (SELECT e.txn_id, e.ticker, q.date AS entry_date, q.adj_close FROM
   (SELECT t.txn_id, t.filing_date, c.ticker FROM fx_transactions t JOIN fx_companies c USING (company_id)
    WHERE is_discretionary) e ASOF JOIN fx_prices q ON q.ticker = e.ticker AND e.filing_date <= q.date) b
 JOIN ox_panel p ON p.ticker = b.ticker AND p.date = b.entry_date""")
def w05(t):
    buys = _buys(t)
    # The entry day is itself a price row, so its trailing high comes with it.
    found = asof.bracket(buys.select("ticker", F.col("filing_date").alias("as_of")), P.price_panel(t.prices),
                         values=["adj_close", "high_52w"], prev=False)
    dd = (F.col("next.adj_close") - F.col("next.high_52w")) / F.col("next.high_52w")
    return (asof.attach(buys, found, on="filing_date").where(F.col("next").isNotNull())
            .select("txn_id", F.round(dd, 6).alias("drawdown_52w")))


@query("w06_prior_momentum", """
SELECT ticker, d AS as_of, round(prior_momentum_20d, 6) AS prior_momentum_20d FROM ox_momentum""")
def w06(t):
    asked = _buys(t).select("ticker", F.col("transaction_date").alias("as_of"))
    out = prior_momentum(asked, t.prices)
    # Days without a single price in the look-back have no row on the other side.
    seen = asof.bracket(asked, t.prices.select("ticker", "date"), values=[], next=False, strict=True)
    has = seen.where(F.datediff("as_of", "prev.date") <= 40).select("ticker", "as_of")
    return rounded(out.join(has, ["ticker", "as_of"], "left_semi"), "prior_momentum_20d")


@query("w07_routine_insiders", """
SELECT CAST(insider_id AS INT) AS insider_id FROM ox_routine""")
def w07(t):
    return FL.routine_insiders(buy_events(t))


@query("w08_first_buy", """
SELECT txn_id, is_first_buy, CAST(tenure_days AS BIGINT) AS tenure_days, first_time_conviction FROM ox_flagged""")
def w08(t):
    return FL.with_first_buy(buy_events(t), t.roles).select(
        "txn_id", "is_first_buy", *big("tenure_days"), "first_time_conviction")


@query("w13_volume_percentiles", """
SELECT ticker, date, round(adv_dollar_20d, 6) AS adv_dollar_20d,
       round(CASE WHEN realized_vol IS NOT NULL THEN
         percent_rank() OVER (PARTITION BY date, realized_vol IS NULL ORDER BY realized_vol) END, 6) AS vol_pctile,
       round(CASE WHEN adv_dollar_20d IS NOT NULL THEN
         percent_rank() OVER (PARTITION BY date, adv_dollar_20d IS NULL ORDER BY adv_dollar_20d) END, 6) AS adv_pctile
FROM ox_panel""")
def w13(t):
    out = P.cross_section_percentiles(P.price_panel(t.prices))
    return rounded(out.select("ticker", "date", "adv_dollar_20d", "vol_pctile", "adv_pctile"),
                   "vol_pctile", "adv_pctile", "adv_dollar_20d")


@query("b01_flagged_buys", """
SELECT txn_id, ticker, role_title, cluster_size, is_cluster, is_first_buy, first_time_conviction, is_routine,
       drawdown_flag, still_falling, round(prior_return_60td, 6) AS prior_return_60td,
       CAST(filing_lag_days AS BIGINT) AS filing_lag_days, CAST(liquidity_quintile AS DOUBLE) AS liquidity_quintile
FROM ox_flagged""")
def b01(t):
    out = compute_flagged(t).select(
        "txn_id", "ticker", "role_title", *big("cluster_size"), "is_cluster", "is_first_buy",
        "first_time_conviction", "is_routine", "drawdown_flag", "still_falling", "prior_return_60td",
        *big("filing_lag_days"), "liquidity_quintile")
    return rounded(out, "prior_return_60td")


@query("k08_distinct_sells", """
SELECT DISTINCT insider_id, company_id, transaction_date FROM fx_transactions WHERE transaction_code IN ('S', 'F')""")
def k08(t):
    return E.same_day_sells(t.transactions)
