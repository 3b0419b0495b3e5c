"""Queries on insider scores, as-of scores, live features, signals and alerts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from insidertrail.operators import asof, prices as P, scores as SC, signals as G
from insidertrail.plans.helpers import daily_prices, firms, flagged, outcomes, people, rounded, scores, titles
from insidertrail.plans.oracle_views import ORACLE_VIEWS, RECORD_SQL, normal_cdf_sql
from insidertrail.plans.registry import query

# --- track records and scores ----------------------------------------------


def _events(t, **kwargs):
    return SC.scored_events(t.transactions, outcomes(t), **kwargs)


_RECORD_OUT = """n, hits, round(mean_y, 6) AS avg_excess_return, round(sum_y, 6) AS sum_excess_return,
       round(std_y, 6) AS std_excess_return, round(icpt, 6) AS momentum_intercept"""


def _record_out(df, *keys):
    return rounded(df.select(*keys, "n", "hits", "avg_excess_return", "sum_excess_return", "std_excess_return",
                             "momentum_intercept"),
                   "avg_excess_return", "sum_excess_return", "std_excess_return", "momentum_intercept")


@query("a04_track_record", f"SELECT insider_id, {_RECORD_OUT} FROM ox_records")
def a04(t):
    return _record_out(SC.track_records(_events(t)), "insider_id")


@query("a04_track_record_by_company", f"""
SELECT insider_id, company_id, {_RECORD_OUT} FROM (SELECT insider_id, company_id, {RECORD_SQL} FROM ox_events
GROUP BY GROUPING SETS ((insider_id), (insider_id, company_id)))""")
def a04_company(t):
    return _record_out(SC.track_records(_events(t), by_company=True), "insider_id", "company_id")


def _score_query(name, column, digits=6):
    is_text = column == "tier"
    out = column if is_text else f"round({column}, {digits}) AS {column}"

    @query(name, f"SELECT insider_id, {out} FROM ox_scores")
    def run(t):
        df = SC.score_columns(SC.track_records(_events(t)).join(
            t.insiders.where("NOT is_institution").select("insider_id"), "insider_id", "left_semi"))
        everyone = (t.transactions.where("is_discretionary").select("insider_id").distinct()
                    .join(t.insiders.where("NOT is_institution").select("insider_id"), "insider_id", "left_semi"))
        df = everyone.join(df, "insider_id", "left")
        if is_text:
            return df.select("insider_id", F.coalesce(column, F.lit("Insufficient")).alias(column))
        if column in ("skill_score", "credibility_weight"):
            df = df.withColumn(column, F.coalesce(column, F.lit(0.0)))
        return df.select("insider_id", F.round(column, digits).alias(column))

    return run


_score_query("a05_posterior_hit_rate", "bayesian_hit_rate")
_score_query("a06_confidence", "confidence")
_score_query("a07_shrunk_excess", "shrunk_excess")
_score_query("a07_shrinkage_sigma", "sigma")
_score_query("a08_momentum_adjusted", "momentum_adjusted_excess")
_score_query("a09_credibility", "credibility_weight")
_score_query("a10_skill_score", "skill_score")
_score_query("a11_tier", "tier")

_SCORE_NUM = ["raw_hit_rate", "bayesian_hit_rate", "confidence", "avg_excess_return", "shrunk_excess",
              "momentum_adjusted_excess", "credibility_weight", "skill_score"]
_SCORE_OUT = "n, hits, tier, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SCORE_NUM)


@query("a12_score_refresh", f"SELECT insider_id, {_SCORE_OUT} FROM ox_scores")
def a12(t):
    df = SC.insider_scores(t.transactions, outcomes(t), t.insiders)
    return rounded(df.select("insider_id", "n", "hits", "tier", *_SCORE_NUM), *_SCORE_NUM)


@query("a12_company_scores", f"SELECT insider_id, company_id, {_SCORE_OUT} FROM ox_company_scores")
def a12_company(t):
    df = SC.company_scores(t.transactions, outcomes(t), t.insiders)
    return rounded(df.select("insider_id", "company_id", "n", "hits", "tier", *_SCORE_NUM), *_SCORE_NUM)


@query("a07_prob_positive", f"""
SELECT insider_id, round(CASE WHEN n >= 3 THEN {normal_cdf_sql("(shrunk_excess * sqrt(5 + n) / sigma)")} END, 6) AS prob_positive
FROM ox_scores""")
def a07_positive(t):
    df = SC.insider_scores(t.transactions, outcomes(t), t.insiders)
    return rounded(df.select("insider_id", SC.prob_positive(F.col("shrunk_excess"), F.col("sigma"), F.col("n"))
                             .alias("prob_positive")), "prob_positive")


def _requests(t):
    return t.transactions.where("is_discretionary").select(
        "insider_id", F.col("transaction_date").alias("as_of"))


def as_of_cached(t):
    """As-of scores of every buy day, written once per application."""
    return t.stage("as_of_scores", lambda: SC.as_of_scores(
        _requests(t), SC.cached_as_of_events(t.transactions, outcomes(t))))


@query("a13_as_of_score", f"SELECT insider_id, as_of, {_SCORE_OUT} FROM ox_asof_cached")
def a13(t):
    df = SC.as_of_scores(_requests(t), SC.cached_as_of_events(t.transactions, outcomes(t)))
    return rounded(df.select("insider_id", "as_of", "n", "hits", "tier", *_SCORE_NUM), *_SCORE_NUM)


@query("a13_as_of_score_by_event", f"SELECT insider_id, as_of, {_SCORE_OUT} FROM ox_asof_direct")
def a13_direct(t):
    df = SC.as_of_scores(_requests(t), _events(t, common_only=False))
    return rounded(df.select("insider_id", "as_of", "n", "hits", "tier", *_SCORE_NUM), *_SCORE_NUM)


@query("a13_as_of_score_matured_only", f"SELECT insider_id, as_of, {_SCORE_OUT} FROM ox_asof_matured")
def a13_matured(t):
    """Strictly causal form: an outcome counts once its 60-day price is known."""
    events = SC.cached_as_of_events(t.transactions, outcomes(t)).join(
        outcomes(t).select("txn_id", "matured_on"), "txn_id")
    df = SC.as_of_scores(_requests(t), events, axis="matured_on")
    return rounded(df.select("insider_id", "as_of", "n", "hits", "tier", *_SCORE_NUM), *_SCORE_NUM)


@query("w09_running_record", "SELECT insider_id, as_of, n, hits, "
       "round(CASE WHEN n >= 3 THEN mean_y END, 6) AS avg_excess_return FROM ox_asof_cached_input")
def w09(t):
    return rounded(as_of_cached(t).select("insider_id", "as_of", "n", "hits", "avg_excess_return"),
                   "avg_excess_return")


@query("w14_rebased_benchmark", """
SELECT e.date, round(e.equity, 2) AS equity, round(first_equity * coalesce(b.adj_close, a.anchor) / a.anchor, 2) AS benchmark
FROM (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS equity,
             first_value(sum(o_totalprice)) OVER (ORDER BY CAST(o_orderdate AS DATE)) AS first_equity
      FROM orders GROUP BY 1) e
CROSS JOIN (SELECT arg_min(adj_close, date) AS anchor FROM fx_prices WHERE ticker = 'SPY'
            AND date BETWEEN (SELECT min(CAST(o_orderdate AS DATE)) FROM orders)
                         AND (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) a
ASOF LEFT JOIN (SELECT date, adj_close FROM fx_prices WHERE ticker = 'SPY'
            AND date >= (SELECT min(CAST(o_orderdate AS DATE)) FROM orders)) b ON e.date >= b.date""")
def w14(t):
    equity = t.base("orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        F.sum("o_totalprice").alias("equity"))
    return P.rebased_benchmark(equity, t.prices.where("ticker = 'SPY'"))


# --- footnote rollup --------------------------------------------------------


@query("a20_footnote_rollup", """
SELECT accession_number, bool_or(plan AND NOT neg) AS fn_plan, bool_or(neg) AS fn_plan_negated,
  bool_or(drip OR k401 OR espp) AS fn_mechanical,
  concat_ws(',', CASE WHEN bool_or(drip) THEN 'drip' END, CASE WHEN bool_or(espp) THEN 'espp' END,
            CASE WHEN bool_or(k401) THEN 'retirement_401k' END) AS fn_mechanical_kinds
FROM (SELECT concat('F', CAST(substr(accession_number, 2) AS BIGINT) // 3) AS accession_number,
  regexp_matches(text, '(?i)10b5-?1') AS plan,
  regexp_matches(text, '(?i)(?:not|other\\s+than)[^.]{0,80}?(?:pursuant\\s+to|under)[^.]{0,40}?10b5-?1') AS neg,
  regexp_matches(text, '(?i)dividend\\s+reinvestment') AS drip, regexp_matches(text, '(?i)401\\s*\\(\\s*k\\s*\\)') AS k401,
  regexp_matches(text, '(?i)employee\\s+stock\\s+purchase\\s+plan') AS espp FROM fx_footnotes) GROUP BY accession_number""")
def a20(t):
    from insidertrail.operators.footnotes import filing_rollup

    notes = t.footnotes.withColumn("accession_number", F.concat(F.lit("F"), F.floor(
        F.substring("accession_number", 2, 20).cast("bigint") / 3).cast("string")))
    return filing_rollup(notes).withColumn("fn_mechanical_kinds", F.concat_ws(",", "fn_mechanical_kinds"))


# --- signals ----------------------------------------------------------------


_PLAN = "NOT coalesce(is_10b5_1_plan, false)"


def _signal_query(name, signal, build, condition):
    """``build`` makes the strategy's columns and so runs only once a session exists."""

    @query(name, f"SELECT txn_id, CASE WHEN {condition} THEN '{signal}' ELSE 'filtered_out' END AS signal_type "
                 "FROM ox_flagged")
    def run(t):
        return G.classify_flagged(flagged(t), build()).select("txn_id", "signal_type")


_signal_query("g01_cluster_buy", "cluster_buy", G.cluster_buy, "cluster_size >= 2 AND total_value >= 25000")
_signal_query("g02_big_exec_buy", "big_exec_buy", G.big_exec_buy,
              f"role_title IN ('Chief Executive Officer', 'CFO') AND total_value >= 100000 AND {_PLAN}")
_signal_query("g03_opportunistic_first_buy", "opportunistic_first_buy", G.opportunistic_first_buy,
              f"is_first_buy AND total_value >= 25000 AND {_PLAN}")


@query("g04_signal_registry", """
SELECT signal_type, count(*) AS n, signal_type <> 'filtered_out' AS tradeable, 'buy' AS direction,
       signal_type <> 'filtered_out' AS visible FROM (
  SELECT CASE WHEN cluster_size >= 2 AND total_value >= 25000 THEN 'cluster_buy' ELSE 'filtered_out' END AS signal_type
  FROM ox_flagged) GROUP BY signal_type""")
def g04(t):
    strategy = G.cluster_buy()
    counts = G.classify_flagged(flagged(t), strategy).groupBy("signal_type").agg(F.count(F.lit(1)).alias("n"))
    types = strategy.registry(t.spark).withColumnRenamed("name", "signal_type")
    return counts.join(types, "signal_type").select("signal_type", "n", "tradeable", "direction", "visible")


def live_strategy():
    return replace(G.cluster_buy(), conviction=F.col("txn_value") / 100_000)


def _live(t):
    return (t.transactions, people(t), firms(t), titles(t), daily_prices(t), scores(t))


def alerts(t):
    """Buy alerts with ids, written once per application."""
    return t.stage("alerts", lambda: G.buy_alerts(live_strategy(), *_live(t)))


@query("g05_live_features", """
SELECT t.txn_id, round(CASE WHEN f.ret_60 <= -0.15 THEN f.ret_60 END, 6) AS prior_return_60td,
  coalesce(f.ret_60 <= -0.15 AND f.ret_5 < 0, false) AS still_falling, coalesce(p.unique_buyers, 0) AS cluster_unique_insiders,
  (SELECT count(DISTINCT o.insider_id) FROM fx_transactions o JOIN fx_insiders i USING (insider_id)
   WHERE NOT i.is_institution AND o.transaction_code = 'S' AND o.company_id = t.company_id
     AND o.transaction_date BETWEEN t.transaction_date - 7 AND t.transaction_date + 7) AS cluster_sell_unique,
  NOT EXISTS (SELECT 1 FROM fx_transactions o WHERE o.insider_id = t.insider_id AND o.is_discretionary
     AND coalesce(o.is_common_stock, true) AND o.txn_id <> t.txn_id
     AND (o.transaction_date < t.transaction_date OR (o.transaction_date = t.transaction_date AND o.txn_id < t.txn_id)))
    AS is_first_buy,
  NOT EXISTS (SELECT 1 FROM fx_transactions o WHERE o.insider_id = t.insider_id AND o.company_id = t.company_id
     AND o.is_discretionary AND o.txn_id <> t.txn_id)
    AND (t.transaction_date - r.first_filing_date) / 365.25 >= 2 AS is_first_time,
  coalesce(t.is_10b5_1_plan, false) AS is_10b5_1_plan, r.role_title, s.tier, coalesce(k.peers, 0) AS peers_scored,
  round(coalesce(k.total, 0), 6) AS peer_skill_sum
FROM fx_transactions t
JOIN fx_roles r USING (insider_id, company_id)
LEFT JOIN ox_peers p ON p.company_id = t.company_id AND p.transaction_date = t.transaction_date
LEFT JOIN (SELECT insider_id, tier FROM ox_scores UNION ALL
           SELECT insider_id, 'Insufficient' FROM fx_insiders WHERE is_institution) s ON s.insider_id = t.insider_id
LEFT JOIN (SELECT company_id, transaction_date, count(s.insider_id) AS peers,
             coalesce(sum(s.skill_score), 0) AS total FROM (
             SELECT DISTINCT d.company_id, d.transaction_date, m.insider_id
             FROM (SELECT DISTINCT company_id, transaction_date FROM fx_transactions) d
             JOIN (SELECT x.* FROM fx_transactions x JOIN fx_insiders i USING (insider_id)
                   WHERE x.is_discretionary AND NOT i.is_institution) m
               ON m.company_id = d.company_id
              AND m.transaction_date BETWEEN d.transaction_date - 7 AND d.transaction_date + 7) g
           LEFT JOIN ox_scores s USING (insider_id) GROUP BY 1, 2) k
  ON k.company_id = t.company_id AND k.transaction_date = t.transaction_date
JOIN (SELECT t.txn_id, p.ret_60, p.ret_5 FROM
        (SELECT x.txn_id, x.transaction_date, concat('T', x.company_id) AS ticker FROM fx_transactions x) t
      ASOF LEFT JOIN ox_panel p ON p.ticker = t.ticker AND t.transaction_date >= p.date) f ON f.txn_id = t.txn_id
WHERE t.is_discretionary""")
def g05(t):
    rows = t.transactions.where("is_discretionary")
    out = G.live_features(rows, *_live(t)).select(
        "txn_id", "prior_return_60td", "still_falling", F.col("cluster_unique_insiders").cast("bigint"),
        F.col("cluster_sell_unique").cast("bigint"), "is_first_buy", "is_first_time", "is_10b5_1_plan", "role_title",
        "tier", F.coalesce("peers_scored", F.lit(0)).cast("bigint").alias("peers_scored"),
        F.coalesce("peer_skill_sum", F.lit(0.0)).alias("peer_skill_sum"))
    return rounded(out, "prior_return_60td", "peer_skill_sum")


_ALERT_OUT = """transaction_id, insider_id, company_id, alert_type, round(conviction_score, 8) AS conviction_score,
  round(insider_skill_score, 6) AS insider_skill_score, round(transaction_value, 2) AS transaction_value, trade_date"""


def _alert_out(df):
    cols = ["transaction_id", "insider_id", "company_id", "alert_type", "conviction_score", "insider_skill_score",
            "transaction_value", "trade_date"]
    out = rounded(rounded(df.select(*cols), "insider_skill_score"), "conviction_score", digits=8)
    return rounded(out, "transaction_value", digits=2)


@query("g06_buy_alerts", f"SELECT {_ALERT_OUT} FROM ox_alerts")
def g06(t):
    return _alert_out(G.buy_alerts(live_strategy(), *_live(t)))


@query("g06_buy_alerts_pending", f"SELECT {_ALERT_OUT} FROM ox_alerts WHERE trade_date >= DATE '1999-01-01' "
       "AND insider_id % 2 = 1")
def g06_pending(t):
    """Only events without an alert; here the even insiders already have theirs."""
    done = alerts(t).where("insider_id % 2 = 0")
    return _alert_out(G.buy_alerts(live_strategy(), *_live(t), existing=done, since=F.lit("1999-01-01").cast("date")))


ORACLE_VIEWS["ox_sell_alerts"] = """
SELECT transaction_id, insider_id, company_id, alert_type, round(txn_value, 2) AS transaction_value, trade_date FROM (
  SELECT e.txn_id AS transaction_id, insider_id, company_id, transaction_date AS trade_date, txn_value,
    CASE WHEN sold / (after + sold) >= 0.25 THEN 'large_sell' WHEN sellers >= 8 THEN 'cluster_sell' END AS alert_type
  FROM (SELECT t.insider_id, t.company_id, t.transaction_date,
          min(t.txn_id) FILTER (coalesce(t.is_common_stock, true)) AS txn_id, sum(t.total_value) AS txn_value,
          sum(t.shares) AS sold, arg_max(t.shares_owned_after, t.txn_id) AS after
        FROM fx_transactions t JOIN fx_insiders i USING (insider_id)
        WHERE t.transaction_code = 'S' AND NOT i.is_institution GROUP BY 1, 2, 3) e
  JOIN (SELECT d.company_id, d.transaction_date, count(DISTINCT m.insider_id) AS sellers
        FROM (SELECT DISTINCT company_id, transaction_date FROM fx_transactions) d
        JOIN (SELECT x.* FROM fx_transactions x JOIN fx_insiders i USING (insider_id)
              WHERE x.transaction_code = 'S' AND NOT i.is_institution) m
          ON m.company_id = d.company_id AND m.transaction_date BETWEEN d.transaction_date - 7 AND d.transaction_date + 7
        GROUP BY 1, 2) k USING (company_id, transaction_date)
  WHERE e.txn_id IS NOT NULL) WHERE alert_type IS NOT NULL"""


@query("g07_sell_alerts", "SELECT * FROM ox_sell_alerts")
def g07(t):
    out = sell_alerts(t).select(
        "transaction_id", "insider_id", "company_id", "alert_type", "transaction_value", "trade_date")
    return rounded(out, "transaction_value", digits=2)


SELLS = ["large_sell", "cluster_sell"]


def sell_alerts(t):
    """Sell alerts, written once per application."""
    return t.stage("sell_alerts", lambda: compute_sell_alerts(t))


def compute_sell_alerts(t):
    kind = F.when(F.col("sell_pct") >= 0.25, "large_sell").when(F.col("cluster_sell_unique") >= 8, "cluster_sell")
    strategy = replace(live_strategy(), evaluate_sell=kind, types=(
        G.SignalType("large_sell", direction="sell"), G.SignalType("cluster_sell", direction="sell")))
    return G.sell_alerts(strategy, *_live(t))


@query("g08_position_size", """
SELECT f.txn_id, round(0.05 * CASE WHEN f.liquidity_quintile <= 2 THEN 1.25::DOUBLE ELSE 1 END
         * CASE WHEN f.cluster_has_mixed_roles THEN 1.15::DOUBLE ELSE 1 END, 6) AS position_pct,
       round(CASE WHEN p.adv_dollar_20d > 0 THEN least(0.05 * CASE WHEN f.liquidity_quintile <= 2 THEN 1.25::DOUBLE ELSE 1 END
         * CASE WHEN f.cluster_has_mixed_roles THEN 1.15::DOUBLE ELSE 1 END * 1000000, 0.5 * p.adv_dollar_20d)
         ELSE 0.05 * CASE WHEN f.liquidity_quintile <= 2 THEN 1.25::DOUBLE ELSE 1 END
         * CASE WHEN f.cluster_has_mixed_roles THEN 1.15::DOUBLE ELSE 1 END * 1000000 END, 6) AS position_dollars
FROM ox_flagged f ASOF LEFT JOIN ox_panel p ON p.ticker = f.ticker AND f.transaction_date >= p.date""")
def g08(t):
    buys = flagged(t)
    found = asof.bracket(buys.select("ticker", F.col("transaction_date").alias("as_of")), P.price_panel(t.prices),
                         values=["adv_dollar_20d"], next=False)
    rows = asof.attach(buys, found, on="transaction_date").withColumn("adv_dollar_20d", F.col("prev.adv_dollar_20d"))
    size = G.position_size(1_000_000.0, liquidity=True, mixed_roles=True, adv_cap_pct=0.5)
    return rows.select("txn_id", F.round(size["position_pct"], 6).alias("position_pct"),
                       F.round(size["position_dollars"], 6).alias("position_dollars"))


@query("g09_person_alerts", f"SELECT {_ALERT_OUT} FROM ox_alerts WHERE alert_type <> 'filtered_out' "
       "AND trade_date >= DATE '2000-01-01'")
def g09(t):
    return _alert_out(G.person_alerts(alerts(t), t.transactions, people(t), hidden=["filtered_out"],
                                      since=F.lit("2000-01-01").cast("date")))
