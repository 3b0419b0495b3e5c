"""Queries on feeds, pages, health checks and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from insidertrail.operators import events as E, prices as P, reports as V, signals as G
from insidertrail.plans.helpers import outcomes, people, rounded, scores
from insidertrail.plans.registry import query
from insidertrail.plans.scores_and_signals import SELLS, alerts, sell_alerts
from insidertrail.plans.oracle_views import ORACLE_VIEWS

TODAY = "2001-07-30"
BUY = ["cluster_buy"]


def _day(text=TODAY):
    return F.lit(text).cast("date")


def _enriched(t):
    return G.enrich_alerts(alerts(t), t.insiders, t.companies, scores(t), t.roles)


ORACLE_VIEWS["ox_top"] = """
SELECT transaction_id, conviction_score AS c FROM ox_alerts
WHERE alert_type <> 'filtered_out' AND trade_date >= DATE '2000-07-30' ORDER BY conviction_score DESC, transaction_id LIMIT 50"""
ORACLE_VIEWS["ox_enriched"] = """
SELECT a.*, i.name AS insider_name, coalesce(s.tier, 'Insufficient') AS tier, coalesce(r.role_title, 'Other') AS role_title
FROM ox_alerts a LEFT JOIN fx_insiders i USING (insider_id) LEFT JOIN ox_scores s USING (insider_id)
LEFT JOIN fx_roles r ON r.insider_id = a.insider_id AND r.company_id = a.company_id"""


@query("j14_enriched_alerts", """
SELECT transaction_id, alert_type, insider_name, ticker, tier, role_title FROM ox_enriched""")
def j14(t):
    return _enriched(t).select("transaction_id", "alert_type", "insider_name", "ticker", "tier", "role_title")


@query("j15_elite_alerts", """
SELECT transaction_id, insider_id FROM ox_alerts WHERE insider_id IN (SELECT insider_id FROM ox_scores WHERE tier = 'Elite')
UNION ALL SELECT transaction_id, -1 FROM ox_alerts WHERE insider_id IN (SELECT insider_id FROM ox_scores WHERE tier = 'Strong')""")
def j15(t):
    elite = V.elite_only(alerts(t), scores(t)).select("transaction_id", "insider_id")
    strong = alerts(t).join(scores(t).where("tier = 'Strong'").select("insider_id"), "insider_id", "left_semi")
    return elite.unionByName(strong.select("transaction_id", F.lit(-1).alias("insider_id")))


@query("a21_weekly_clusters", """
SELECT company_id, concat(isoyear(transaction_date), '-W', lpad(CAST(week(transaction_date) AS VARCHAR), 2, '0')) AS week,
  count(DISTINCT insider_id) AS num_insiders, count(*) AS num_trades, round(sum(total_value), 2) AS total_value
FROM fx_transactions WHERE is_discretionary AND coalesce(is_common_stock, true) AND transaction_date >= DATE '1996-12-01'
GROUP BY 1, 2 HAVING count(DISTINCT insider_id) >= 2""")
def a21(t):
    buys = t.transactions.where(F.col("is_discretionary") & E.common_or_unknown())
    return rounded(V.weekly_clusters(buys, since=_day("1996-12-01")), "total_value", digits=2)


@query("a22_scorecards", """
SELECT bucket, count(*) AS total_signals, round(avg(CASE WHEN hit_60d THEN 1.0::DOUBLE WHEN NOT hit_60d THEN 0 END), 6) AS hit_rate_60d,
  round(avg(excess_return_60d), 6) AS avg_excess_60d FROM (
  SELECT o.hit_60d, o.excess_return_60d, unnest(['all', CASE WHEN role_title IN ('Chief Executive Officer', 'CFO')
           THEN 'csuite' ELSE 'other' END]) AS bucket
  FROM ox_enriched a JOIN ox_outcomes o ON o.txn_id = a.transaction_id
  WHERE alert_type = 'cluster_buy' AND trade_date >= DATE '1999-07-30') GROUP BY bucket""")
def a22(t):
    out = V.scorecards(alerts(t), outcomes(t), t.roles, tradeable=BUY, since=_day("1999-07-30"))
    return rounded(out, "hit_rate_60d", "avg_excess_60d")


@query("a23_current_drawdown", """
SELECT ticker, round(CASE WHEN count(*) >= 20 THEN (arg_max(adj_close, date) - max(adj_close)) / max(adj_close) END, 6) AS drawdown
FROM fx_prices WHERE date >= DATE '2001-07-30' - 370 GROUP BY ticker""")
def a23(t):
    return rounded(P.current_drawdowns(t.prices, _day()), "drawdown")


@query("a24_exposures", """
SELECT symbol, round(sum(coalesce(o.notional, p.shares * p.entry_price)), 2) AS exposure
FROM fx_positions p JOIN (SELECT order_id, notional FROM fx_orders) o ON o.order_id = p.entry_order_id
WHERE p.status = 'open' GROUP BY symbol""")
def a24(t):
    return rounded(V.exposures(t.positions, t.orders), "exposure", digits=2)


@query("a25_open_counts", """
SELECT symbol, insider_id, count(*) AS open_positions FROM fx_positions WHERE status = 'open'
GROUP BY GROUPING SETS ((symbol), (symbol, insider_id))""")
def a25(t):
    return V.open_counts(t.positions)


@query("a26_execution_health", """
SELECT a AS tradeable_alerts, p AS positions_opened, NOT (a > 0 AND p = 0) AS healthy,
  concat(p, ' of ', a, ' alert(s) traded') AS reason
FROM (SELECT count(*) AS a FROM ox_alerts WHERE alert_type = 'cluster_buy' AND trade_date >= DATE '2001-01-01'),
     (SELECT count(*) AS p FROM fx_positions WHERE entry_date >= DATE '2001-01-01')""")
def a26(t):
    return V.execution_health(alerts(t), t.positions, tradeable=BUY, since=_day("2001-01-01"))


@query("a27_reconciliation_health", """
SELECT count(*) FILTER (status = 'delisted' AND exit_date >= DATE '2001-01-01') AS delisted_count,
  count(*) FILTER (close_reason = 'orphan_no_sell' AND exit_date >= DATE '2001-01-01') AS orphan_count,
  count(*) FILTER (reconcile_hold AND status IN ('open', 'closing')) AS held_count, false AS healthy FROM fx_positions""")
def a27(t):
    return V.reconciliation_health(t.positions, since=_day("2001-01-01"))


@query("k01_alert_feed", """
SELECT transaction_id, alert_type, round(conviction_score, 8) AS conviction_score FROM ox_alerts
WHERE alert_type <> 'filtered_out' AND conviction_score >= 1 AND trade_date >= DATE '2000-07-30'
ORDER BY conviction_score DESC, transaction_id LIMIT 50 OFFSET 10""")
def k01(t):
    feed = V.alert_feed(alerts(t), t.transactions, since=_day("2000-07-30"), min_conviction=1.0, skip=10)
    return rounded(feed.select("transaction_id", "alert_type", "conviction_score"), "conviction_score", digits=8)


@query("k02_recommendations", """
SELECT transaction_id, ticker, tier, role_title, round(drawdown, 6) AS drawdown, coalesce(drawdown <= -0.2, true) AS passes_drawdown,
  CAST(row_number() OVER (ORDER BY coalesce(drawdown <= -0.2, true) DESC, conviction_score DESC, transaction_id) AS INT) AS position
FROM (SELECT * FROM ox_enriched WHERE alert_type = 'cluster_buy' AND trade_date >= DATE '2001-06-30'
      ORDER BY conviction_score DESC, transaction_id LIMIT 10) a
LEFT JOIN (SELECT ticker, CASE WHEN count(*) >= 20 THEN (arg_max(adj_close, date) - max(adj_close)) / max(adj_close) END AS drawdown
           FROM fx_prices WHERE date >= DATE '2001-07-30' - 370 GROUP BY ticker) d USING (ticker)""")
def k02(t):
    out = V.recommendations(_enriched(t), P.current_drawdowns(t.prices, _day()), tradeable=BUY,
                            since=_day("2001-06-30"), threshold=-0.2)
    return rounded(out.select("transaction_id", "ticker", "tier", "role_title", "drawdown", "passes_drawdown",
                              "position"), "drawdown")


@query("k03_recent_trades", """
SELECT insider_id, txn_id, transaction_date, CAST(position AS INT) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY insider_id ORDER BY transaction_date DESC, txn_id DESC) AS position
  FROM fx_transactions WHERE is_discretionary AND coalesce(is_common_stock, true)) WHERE position <= 5""")
def k03(t):
    rows = t.transactions.where(F.col("is_discretionary") & E.common_or_unknown())
    return V.recent_trades(rows, "insider_id").select("insider_id", "txn_id", "transaction_date", "position")


def all_alerts(t):
    """Buy and sell alerts of people on common stock."""
    return G.person_alerts(alerts(t).unionByName(sell_alerts(t)), t.transactions, people(t))


def _week_query(name, day):
    @query(name, f"""
SELECT transaction_id, alert_type, trade_date FROM (SELECT *, count(CASE WHEN trade_date >= DATE '{day}' - 7 THEN 1 END) OVER () AS week
  FROM (SELECT transaction_id, alert_type, trade_date, conviction_score FROM ox_alerts WHERE alert_type = 'cluster_buy' UNION ALL
        SELECT transaction_id, alert_type, trade_date, transaction_value / 100000 FROM ox_sell_alerts)
  WHERE trade_date >= DATE '{day}' - 30)
WHERE week = 0 OR trade_date >= DATE '{day}' - 7 ORDER BY conviction_score DESC, transaction_id LIMIT 25""")
    def run(t):
        return V.this_week(all_alerts(t), kinds=BUY + SELLS, as_of=_day(day)).select(
            "transaction_id", "alert_type", "trade_date")


_week_query("k06_this_week", "2001-07-30")
_week_query("k06_this_week_fallback", "2001-08-20")
_week_query("k06_week_with_sells", "1998-06-30")


@query("w10_conviction_labels", """
SELECT transaction_id, CASE WHEN pct > 0.95 THEN 5 WHEN pct > 0.85 THEN 4 WHEN pct > 0.6 THEN 3 WHEN pct > 0.3 THEN 2 ELSE 1 END
    AS conviction_display,
  CASE WHEN pct > 0.95 THEN 'Very Strong' WHEN pct > 0.85 THEN 'Strong' WHEN pct > 0.6 THEN 'Moderate'
       WHEN pct > 0.3 THEN 'Weak' ELSE 'Noise' END AS conviction_label
FROM (SELECT a.transaction_id, ((SELECT count(*) FROM ox_top b WHERE b.c < a.c) + (SELECT count(*) FROM ox_top b WHERE b.c <= a.c) + 1)
        / (2.0::DOUBLE * (SELECT count(*) FROM ox_top)) AS pct
  FROM ox_top a)""")
def w10(t):
    feed = V.alert_feed(alerts(t), t.transactions, since=_day("2000-07-30"))
    return V.conviction_labels(feed).select("transaction_id", "conviction_display", "conviction_label")


@query("v01_insider_profile", """
SELECT i.insider_id, i.name, s.tier, round(s.skill_score, 6) AS skill_score, round(s.bayesian_hit_rate, 6) AS bayesian_hit_rate,
  (SELECT count(*) FROM fx_roles r WHERE r.insider_id = i.insider_id) AS n_roles FROM fx_insiders i
LEFT JOIN ox_scores s USING (insider_id)""")
def v01(t):
    out = V.insider_profiles(t.insiders, scores(t), t.roles)
    return rounded(out.select("insider_id", "name", "tier", "skill_score", "bayesian_hit_rate", "n_roles"),
                   "skill_score", "bayesian_hit_rate")


@query("v01_insider_trades", """
SELECT t.insider_id, t.txn_id, concat('T', t.company_id) AS ticker, o.hit_60d, round(o.excess_return_60d, 6) AS excess_return_60d
FROM fx_transactions t LEFT JOIN ox_outcomes o USING (txn_id) WHERE t.is_discretionary AND coalesce(t.is_common_stock, true)""")
def v01_trades(t):
    out = V.insider_trades(t.transactions, outcomes(t), t.companies)
    return rounded(out.select("insider_id", "txn_id", "ticker", "hit_60d", "excess_return_60d"), "excess_return_60d")


@query("v02_company_insiders", """
SELECT concat('T', r.company_id) AS ticker, i.name, r.role_title, s.tier FROM fx_roles r JOIN fx_insiders i USING (insider_id)
LEFT JOIN ox_scores s USING (insider_id)""")
def v02(t):
    return V.company_insiders(t.roles, t.insiders, scores(t), t.companies).select("ticker", "name", "role_title", "tier")


@query("v03_price_slice", "SELECT date, adj_close, volume FROM fx_prices WHERE ticker = 'T3' AND date >= DATE '2000-01-01'")
def v03(t):
    return V.price_slice(t.prices, " t3", _day("2000-01-01")).select("date", "adj_close", "volume")


@query("v04_sell_warnings", """
SELECT transaction_id, insider_id, alert_type, trade_date FROM ox_sell_alerts
WHERE trade_date BETWEEN DATE '1998-06-30' - 30 AND DATE '9999-12-31' ORDER BY trade_date DESC, transaction_id LIMIT 15""")
def v04(t):
    """Newest sell alerts of people on common stock within 30 days."""
    return V.sell_warnings(all_alerts(t), kinds=SELLS, as_of=_day("1998-06-30")).select(
        "transaction_id", "insider_id", "alert_type", "trade_date")


def _buys_sql(where):
    return f"""
SELECT concat('T', t.company_id) AS ticker, i.name, t.txn_id, t.transaction_date, CAST(row_number() OVER (
    PARTITION BY t.company_id ORDER BY t.transaction_date DESC, t.txn_id) AS INT) AS position
FROM fx_transactions t JOIN fx_insiders i USING (insider_id)
WHERE t.is_discretionary AND coalesce(t.is_common_stock, true) AND {where}"""


def _buys(t, since=None):
    return V.company_buys(t.transactions, t.insiders, t.companies, since).select(
        "ticker", "name", "txn_id", "transaction_date", "position")


@query("v02_company_buys", _buys_sql("true"))
def v02_buys(t):
    return _buys(t)


@query("v02_company_recent_buys", _buys_sql(f"t.transaction_date >= DATE '{TODAY}' - 90"))
def v02_recent(t):
    return _buys(t, F.date_sub(_day(), 90))


@query("v05_portfolio_summary", """
SELECT 'open' AS section, position_id AS id, symbol, entry_date AS day, status AS state FROM fx_positions WHERE status = 'open'
UNION ALL SELECT * FROM (SELECT 'closed', position_id, symbol, exit_date, status FROM fx_positions
  WHERE status IN ('closed', 'delisted') ORDER BY exit_date DESC, position_id DESC LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'order', order_id, symbol, created_on, side FROM fx_orders
  ORDER BY created_on DESC, order_id DESC LIMIT 20)""")
def v05(t):
    return V.portfolio_summary(t.positions, t.orders)


_QUOTES = """(SELECT ticker AS symbol, 400 * arg_max(adj_close, date) / 50 AS ask_price FROM fx_prices
  WHERE ticker LIKE 'T%' GROUP BY ticker)"""


def _quotes(t):
    return t.prices.where("ticker LIKE 'T%'").groupBy(F.col("ticker").alias("symbol")).agg(
        (400 * F.max_by("adj_close", "date") / 50).alias("ask_price"))


@query("v06_due_exits", """
SELECT position_id, symbol, exit_target_date FROM fx_positions WHERE status = 'open' AND exit_target_date <= DATE '2001-07-30'""")
def v06(t):
    return V.due_exits(t.positions, _day()).select("position_id", "symbol", "exit_target_date")


@query("v06_stop_loss", f"""
SELECT p.position_id, round((q.ask_price - p.entry_price) / p.entry_price, 6) AS current_return
FROM fx_positions p JOIN {_QUOTES} q USING (symbol)
WHERE p.status = 'open' AND p.shares > 0 AND (q.ask_price - p.entry_price) / p.entry_price <= -0.15""")
def v06_stop(t):
    return rounded(V.stop_loss_breaches(t.positions, _quotes(t), -0.15).select("position_id", "current_return"),
                   "current_return")


def _reconcile(t, limit):
    k = F.substring("symbol", 2, 9).cast("int")
    symbols = t.companies.select(F.col("ticker").alias("symbol"), "company_id")
    action = F.when(k == 2, "name_change").when(k == 3, "name_change").when(k == 4, "name_change").when(
        k == 5, "other").when(k == 6, "lookup_failed").when(k == 7, "spin_off")
    asset = F.when(k == 8, "inactive").when(k == 9, "active").when(k == 10, "not_found").otherwise("unknown")
    actions = symbols.select("symbol", action.alias("kind"), F.when(k == 2, "T20").when(k == 3, "ZZ").alias("new_symbol"),
                             F.when(k == 5, "merger").alias("raw_type")).where("kind IS NOT NULL")
    return V.reconcile(
        t.positions, symbols.where("company_id >= 12").select("symbol", F.lit(10.0).alias("qty")),
        sells=symbols.where("company_id <= 1").select("symbol", F.lit(300.0).alias("sell_price")), actions=actions,
        assets=symbols.select("symbol", asset.alias("asset_status")),
        last_bars=symbols.select("symbol", F.lit(250.0).alias("bar_price")), as_of=_day(), mass_limit=limit)


_RECON_SQL = """
SELECT position_id, symbol, action, CASE WHEN symbol = 'T2' THEN 'T20' WHEN symbol = 'T3' THEN 'ZZ' ELSE symbol END AS new_symbol,
  CASE action WHEN 'sold' THEN 'closed' WHEN 'orphan_close' THEN 'closed' WHEN 'delisted' THEN 'delisted' WHEN 'rename' THEN 'open'
       ELSE status END AS new_status,
  CASE action WHEN 'sold' THEN 300.0::DOUBLE WHEN 'orphan_close' THEN 250.0 WHEN 'delisted' THEN 0.0 END AS exit_price,
  close_reason, close_reason NOT IN ('sold', 'delisted', 'orphan_no_sell', 'renamed_from:T2') AS reconcile_hold
FROM (SELECT *, CASE WHEN k <= 1 THEN 'sold' WHEN k IN (2, 3) THEN 'rename' WHEN k IN (4, 5, 6, 7) THEN 'needs_review'
    WHEN k IN (8, 10) THEN 'delisted' WHEN k = 9 THEN 'orphan_close' ELSE 'needs_review' END AS action,
  CASE WHEN k <= 1 THEN 'sold' WHEN k = 2 THEN 'renamed_from:T2' WHEN k = 3 THEN 'renamed_from:T3;broker_missing'
    WHEN k = 4 THEN 'malformed_name_change' WHEN k = 5 THEN 'ca_needs_review:merger' WHEN k = 6 THEN 'ca_lookup_failed'
    WHEN k = 7 THEN 'ca_unhandled:spin_off' WHEN k IN (8, 10) THEN 'delisted' WHEN k = 9 THEN 'orphan_no_sell'
    ELSE 'reconcile_uncertain' END AS close_reason
  FROM (SELECT position_id, symbol, status, CAST(substr(symbol, 2) AS INT) AS k FROM fx_positions
        WHERE status IN ('open', 'closing') AND NOT reconcile_hold) WHERE k < 12)"""


@query("v07_reconcile", _RECON_SQL)
def v07(t):
    return _reconcile(t, 100).select("position_id", "symbol", "action", "new_symbol", "new_status", "exit_price",
                                     "close_reason", "reconcile_hold")


@query("v07_mass_disappearance", """
SELECT position_id, status AS new_status, 'mass_disappearance_hold' AS close_reason, true AS reconcile_hold FROM fx_positions
WHERE status IN ('open', 'closing') AND NOT reconcile_hold AND CAST(substr(symbol, 2) AS INT) < 12""")
def v07_mass(t):
    return _reconcile(t, 2).select("position_id", "new_status", "close_reason", "reconcile_hold")
