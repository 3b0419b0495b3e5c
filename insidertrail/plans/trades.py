"""Queries on the trade ledger, its metrics and the equity curve."""

from __future__ import annotations

from pyspark.sql import functions as F

from insidertrail.params import SIGNALS
from insidertrail.operators import events as E, ledger as L, prices as P, signals as G
from insidertrail.plans.helpers import flagged, rounded, scores
from insidertrail.plans.registry import query
from insidertrail.session import shared_folder

CASH = 1_000_000.0


def candidates(t):
    rows = G.classify_flagged(flagged(t), G.cluster_buy())
    return rows.where("signal_type = 'cluster_buy'")


def base_trades(t):
    """Plain 60-row ledger of the cluster signal, written once per application."""
    return t.stage("trades", lambda: L.trade_ledger(candidates(t), t.prices))


def first_trades(t):
    return t.stage("first_trades", lambda: L.first_per_entry(base_trades(t)))


_TRADE_COLS = ["txn_id", "ticker", "entry_date", "exit_date", "entry_price", "exit_price", "forced", "pnl", "pnl_pct"]
_TRADE_OUT = ("txn_id, ticker, entry_date, exit_date, round(entry_price, 6) AS entry_price, "
              "round(exit_price, 6) AS exit_price, forced, round(pnl, 6) AS pnl, round(pnl_pct, 6) AS pnl_pct")


def _out(df, *extra):
    return rounded(df.select(*_TRADE_COLS, *extra), "entry_price", "exit_price", "pnl", "pnl_pct")


@query("b02_trade_ledger", f"SELECT {_TRADE_OUT} FROM ox_trades60")
def b02(t):
    return _out(L.trade_ledger(candidates(t), t.prices))


@query("b02_delayed_entry", """
SELECT c.txn_id, e.date AS entry_date, coalesce(x.date, l.last_date) AS exit_date, x.date IS NULL AS forced
FROM ox_entry c JOIN ox_px e ON e.ticker = c.ticker AND e.rn = c.entry_rn + 5
LEFT JOIN ox_px x ON x.ticker = c.ticker AND x.rn = c.entry_rn + 25 JOIN ox_last l ON l.ticker = c.ticker""")
def b02_delay(t):
    return L.trade_ledger(candidates(t), t.prices, entry_delay=5, hold_days=20).select(
        "txn_id", "entry_date", "exit_date", "forced")


@query("b03_entry_filters", """
SELECT t.txn_id, t.entry_date FROM ox_trades60 t JOIN ox_panel p ON p.ticker = t.ticker AND p.date = t.entry_date
WHERE NOT is_routine AND filing_lag_days <= 5 AND known_on BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
  AND t.ticker NOT IN ('T0', 'T1') AND (t.entry_price - p.high_52w) / p.high_52w <= -0.2""")
def b03(t):
    return L.entry_filters(
        base_trades(t), skip_routine=True, max_filing_lag=5, start=F.lit("1996-01-01").cast("date"),
        end=F.lit("2000-12-31").cast("date"), universe=t.companies.where("company_id NOT IN (0, 1)"),
        drawdown_threshold=-0.2).select("txn_id", "entry_date")


@query("b03_volume_bands", """
SELECT txn_id FROM (SELECT t.txn_id, CASE WHEN realized_vol IS NOT NULL THEN v END AS v,
                           CASE WHEN adv_dollar_20d IS NOT NULL THEN a END AS a
  FROM ox_trades60 t JOIN (SELECT *, percent_rank() OVER (PARTITION BY date, realized_vol IS NULL ORDER BY realized_vol) AS v,
    percent_rank() OVER (PARTITION BY date, adv_dollar_20d IS NULL ORDER BY adv_dollar_20d) AS a FROM ox_panel) p
    ON p.ticker = t.ticker AND p.date = t.entry_date)
WHERE coalesce(v <= 0.7, true) AND coalesce(a >= 0.2, true)""")
def b03_bands(t):
    bands = P.cross_section_percentiles(P.price_panel(t.prices)).select(
        "ticker", F.col("date").alias("entry_date"), "vol_pctile", "adv_pctile")
    rows = base_trades(t).join(bands, ["ticker", "entry_date"])
    return L.entry_filters(rows, vol_pctile_max=0.7, adv_pctile_min=0.2).select("txn_id")


@query("b04_first_per_entry", "SELECT txn_id, insider_id, ticker, entry_date FROM ox_first_trades")
def b04(t):
    return L.first_per_entry(base_trades(t)).select("txn_id", "insider_id", "ticker", "entry_date")


@query("b05_exit_on_csuite_sale", """
SELECT t.txn_id, CASE WHEN q.date IS NOT NULL AND (t.forced OR s.sold < t.exit_date) THEN q.date ELSE t.exit_date END AS exit_date,
  round(CASE WHEN q.date IS NOT NULL AND (t.forced OR s.sold < t.exit_date) THEN q.adj_close ELSE t.exit_price END, 6)
    AS exit_price,
  t.forced AND q.date IS NULL AS forced
FROM ox_trades60 t
LEFT JOIN (SELECT t.txn_id, min(x.date) AS sold FROM ox_trades60 t JOIN ox_sells x ON x.ticker = t.ticker
           AND x.date > t.entry_date GROUP BY t.txn_id) s ON s.txn_id = t.txn_id
LEFT JOIN (SELECT y.ticker, y.date AS sold, p.date, p.adj_close FROM ox_sells y ASOF JOIN ox_px p
           ON p.ticker = y.ticker AND y.date <= p.date) q ON q.ticker = t.ticker AND q.sold = s.sold""")
def b05(t):
    sells = E.csuite_sell_days(t.transactions, t.companies, t.roles)
    out = L.trade_ledger(candidates(t), t.prices, csuite_sells=sells)
    return rounded(out.select("txn_id", "exit_date", "exit_price", "forced"), "exit_price")


@query("b06_exit_after_earnings", """
SELECT t.txn_id, CASE WHEN y.date IS NOT NULL AND (t.forced OR y.date < t.exit_date) THEN y.date ELSE t.exit_date END AS exit_date,
  t.forced AND y.date IS NULL AS forced
FROM ox_trades60 t
LEFT JOIN (SELECT t.txn_id, min(e.earnings_date) AS report FROM ox_trades60 t JOIN fx_earnings e ON e.ticker = t.ticker
           AND e.earnings_date > t.entry_date GROUP BY t.txn_id) s ON s.txn_id = t.txn_id
LEFT JOIN ox_px b ON b.ticker = t.ticker AND b.date = s.report
LEFT JOIN ox_px y ON y.ticker = t.ticker AND y.rn = b.rn + 3""")
def b06(t):
    days = t.earnings.withColumnRenamed("earnings_date", "date")
    return L.trade_ledger(candidates(t), t.prices, earnings=days, after_earnings=3).select(
        "txn_id", "exit_date", "forced")


@query("b07_momentum_extension", """
SELECT e.txn_id, CASE WHEN NOT coalesce(a.adj_close > e.entry_price, false) THEN 0
       WHEN NOT coalesce(b.adj_close > e.entry_price, false) THEN 1 ELSE 2 END AS extensions,
  coalesce(CASE WHEN NOT coalesce(a.adj_close > e.entry_price, false) THEN a.date
       WHEN NOT coalesce(b.adj_close > e.entry_price, false) THEN b.date ELSE c.date END, l.last_date) AS exit_date
FROM ox_entry e LEFT JOIN ox_px a ON a.ticker = e.ticker AND a.rn = e.entry_rn + 60
LEFT JOIN ox_px b ON b.ticker = e.ticker AND b.rn = e.entry_rn + 80
LEFT JOIN ox_px c ON c.ticker = e.ticker AND c.rn = e.entry_rn + 100 JOIN ox_last l ON l.ticker = e.ticker""")
def b07(t):
    return L.trade_ledger(candidates(t), t.prices, extend_days=20).select("txn_id", "extensions", "exit_date")


@query("b08_scale_out", """
SELECT e.txn_id, h.hold AS hold_days, coalesce(x.date, l.last_date) AS exit_date, 250.0::DOUBLE AS cost_basis
FROM ox_entry e CROSS JOIN (VALUES (60), (120)) h(hold)
LEFT JOIN ox_px x ON x.ticker = e.ticker AND x.rn = e.entry_rn + h.hold JOIN ox_last l ON l.ticker = e.ticker""")
def b08(t):
    return L.trade_ledger(candidates(t), t.prices, scale_out_mult=2.0).select(
        "txn_id", "hold_days", "exit_date", "cost_basis")


@query("b09_slippage", """
SELECT t.txn_id, round(CASE WHEN p.adv_dollar_20d > 0 THEN t.entry_price * (1 + 2 * 0.0002 * 500 / p.adv_dollar_20d * 100)
                            ELSE t.entry_price END, 6) AS entry_price
FROM ox_trades60 t JOIN ox_panel p ON p.ticker = t.ticker AND p.date = t.entry_date""")
def b09(t):
    adv = P.price_panel(t.prices).select("ticker", F.col("date").alias("entry_date"), "adv_dollar_20d")
    out = L.with_slippage(base_trades(t).join(adv, ["ticker", "entry_date"]), 2.0)
    return rounded(out.select("txn_id", "entry_price"), "entry_price")


@query("b10_concentration", f"""
SELECT {_TRADE_OUT} FROM ox_trades60 WHERE txn_id IN (
  WITH RECURSIVE o AS (
    SELECT *, concat(insider_id, '|', entry_date) AS entry,
           row_number() OVER (PARTITION BY ticker ORDER BY known_on, txn_id) AS rn FROM ox_trades60),
  f AS (
    SELECT DISTINCT ticker, 0::BIGINT AS rn, -1::BIGINT AS txn_id, false AS taken,
           []::STRUCT(who INT, forced BOOLEAN, closes DATE)[] AS held, []::VARCHAR[] AS entries FROM o
    UNION ALL
    SELECT ticker, rn, txn_id, ok,
           CASE WHEN ok THEN list_append(live, {{'who': insider_id, 'forced': forced, 'closes': exit_date}}) ELSE live END,
           CASE WHEN ok THEN list_append(entries, entry) ELSE entries END
    FROM (
      SELECT *, len(live) < {SIGNALS.max_per_ticker} AND NOT list_contains(entries, entry)
             AND len(list_filter(live, lambda x: x.who = insider_id)) < {SIGNALS.max_per_insider_ticker} AS ok
      FROM (SELECT o.*, f.entries, list_filter(f.held, lambda x: x.forced OR x.closes > o.known_on) AS live
            FROM f JOIN o ON o.ticker = f.ticker AND o.rn = f.rn + 1)))
  SELECT txn_id FROM f WHERE taken)""")
def b10(t):
    """Greedy per-ticker limits over all trades; repeats of an entry are refused only where one was taken."""
    return _out(L.limit_concentration(base_trades(t)))


@query("b11_trade_metrics", """
SELECT signal_type, count(*) AS total_trades, count(*) FILTER (pnl > 0) AS wins,
  round(count(*) FILTER (pnl > 0) / count(*), 6) AS win_rate,
  round(avg(pnl_pct) FILTER (pnl > 0), 6) AS avg_win, round(avg(pnl_pct) FILTER (pnl <= 0), 6) AS avg_loss,
  round(sum(pnl) FILTER (pnl > 0) / abs(sum(pnl) FILTER (pnl <= 0)), 6) AS profit_factor,
  round(avg(pnl_pct) / stddev_samp(pnl_pct) * sqrt(252 / avg(hold_days)), 6) AS sharpe,
  round(sum(pnl), 4) AS total_pnl, count(*) FILTER (forced) AS force_closed
FROM (SELECT *, 'cluster_buy' AS signal_type FROM ox_first_trades) GROUP BY ROLLUP (signal_type)""")
def b11(t):
    m = L.trade_metrics(first_trades(t)).select(
        "signal_type", "total_trades", "wins", "win_rate", "avg_win", "avg_loss", "profit_factor", "sharpe",
        "total_pnl", "force_closed")
    return rounded(rounded(m, "win_rate", "avg_win", "avg_loss", "profit_factor", "sharpe"), "total_pnl", digits=4)


_CURVE_OUT = """round(cash, 4) AS cash, round(market_value, 4) AS market_value, round(cash + market_value, 4) AS portfolio_value,
  round(1000000 * bench / first_value(bench) OVER (ORDER BY date), 4) AS benchmark_value,
  round(market_value / (cash + market_value), 6) AS pct_invested, CAST(num_positions AS BIGINT) AS num_positions"""


def curve(t):
    return t.stage("equity_curve", lambda: L.daily_equity(first_trades(t), t.prices, initial_cash=CASH))


@query("b12_curve_metrics", """
SELECT min(date) AS first_date, max(date) AS last_date, round(arg_max(v, date), 4) AS final_value,
  round(least(min((v - peak) / peak), 0), 6) AS max_drawdown, round(arg_max(v, date) / 1000000 - 1, 6) AS total_return,
  round(pow(arg_max(v, date) / 1000000, 1 / ((max(date) - min(date)) / 365.25)) - 1, 6) AS cagr,
  round(arg_max(bench, date) / arg_min(bench, date) - 1, 6) AS benchmark_return
FROM (SELECT *, cash + market_value AS v, max(cash + market_value) OVER (ORDER BY date) AS peak FROM ox_curve)""")
def b12(t):
    m = L.curve_metrics(curve(t), initial_cash=CASH).drop("avg_invested_pct")
    return rounded(rounded(m, "max_drawdown", "total_return", "cagr", "benchmark_return"), "final_value", digits=4)


@query("b13_daily_equity", f"SELECT date, {_CURVE_OUT} FROM ox_curve")
def b13(t):
    c = L.daily_equity(first_trades(t), t.prices, initial_cash=CASH)
    return rounded(rounded(c, "pct_invested"), "cash", "market_value", "portfolio_value", "benchmark_value", digits=4)


@query("w11_running_drawdown", """
SELECT date, round(max(cash + market_value) OVER (ORDER BY date), 4) AS peak,
  round((cash + market_value - max(cash + market_value) OVER (ORDER BY date))
        / max(cash + market_value) OVER (ORDER BY date), 6) AS drawdown FROM ox_curve""")
def w11(t):
    c = L.with_drawdown(curve(t)).select("date", "peak", "drawdown")
    return rounded(rounded(c, "peak", digits=4), "drawdown")


@query("w12_cumulative_cash", "SELECT date, round(cash, 4) AS cash FROM ox_curve")
def w12(t):
    return rounded(curve(t).select("date", "cash"), "cash", digits=4)


@query("b14_backtest_results", """
SELECT 'run-1' AS run_id, txn_id AS transaction_id, 'cluster_buy' AS simulated_alert_type, round(pnl_pct, 6) AS simulated_return,
  round(excess_return_60d, 6) AS actual_excess_return_60d, hit_60d AS actual_hit_60d FROM ox_first_trades""")
def b14(t):
    stored = t.stage("backtest_results", lambda: L.backtest_results(first_trades(t), "run-1"))
    return rounded(stored, "simulated_return", "actual_excess_return_60d")


@query("b15_ledger_diff", """
SELECT txn_id, side AS only_in FROM ox_first_trades CROSS JOIN (VALUES ('left'), ('right')) s(side) WHERE txn_id % 100 = 0""")
def b15(t):
    left = first_trades(t).select("txn_id", "ticker", "entry_date", "entry_price", "exit_date", "pnl")
    right = left.withColumn("pnl", F.when(F.col("txn_id") % 100 == 0, F.col("pnl") + 1).otherwise(
        F.col("pnl") * (1 + 1e-14)))
    return L.ledger_diff(left, right, left.columns).select(F.col("txn_id").cast("bigint"), "only_in")


def _export_path(t, name):
    return f"{shared_folder(t.spark)}/insidertrail/{t.spark.sparkContext.applicationId}/{name}"


@query("s19_trade_export", """
SELECT f.txn_id, f.ticker, i.name AS insider_name, coalesce(r.role_title, '') AS role_title, s.tier, 'cluster_buy' AS signal_type,
  f.entry_date, f.exit_date, round(f.entry_price, 2) AS entry_price, round(f.exit_price, 2) AS exit_price,
  round(f.shares_held, 2) AS shares_held, round(f.pnl, 2) AS pnl, 500.0::DOUBLE AS cost_basis, round(s.skill_score, 2) AS skill_score,
  round(f.pnl_pct, 4) AS pnl_pct, CAST(f.hold_days AS INT) AS hold_days, f.forced AS force_closed
FROM ox_first_trades f JOIN fx_insiders i ON i.insider_id = f.insider_id
LEFT JOIN fx_roles r ON r.insider_id = f.insider_id AND r.company_id = f.company_id
LEFT JOIN ox_scores s ON s.insider_id = f.insider_id""")
def s19(t):
    """Trades written as JSON files in the shared folder and read back."""
    trades = L.with_people(first_trades(t), t.insiders, t.roles, scores(t))
    L.export_trades(trades, _export_path(t, "trade_export"), fmt="json")
    return t.spark.read.schema(L.rounded_trades(trades).schema).json(_export_path(t, "trade_export"))


@query("s19_curve_export", f"SELECT date, {_CURVE_OUT} FROM ox_curve")
def s19_curve(t):
    """The equity curve written as CSV files and read back."""
    columns = ["date", "cash", "market_value", "portfolio_value", "benchmark_value", "pct_invested", "num_positions"]
    days = curve(t).select(*columns)
    L.export_curve(days, _export_path(t, "curve_export"))
    out = t.spark.read.schema(days.schema).option("header", True).csv(_export_path(t, "curve_export"))
    out = rounded(out, "cash", "market_value", "portfolio_value", "benchmark_value", digits=4)
    return rounded(out, "pct_invested").withColumn("num_positions", F.col("num_positions").cast("bigint"))


@query("s19_metrics_export", """
SELECT signal_type, count(*) AS total_trades, count(*) FILTER (pnl > 0) AS wins, round(sum(pnl), 4) AS total_pnl
FROM (SELECT *, 'cluster_buy' AS signal_type FROM ox_first_trades) GROUP BY ROLLUP (signal_type)""")
def s19_metrics(t):
    """Trade metrics written as JSON files and read back."""
    metrics = L.trade_metrics(first_trades(t))
    L.export_metrics(metrics, _export_path(t, "metrics_export"))
    out = t.spark.read.schema(metrics.schema).json(_export_path(t, "metrics_export"))
    return rounded(out.select("signal_type", "total_trades", "wins", "total_pnl"), "total_pnl", digits=4)


@query("k04_best_and_worst", """
SELECT * FROM (SELECT 'winner' AS side, txn_id, ticker, round(pnl, 6) AS pnl FROM ox_first_trades ORDER BY pnl DESC, txn_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'loser' AS side, txn_id, ticker, round(pnl, 6) AS pnl FROM ox_first_trades
                         ORDER BY pnl, txn_id DESC LIMIT 5)""")
def k04(t):
    return rounded(L.best_and_worst(first_trades(t)).select("side", "txn_id", "ticker", "pnl"), "pnl")


@query("k05_top20_share", """
SELECT round(sum(CASE WHEN r <= 20 THEN pnl END) / sum(pnl), 6) AS top20_pnl_share FROM (
  SELECT pnl, row_number() OVER (ORDER BY pnl DESC, txn_id) AS r FROM ox_first_trades WHERE pnl > 0)""")
def k05(t):
    return rounded(L.top_share(first_trades(t)), "top20_pnl_share")


@query("k07_all_positions", """
SELECT txn_id, CASE WHEN forced THEN 'open' ELSE 'closed' END AS state, ticker FROM ox_first_trades""")
def k07(t):
    cols = ["txn_id", "ticker"]
    closed = first_trades(t).where("NOT forced").select(*cols, F.lit("closed").alias("state"))
    still = first_trades(t).where("forced").select(*cols, F.lit("open").alias("state"))
    return closed.unionByName(still)


@query("k10_seeded_order", """
SELECT txn_id, filing_date, row_number() OVER (PARTITION BY filing_date ORDER BY md5(concat('7:', txn_id)), txn_id) AS slot
FROM ox_flagged""")
def k10(t):
    from insidertrail.operators.research import seeded_rank

    return flagged(t).select("txn_id", "filing_date").withColumn(
        "slot", seeded_rank(F.lit(7), ["filing_date"]).cast("bigint"))
