"""Queries on sizing and exit levers of specifications, and on the spread over orders of trades."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from insidertrail.operators import events as E
from insidertrail.operators import ledger as L
from insidertrail.operators import levers as V
from insidertrail.operators import research as R
from insidertrail.params import RESEARCH, SIGNALS
from insidertrail.plans.helpers import flagged, rounded
from insidertrail.plans.oracle_views import CSUITE_SQL, ORACLE_VIEWS, chance_sharpe, normal_cdf_sql
from insidertrail.plans.registry import query
from insidertrail.plans.research import HOLDS, WINDOWS

ATOM_SETS = [[], ["cluster_2plus"], ["value_100k"], ["senior_role", "opportunistic"]]
REQUIRED = [64, 1, 4, 18]
SIZES = [R.FLAT, ("csuite", 0.5)]
SEEDS = [0, 1, 2]
BANNED = {"larger executive sizes without an exit rule": "sizing.type = 'csuite' AND size(exits) = 0 AND hold_days = 20"}
TRIALS, VARIANCE = 64, 1e-4
GATES = replace(RESEARCH, dsr_pass=0.05, min_validate_trades=2)


def exit_rules(t):
    sells = E.csuite_sell_days(t.transactions, t.companies, t.roles)
    earnings = t.earnings.withColumnRenamed("earnings_date", "date")
    return {"csuite_sell": L.sell_exits(sells, t.prices), "earnings": L.earnings_exits(earnings, t.prices, 1, 3)}


def counted(t):
    base = (F.col("cluster_size") >= 2) & (F.col("total_value") >= 25_000)

    def build():
        trades = V.trade_lattice(flagged(t), t.prices, HOLDS, base, exits=exit_rules(t), sizes=SIZES)
        return V.counted_lattice(trades, REQUIRED, WINDOWS)

    return t.stage("lever_trades", build)


def spread(t):
    return t.stage("lever_spread", lambda: V.order_spread(counted(t), REQUIRED, seeds=SEEDS))


def metrics(t):
    return t.stage("lever_metrics", lambda: V.with_spread(V.lever_metrics(counted(t), REQUIRED), spread(t)))


def specs(t, window):
    grid = R.lever_grid(t.spark, ATOM_SETS, HOLDS, ["csuite_sell", "earnings"], SIZES, window)
    known = t.spark.createDataFrame([(w, None, None) for w, _, _ in WINDOWS], R.WINDOW_SCHEMA)
    return R.resolve_specs(grid, known, exits=["csuite_sell", "earnings"], sizes=SIZES, banned={why: F.expr(where) for why, where in BANNED.items()})


def validate_records(t):
    out = rounded(R.evaluate(specs(t, "validate")[0], metrics(t), R.LEVERS), "sharpe", "ret", "maxdd", "top20", "cv", digits=4)
    return out.select("id", "complexity", "core_key", "size_index", "sr_hat", "n_obs", "skew", "kurtosis",
                      *[F.col(c).alias(f"val_{c}") for c in ("sharpe", "ret", "maxdd", "top20", "cv", "trades")])


ORACLE_VIEWS["ox_lever_trades"] = f"""
SELECT txn_id, insider_id, ticker, known_on, own, entry_date, hold_days, exit_bits, d2 IS NULL AS forced,
  coalesce(d2, last_date) AS exit_date, coalesce(p2, last_price) / entry_price - 1 AS pnl_pct, factor FROM (
  SELECT *, CASE WHEN exit_bits & 2 = 2 AND report IS NOT NULL AND (d1 IS NULL OR report < d1) THEN report ELSE d1 END AS d2,
    CASE WHEN exit_bits & 2 = 2 AND report IS NOT NULL AND (d1 IS NULL OR report < d1) THEN report_price ELSE p1 END AS p2
  FROM (SELECT *, CASE WHEN exit_bits & 1 = 1 AND sale_date IS NOT NULL AND (hold_date IS NULL OR sold < hold_date) THEN sale_date
      ELSE hold_date END AS d1,
    CASE WHEN exit_bits & 1 = 1 AND sale_date IS NOT NULL AND (hold_date IS NULL OR sold < hold_date) THEN sale_price
      ELSE hold_price END AS p1
    FROM (
      SELECT f.*, e.date AS entry_date, e.adj_close AS entry_price, h.hold AS hold_days, b.bits AS exit_bits, x.date AS hold_date,
        x.adj_close AS hold_price, l.last_date, l.last_price, s.sold, s.date AS sale_date, s.adj_close AS sale_price,
        y.date AS report, y.adj_close AS report_price, CASE WHEN {CSUITE_SQL} THEN 1.5 ELSE 1.0 END AS factor
      FROM (SELECT DISTINCT t.*, g.role_title FROM (SELECT txn_id, insider_id, ticker, known_on, own FROM ox_spec_trades WHERE hold_days = 20) t
            JOIN ox_flagged g ON g.txn_id = t.txn_id) f
      ASOF JOIN ox_px e ON e.ticker = f.ticker AND f.known_on <= e.date
      CROSS JOIN (VALUES (20), (60)) h(hold) CROSS JOIN (VALUES (0), (1), (2), (3)) b(bits)
      LEFT JOIN ox_px x ON x.ticker = e.ticker AND x.rn = e.rn + h.hold JOIN ox_last l ON l.ticker = e.ticker
      LEFT JOIN (SELECT g.ticker, g.entry_date, g.sold, p.date, p.adj_close FROM (
          SELECT k.ticker, k.entry_date, min(z.date) AS sold FROM (SELECT DISTINCT ticker, entry_date FROM ox_spec_trades) k
          JOIN ox_sells z ON z.ticker = k.ticker AND z.date > k.entry_date GROUP BY k.ticker, k.entry_date) g
          ASOF JOIN ox_px p ON p.ticker = g.ticker AND g.sold <= p.date) s ON s.ticker = f.ticker AND s.entry_date = e.date
      LEFT JOIN (SELECT k.ticker, k.entry_date, min(n.earnings_date) AS day FROM (SELECT DISTINCT ticker, entry_date FROM ox_spec_trades) k
          JOIN fx_earnings n ON n.ticker = k.ticker AND n.earnings_date > k.entry_date GROUP BY k.ticker, k.entry_date) n
        ON n.ticker = f.ticker AND n.entry_date = e.date
      LEFT JOIN ox_px r ON r.ticker = n.ticker AND r.date = n.day
      LEFT JOIN ox_px y ON y.ticker = r.ticker AND y.rn = r.rn + 3)))"""
ORACLE_VIEWS["ox_lever_counted"] = """
SELECT * FROM (
  SELECT s.required, w.win AS "window", t.*, row_number() OVER (
      PARTITION BY s.required, t.hold_days, t.exit_bits, w.win, t.insider_id, t.ticker, t.entry_date ORDER BY t.known_on, t.txn_id) AS pick
  FROM ox_lever_trades t JOIN (VALUES (64), (1), (4), (18)) s(required) ON (t.own & s.required) = s.required
  JOIN (VALUES ('train', DATE '1900-01-01', DATE '1997-12-31'), ('validate', DATE '1998-01-01', DATE '1999-12-31'))
    w(win, a, b) ON t.known_on BETWEEN w.a AND w.b)
WHERE pick = 1"""
ORACLE_VIEWS["ox_lever_cells"] = """
SELECT c.*, z.size_index, 500 * CASE WHEN z.size_index = 1 THEN c.factor ELSE 1 END * c.pnl_pct AS pnl
FROM ox_lever_counted c CROSS JOIN (VALUES (0), (1)) z(size_index)"""
_KEYS = 'required, hold_days, "window", exit_bits, size_index'
ORACLE_VIEWS["ox_lever_stats"] = f"""
SELECT {_KEYS}, count(*) AS trades, sum(pnl) / 10000 AS ret, coalesce(avg(pnl_pct) / nullif(stddev_samp(pnl_pct), 0), 0) AS sr_hat,
  coalesce(avg(pnl_pct) / nullif(stddev_samp(pnl_pct), 0), 0) * sqrt(252 / hold_days) AS sharpe,
  avg(pow(pnl_pct - mu, 3)) / nullif(pow(var_pop(pnl_pct), 1.5), 0) AS skew,
  avg(pow(pnl_pct - mu, 4)) / nullif(pow(var_pop(pnl_pct), 2), 0) AS kurtosis,
  sum(CASE WHEN r <= 20 AND pnl > 0 THEN pnl END) / nullif(sum(CASE WHEN pnl > 0 THEN pnl END), 0) AS top20
FROM (SELECT *, avg(pnl_pct) OVER (PARTITION BY {_KEYS}) AS mu, row_number() OVER (PARTITION BY {_KEYS} ORDER BY pnl DESC, txn_id) AS r
      FROM ox_lever_cells)
GROUP BY {_KEYS}"""
ORACLE_VIEWS["ox_lever_dd"] = f"""
SELECT {_KEYS}, least(min((equity - peak) / peak), 0) AS maxdd FROM (
  SELECT *, greatest(10000, max(equity) OVER (PARTITION BY {_KEYS} ORDER BY exit_date)) AS peak FROM (
    SELECT {_KEYS}, exit_date, 10000 + sum(sum(pnl)) OVER (PARTITION BY {_KEYS} ORDER BY exit_date) AS equity
    FROM ox_lever_cells GROUP BY {_KEYS}, exit_date))
GROUP BY {_KEYS}"""
_SPREAD_GROUP = 'required, hold_days, "window", exit_bits, ticker, seed'
SPREAD_SQL = f"""
SELECT {_KEYS}, avg(ret) AS mean_ret, CASE WHEN avg(ret) <> 0 AND stddev_pop(ret) > 0 THEN stddev_pop(ret) / avg(ret) ELSE 0 END AS cv FROM (
  SELECT required, hold_days, "window", exit_bits, z.size_index, seed, sum(CASE WHEN z.size_index = 1 THEN p1 ELSE p0 END) / 10000 AS ret
  FROM (
    WITH RECURSIVE o AS (
      SELECT c.*, s.seed, row_number() OVER (PARTITION BY {_SPREAD_GROUP}
        ORDER BY known_on, md5(concat(s.seed, ':', txn_id)), txn_id) AS rn
      FROM ox_lever_counted c CROSS JOIN (VALUES (0), (1), (2)) s(seed)),
    f AS (
      SELECT DISTINCT {_SPREAD_GROUP}, 0::BIGINT AS rn, 0.0::DOUBLE AS p0, 0.0::DOUBLE AS p1,
             []::STRUCT(who INT, forced BOOLEAN, closes DATE)[] AS held FROM o
      UNION ALL
      SELECT {_SPREAD_GROUP}, rn, CASE WHEN ok THEN p0 + 500 * pnl_pct ELSE p0 END,
             CASE WHEN ok THEN p1 + 500 * factor * pnl_pct ELSE p1 END,
             CASE WHEN ok THEN list_append(live, {{'who': insider_id, 'forced': forced, 'closes': exit_date}}) ELSE live END
      FROM (
        SELECT *, len(live) < {SIGNALS.max_per_ticker}
               AND len(list_filter(live, lambda x: x.who = insider_id)) < {SIGNALS.max_per_insider_ticker} AS ok
        FROM (SELECT o.*, f.p0, f.p1, list_filter(f.held, lambda x: x.forced OR x.closes > o.known_on) AS live
              FROM f JOIN o ON o.required = f.required AND o.hold_days = f.hold_days AND o."window" = f."window"
                AND o.exit_bits = f.exit_bits AND o.ticker = f.ticker AND o.seed = f.seed AND o.rn = f.rn + 1)))
    SELECT * FROM f QUALIFY rn = max(rn) OVER (PARTITION BY {_SPREAD_GROUP})) f
  CROSS JOIN (VALUES (0), (1)) z(size_index)
  GROUP BY required, hold_days, "window", exit_bits, z.size_index, seed)
GROUP BY {_KEYS}"""
_ATOM_INDEX = "CASE required WHEN 64 THEN 0 WHEN 1 THEN 1 WHEN 4 THEN 2 ELSE 3 END"
_ID = f"concat('a', {_ATOM_INDEX}, '_h', hold_days, '_e', exit_bits, '_s', size_index)"
_CORE = """concat('cluster_buy|', CASE size_index WHEN 1 THEN 'csuite|0.5|' ELSE '|0.0|' END,
  CASE exit_bits WHEN 0 THEN '' WHEN 1 THEN 'csuite_sell' WHEN 2 THEN 'earnings' ELSE 'csuite_sell,earnings' END)"""
_BANNED = "size_index = 1 AND exit_bits = 0 AND hold_days = 20"
ORACLE_VIEWS["ox_lever_records"] = f"""
SELECT {_ID} AS id, CASE required WHEN 64 THEN 0 WHEN 18 THEN 2 ELSE 1 END AS complexity,
  {_CORE} AS core_key, size_index, s.sr_hat, CAST(s.trades AS DOUBLE) AS n_obs, s.skew, s.kurtosis, round(s.sharpe, 4) AS val_sharpe,
  round(s.ret, 4) AS val_ret, round(d.maxdd, 4) AS val_maxdd, round(s.top20, 4) AS val_top20, round(v.cv, 4) AS val_cv,
  CAST(s.trades AS DOUBLE) AS val_trades
FROM ox_lever_stats s JOIN ox_lever_dd d USING ({_KEYS}) JOIN ({SPREAD_SQL}) v USING ({_KEYS})
WHERE "window" = 'validate' AND NOT ({_BANNED})"""


@query("r01_spec_levers", f"""
SELECT {_ID} AS id, CASE WHEN NOT ({_BANNED}) THEN {_CORE} END AS core_key, CASE WHEN NOT ({_BANNED}) THEN exit_bits END AS exit_bits,
  CASE WHEN NOT ({_BANNED}) THEN size_index END AS size_index,
  CASE WHEN {_BANNED} THEN 'banned spec: larger executive sizes without an exit rule' END AS reason,
  CASE WHEN NOT ({_BANNED}) THEN CAST(trades AS DOUBLE) END AS trades
FROM ox_lever_stats WHERE "window" = 'validate'""")
def r01(t):
    """Specs with exits and sizes: accepted ones with their trades, banned ones with the reason."""
    accepted, rejected = specs(t, "validate")
    found = R.evaluate(accepted, metrics(t), R.LEVERS).select("id", "core_key", "exit_bits", "size_index", "trades")
    return found.unionByName(rejected, allowMissingColumns=True)


@query("r02_lever_cells", f"""
SELECT {_KEYS}, CAST(trades AS DOUBLE) AS trades, round(sharpe, 5) AS sharpe, round(ret, 5) AS ret, round(maxdd, 5) AS maxdd,
  round(top20, 5) AS top20
FROM ox_lever_stats JOIN ox_lever_dd USING ({_KEYS})""")
def r02_cells(t):
    out = V.lever_metrics(counted(t), REQUIRED).select(*R.CELL, *R.LEVERS, "trades", "sharpe", "ret", "maxdd", "top20")
    return rounded(out, "sharpe", "ret", "maxdd", "top20", digits=5)


@query("r02_order_spread", f"""
SELECT {_KEYS}, round(mean_ret, 5) AS mean_ret,
  CASE WHEN abs(cv) < 0.000005 THEN 0.0::DOUBLE ELSE round(cv, 5) END AS cv FROM ({SPREAD_SQL})""")
def r02_spread(t):
    found = V.order_spread(counted(t), REQUIRED, seeds=SEEDS)
    seen = F.when(F.abs("cv") < 0.000005, F.lit(0.0)).otherwise(F.col("cv"))  # no negative zero
    return rounded(found.withColumn("cv", seen), "mean_ret", "cv", digits=5)


_LEVER_DSR = f"""SELECT *, CASE WHEN n_obs >= 2 THEN {normal_cdf_sql("z")} ELSE 0.0 END AS dsr FROM (
  SELECT *, (sr_hat - {chance_sharpe(TRIALS, VARIANCE)!r}) * sqrt(greatest(n_obs - 1, 0)) / sqrt(greatest(1e-12,
    1 - coalesce(skew, 0) * sr_hat + (coalesce(kurtosis, 3) - 1) / 4 * sr_hat * sr_hat)) AS z FROM ox_lever_records)"""
FRONTIER_SQL = """
SELECT a.id FROM ox_lever_records a WHERE a.val_trades > 0 AND NOT EXISTS (
  SELECT 1 FROM ox_lever_records b WHERE b.val_trades > 0 AND b.val_sharpe >= a.val_sharpe AND b.val_ret >= a.val_ret
    AND b.val_maxdd >= a.val_maxdd AND coalesce(b.val_top20, 1) <= coalesce(a.val_top20, 1) AND b.val_cv <= a.val_cv
    AND (b.val_sharpe > a.val_sharpe OR b.val_ret > a.val_ret OR b.val_maxdd > a.val_maxdd
         OR coalesce(b.val_top20, 1) < coalesce(a.val_top20, 1) OR b.val_cv < a.val_cv))"""


def frontier(t):
    return R.pareto_frontier(validate_records(t))


@query("k09_lever_frontier", FRONTIER_SQL)
def k09(t):
    """The frontier with a live spread over orders as its fifth objective."""
    return frontier(t)


@query("r07_core_gate", f"""
SELECT id, val_sharpe, val_trades, CASE WHEN val_trades < {GATES.min_validate_trades} THEN 'too few validate trades'
    WHEN size_index = 0 THEN 'variant of an existing core'
    WHEN val_sharpe < (SELECT greatest(coalesce(max(val_sharpe), 0), 0) FROM ox_lever_records WHERE size_index = 0)
      + {GATES.nominee_margin} THEN 'no margin over the best incumbent' END AS rejected_because
FROM ({_LEVER_DSR}) WHERE dsr >= {GATES.dsr_pass} AND id IN ({FRONTIER_SQL})""")
def r07(t):
    """Specs of flat sizes are already in the ledger: whatever shares their core is a variant."""
    records = R.with_deflated_sharpe(validate_records(t), n_trials=TRIALS, sr_variance=VARIANCE)
    return R.nominees(records, records.where("size_index = 0"), frontier(t), GATES).select(
        "id", "val_sharpe", "val_trades", "rejected_because")


@query("r08_core_keys", "SELECT core_key, count(*) AS n_specs, sum(val_trades) AS trades FROM ox_lever_records GROUP BY core_key")
def r08(t):
    return validate_records(t).groupBy("core_key").agg(F.count(F.lit(1)).alias("n_specs"), F.sum("val_trades").alias("trades"))
