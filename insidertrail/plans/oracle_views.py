"""Intermediate results in plain SQL, written independently of the Spark operators.

Each view is a direct statement of the definition (range joins, correlated
windows), not of the way the operators compute it.
"""

CSUITE_SQL = ("(NOT contains(upper(role_title), 'VICE') AND regexp_matches(upper(role_title), "
              "'\\b(?:CEO|CFO|COO|CTO|CHIEF EXECUTIVE OFFICER|CHIEF FINANCIAL OFFICER|"
              "CHIEF OPERATING OFFICER|CHIEF TECHNOLOGY OFFICER|PRESIDENT|CHAIRMAN)\\b'))")

ORACLE_VIEWS = {
    "ox_px": """
SELECT ticker, date, adj_close, volume,
       row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM fx_prices""",
    "ox_trades": """
SELECT t.txn_id, t.insider_id, t.company_id, t.transaction_date AS d, c.ticker,
       CASE c.sector WHEN 'Technology' THEN 'XLK' WHEN 'Energy' THEN 'XLE' END AS fund
FROM fx_transactions t JOIN fx_companies c USING (company_id) WHERE t.is_discretionary""",
    "ox_keys": "SELECT DISTINCT ticker, fund, d FROM ox_trades",
    "ox_points": """
SELECT ticker, fund, d, 0 AS h, d AS pt FROM ox_keys
UNION ALL
SELECT ticker, fund, d, k AS h, pt FROM (
  SELECT q.ticker, q.fund, q.d, p.date AS pt,
         row_number() OVER (PARTITION BY q.ticker, q.fund, q.d ORDER BY p.date) AS k
  FROM ox_keys q JOIN ox_px p ON p.ticker = q.ticker AND p.date > q.d AND p.date <= q.d + 200)
WHERE k IN (20, 60, 120)""",
    "ox_near": """
SELECT q.ticker, q.fund, q.d, q.h, s.series,
       arg_min(p.adj_close, abs(p.date - q.pt) * 2 + CASE WHEN p.date < q.pt THEN 1 ELSE 0 END) AS px
FROM (SELECT *, ticker AS stock, 'SPY' AS bench FROM ox_points) q
CROSS JOIN (VALUES ('stock'), ('bench'), ('sector')) s(series)
JOIN ox_px p ON p.ticker = CASE s.series WHEN 'stock' THEN q.stock WHEN 'bench' THEN q.bench ELSE q.fund END
  AND p.date BETWEEN q.pt - 5 AND q.pt + 5 AND p.date <= q.d + 200
GROUP BY q.ticker, q.fund, q.d, q.h, s.series""",
    "ox_momentum": """
SELECT ticker, d, CASE WHEN count(*) >= 5 THEN max(CASE WHEN up = 1 THEN adj_close END)
         / max(CASE WHEN up = least(cnt, 20) THEN adj_close END) - 1 END AS prior_momentum_20d
FROM (SELECT q.ticker, q.d, p.adj_close,
        row_number() OVER (PARTITION BY q.ticker, q.d ORDER BY p.date DESC) AS up,
        count(*) OVER (PARTITION BY q.ticker, q.d) AS cnt
      FROM (SELECT DISTINCT ticker, d FROM ox_keys) q
      JOIN ox_px p ON p.ticker = q.ticker AND p.date BETWEEN q.d - 40 AND q.d - 1)
GROUP BY ticker, d""",
    "ox_wide": """
SELECT ticker, fund, d,
       max(CASE WHEN h = 0 AND series = 'stock' THEN px END) AS s0,
       max(CASE WHEN h = 20 AND series = 'stock' THEN px END) AS s20,
       max(CASE WHEN h = 60 AND series = 'stock' THEN px END) AS s60,
       max(CASE WHEN h = 120 AND series = 'stock' THEN px END) AS s120,
       max(CASE WHEN h = 0 AND series = 'bench' THEN px END) AS b0,
       max(CASE WHEN h = 20 AND series = 'bench' THEN px END) AS b20,
       max(CASE WHEN h = 60 AND series = 'bench' THEN px END) AS b60,
       max(CASE WHEN h = 120 AND series = 'bench' THEN px END) AS b120,
       max(CASE WHEN h = 0 AND series = 'sector' THEN px END) AS f0,
       max(CASE WHEN h = 20 AND series = 'sector' THEN px END) AS f20,
       max(CASE WHEN h = 60 AND series = 'sector' THEN px END) AS f60,
       max(CASE WHEN h = 120 AND series = 'sector' THEN px END) AS f120
FROM ox_near GROUP BY ticker, fund, d""",
    "ox_outcomes": """
SELECT t.txn_id, m.prior_momentum_20d,
       CASE WHEN b20 IS NOT NULL THEN s20 / s0 - 1 END AS stock_return_20d,
       CASE WHEN s20 IS NOT NULL THEN b20 / b0 - 1 END AS benchmark_return_20d,
       CASE WHEN s20 IS NOT NULL AND b20 IS NOT NULL THEN f20 / f0 - 1 END AS sector_return_20d,
       (s20 / s0 - 1) - (b20 / b0 - 1) AS excess_return_20d, (s20 / s0 - 1) - (b20 / b0 - 1) > 0 AS hit_20d,
       CASE WHEN b60 IS NOT NULL THEN s60 / s0 - 1 END AS stock_return_60d,
       CASE WHEN s60 IS NOT NULL THEN b60 / b0 - 1 END AS benchmark_return_60d,
       CASE WHEN s60 IS NOT NULL AND b60 IS NOT NULL THEN f60 / f0 - 1 END AS sector_return_60d,
       (s60 / s0 - 1) - (b60 / b0 - 1) AS excess_return_60d, (s60 / s0 - 1) - (b60 / b0 - 1) > 0 AS hit_60d,
       CASE WHEN b120 IS NOT NULL THEN s120 / s0 - 1 END AS stock_return_120d,
       CASE WHEN s120 IS NOT NULL THEN b120 / b0 - 1 END AS benchmark_return_120d,
       CASE WHEN s120 IS NOT NULL AND b120 IS NOT NULL THEN f120 / f0 - 1 END AS sector_return_120d,
       (s120 / s0 - 1) - (b120 / b0 - 1) AS excess_return_120d, (s120 / s0 - 1) - (b120 / b0 - 1) > 0 AS hit_120d
FROM ox_trades t JOIN ox_wide w ON w.ticker = t.ticker AND w.d = t.d AND w.fund IS NOT DISTINCT FROM t.fund
LEFT JOIN ox_momentum m ON m.ticker = t.ticker AND m.d = t.d
WHERE w.s0 IS NOT NULL AND w.b0 IS NOT NULL""",
    "ox_lots": """
SELECT t.*, c.ticker, i.name AS insider_name, o.excess_return_20d, o.excess_return_60d, o.excess_return_120d,
       o.hit_20d, o.hit_60d, o.hit_120d, o.prior_momentum_20d, o.stock_return_60d
FROM fx_transactions t JOIN ox_outcomes o USING (txn_id) JOIN fx_companies c USING (company_id)
JOIN fx_insiders i USING (insider_id)
WHERE t.is_discretionary AND NOT i.is_institution AND coalesce(t.is_common_stock, true)""",
    "ox_buys": """
SELECT insider_id, company_id, transaction_date, min(txn_id) AS txn_id,
       arg_min(filing_date, txn_id) AS filing_date, arg_min(ticker, txn_id) AS ticker,
       arg_min(insider_name, txn_id) AS insider_name,
       sum(shares) AS shares, sum(total_value) AS total_value,
       arg_min(price_per_share, txn_id) FILTER (price_per_share IS NOT NULL) AS price_per_share,
       arg_max(shares_owned_after, txn_id) FILTER (shares_owned_after IS NOT NULL) AS shares_owned_after,
       arg_min(is_10b5_1_plan, txn_id) FILTER (is_10b5_1_plan IS NOT NULL) AS is_10b5_1_plan,
       arg_min(excess_return_60d, txn_id) FILTER (excess_return_60d IS NOT NULL) AS excess_return_60d,
       arg_min(hit_60d, txn_id) FILTER (hit_60d IS NOT NULL) AS hit_60d,
       arg_min(prior_momentum_20d, txn_id) FILTER (prior_momentum_20d IS NOT NULL) AS prior_momentum_20d,
       arg_min(stock_return_60d, txn_id) FILTER (stock_return_60d IS NOT NULL) AS stock_return_60d
FROM ox_lots GROUP BY insider_id, company_id, transaction_date""",
    "ox_panel": """
SELECT ticker, date, adj_close, volume, rn,
       adj_close / lag(adj_close, 60) OVER w - 1 AS ret_60, adj_close / lag(adj_close, 5) OVER w - 1 AS ret_5,
       CASE WHEN rn >= 20 THEN avg(volume) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS avg_volume_20d,
       CASE WHEN rn >= 20 THEN avg(adj_close * volume) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END
         AS adv_dollar_20d,
       CASE WHEN rn >= 20 THEN max(adj_close) OVER (w ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) END AS high_52w,
       CASE WHEN rn >= 21 THEN stddev_samp(lr) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS realized_vol
FROM (SELECT *, ln(adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date)) AS lr FROM ox_px)
WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    "ox_price_flags": """
SELECT b.*, p.ret_60 AS prior_return_60td, p.ret_5 AS short_momentum_5d, p.avg_volume_20d,
       coalesce(p.ret_60 <= -0.15, false) AS drawdown_flag,
       coalesce(p.ret_60 <= -0.15 AND p.ret_5 < 0, false) AS still_falling
FROM ox_buys b ASOF LEFT JOIN ox_panel p ON b.ticker = p.ticker AND b.transaction_date >= p.date""",
    "ox_role_marks": """
SELECT insider_id, company_id, role_title,
       CASE WHEN is_officer THEN 'officer' WHEN is_director THEN 'director' ELSE '10pct_owner' END AS category,
       role_title = 'Chief Executive Officer' AS ceo, role_title = 'CFO' AS cfo FROM fx_roles""",
    "ox_cluster": """
SELECT b.txn_id, count(DISTINCT o.insider_id) AS cluster_size, count(DISTINCT r.category) AS mix,
       bool_or(coalesce(r.ceo, false)) AND bool_or(coalesce(r.cfo, false)) AS both_heads
FROM ox_buys b JOIN ox_buys o ON o.company_id = b.company_id
  AND o.transaction_date BETWEEN b.transaction_date - 7 AND b.transaction_date
LEFT JOIN ox_role_marks r ON r.insider_id = o.insider_id AND r.company_id = b.company_id
GROUP BY b.txn_id""",
    "ox_routine": """
SELECT DISTINCT insider_id FROM (
  SELECT insider_id, m, y - row_number() OVER (PARTITION BY insider_id, m ORDER BY y) AS island
  FROM (SELECT DISTINCT insider_id, year(transaction_date) AS y, month(transaction_date) AS m FROM ox_buys))
GROUP BY insider_id, m, island HAVING count(*) >= 3""",
    "ox_first": """
SELECT txn_id, row_number() OVER (PARTITION BY insider_id ORDER BY transaction_date, company_id, txn_id) = 1
         AS is_first_buy FROM ox_buys""",
    "ox_edges": """
SELECT quantile_cont(avg_volume_20d, 0.2) AS q1, quantile_cont(avg_volume_20d, 0.4) AS q2,
       quantile_cont(avg_volume_20d, 0.6) AS q3, quantile_cont(avg_volume_20d, 0.8) AS q4
FROM ox_price_flags""",
    "ox_flagged": """
SELECT f.*, r.role_title, c.cluster_size, c.cluster_size >= 2 AS is_cluster,
       CASE WHEN c.cluster_size >= 2 THEN c.mix ELSE 0 END AS cluster_role_diversity,
       c.cluster_size >= 2 AND c.mix >= 2 AS cluster_has_mixed_roles,
       c.cluster_size >= 2 AND c.both_heads AS cluster_has_ceo_and_cfo,
       n.is_first_buy, f.transaction_date - s.since AS tenure_days,
       n.is_first_buy AND coalesce(f.transaction_date - s.since, 0) >= 730 AS first_time_conviction,
       ro.insider_id IS NOT NULL AS is_routine,
       greatest(f.filing_date - f.transaction_date, 0) AS filing_lag_days,
       CASE WHEN f.avg_volume_20d IS NULL THEN NULL WHEN f.avg_volume_20d <= e.q1 THEN 1
            WHEN f.avg_volume_20d <= e.q2 THEN 2 WHEN f.avg_volume_20d <= e.q3 THEN 3
            WHEN f.avg_volume_20d <= e.q4 THEN 4 ELSE 5 END AS liquidity_quintile
FROM ox_price_flags f JOIN ox_cluster c USING (txn_id) JOIN ox_first n USING (txn_id)
CROSS JOIN ox_edges e
LEFT JOIN ox_routine ro ON ro.insider_id = f.insider_id
LEFT JOIN (SELECT insider_id, company_id, min(role_title) AS role_title FROM fx_roles GROUP BY 1, 2) r
  ON r.insider_id = f.insider_id AND r.company_id = f.company_id
LEFT JOIN (SELECT insider_id, min(first_filing_date) AS since FROM fx_roles GROUP BY 1) s
  ON s.insider_id = f.insider_id""",
    "ox_events": """
SELECT insider_id, company_id, transaction_date, txn_id, total_value, event_total_value,
       excess_return_60d, hit_60d, prior_momentum_20d FROM (
  SELECT t.*, o.excess_return_60d, o.hit_60d, o.prior_momentum_20d,
         row_number() OVER (PARTITION BY t.insider_id, t.company_id, t.transaction_date
                            ORDER BY coalesce(t.total_value, 0) DESC, t.txn_id) AS pick,
         sum(coalesce(t.total_value, 0)) OVER (PARTITION BY t.insider_id, t.company_id, t.transaction_date)
           AS event_total_value
  FROM fx_transactions t JOIN ox_outcomes o USING (txn_id)
  WHERE t.is_discretionary AND coalesce(t.is_common_stock, true) AND o.excess_return_60d IS NOT NULL)
WHERE pick = 1""",
    "ox_records": """
SELECT insider_id, count(*) AS n, count(*) FILTER (hit_60d) AS hits, avg(excess_return_60d) AS mean_y,
       sum(excess_return_60d) AS sum_y, stddev_samp(excess_return_60d) AS std_y,
       CASE WHEN count(prior_momentum_20d) >= 5 AND max(prior_momentum_20d) > min(prior_momentum_20d)
            THEN regr_intercept(excess_return_60d, prior_momentum_20d) END AS icpt
FROM ox_events GROUP BY insider_id""",
    "ox_score_input": """
SELECT i.insider_id, coalesce(r.n, 0) AS n, coalesce(r.hits, 0) AS hits, r.mean_y, r.sum_y, r.std_y, r.icpt
FROM (SELECT DISTINCT insider_id FROM fx_transactions t JOIN fx_insiders USING (insider_id)
      WHERE is_discretionary AND NOT is_institution) i LEFT JOIN ox_records r USING (insider_id)""",
}

ORACLE_VIEWS["ox_raw_events"] = """
SELECT event_id AS seq, CAST(event_id % 25 AS INT) AS company_id,
       CASE event_id % 4 WHEN 1 THEN 'SC 13D' WHEN 2 THEN 'SC 13G' ELSE '8-K' END AS form_type,
       concat('E', CAST(event_id // 2 AS VARCHAR)) AS accession_number,
       CASE WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS filing_date,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS report_date,
       CASE event_id % 3 WHEN 0 THEN '2.02,9.01' WHEN 1 THEN NULL ELSE '5.02' END AS items FROM events"""
ORACLE_VIEWS["ox_filing_events"] = """
SELECT accession_number, company_id, form_type, filing_date, report_date, items FROM (
  SELECT *, row_number() OVER (PARTITION BY accession_number ORDER BY seq) AS pick FROM ox_raw_events)
WHERE pick = 1 AND filing_date IS NOT NULL"""


def score_sql(source: str, keys: str) -> str:
    """Score columns over rows with n, hits, mean_y, sum_y, std_y, icpt."""
    return f"""
SELECT {keys}, n, hits, raw_hit_rate, hr AS bayesian_hit_rate, conf AS confidence, mean_y AS avg_excess_return,
       shrunk AS shrunk_excess, adj AS momentum_adjusted_excess, cred AS credibility_weight, sigma,
       skill AS skill_score,
       CASE WHEN n < 3 THEN 'Insufficient' WHEN skill >= 1.5 AND conf >= 0.8 AND n >= 6 THEN 'Elite'
            WHEN skill >= 0.8 AND conf >= 0.65 THEN 'Strong' WHEN skill >= 0 THEN 'Average' ELSE 'Weak' END AS tier
FROM (SELECT *, CASE WHEN n < 3 THEN 0.0 ELSE cred * (0.5 * ln(greatest(0.01, least(0.99, hr))
                 / (1 - greatest(0.01, least(0.99, hr)))) + 0.5 * adj / 0.15) END AS skill
  FROM (SELECT *, CASE WHEN n >= 3 THEN coalesce(icpt, shrunk) END AS adj FROM (
    SELECT {keys}, q.n, q.hits, icpt, CASE WHEN n >= 3 THEN mean_y END AS mean_y,
      CASE WHEN n >= 3 THEN hits / n END AS raw_hit_rate,
      CASE WHEN n >= 3 THEN (5.5 + hits) / (10 + n) END AS hr,
      CASE WHEN n >= 3 THEN (0.05 + sum_y) / (5 + n) END AS shrunk,
      least(1.0, sqrt(n / 8)) AS cred,
      CASE WHEN n >= 3 THEN CASE WHEN std_y > 0 THEN std_y ELSE 0.15 END END AS sigma,
      CASE WHEN n >= 3 THEN 1 - (0.4914370405459887
        - coalesce(list_sum(list_transform(range(hits), lambda i: exp((5.5 + i) * ln(0.55) + 4.5 * ln(0.45)
            + lgamma(10.0 + i) - lgamma(6.5 + i) - lgamma(4.5)))), 0)
        + coalesce(list_sum(list_transform(range(n - hits), lambda j: exp((5.5 + hits) * ln(0.55)
            + (4.5 + j) * ln(0.45) + lgamma(10.0 + hits + j) - lgamma(5.5 + hits) - lgamma(5.5 + j)))), 0)) END AS conf
    FROM {source} q)))"""


RECORD_SQL = """count(excess_return_60d) AS n, count(*) FILTER (hit_60d) AS hits, avg(excess_return_60d) AS mean_y,
       sum(excess_return_60d) AS sum_y, stddev_samp(excess_return_60d) AS std_y,
       CASE WHEN count(prior_momentum_20d) >= 5 AND max(prior_momentum_20d) > min(prior_momentum_20d)
            THEN regr_intercept(excess_return_60d, prior_momentum_20d) END AS icpt"""

ORACLE_VIEWS["ox_scores"] = score_sql("ox_score_input", "insider_id")
ORACLE_VIEWS["ox_asof_cached_input"] = f"""
SELECT r.insider_id, r.as_of, {RECORD_SQL} FROM
 (SELECT DISTINCT insider_id, transaction_date AS as_of FROM fx_transactions WHERE is_discretionary) r
LEFT JOIN (SELECT * FROM (SELECT t.insider_id, t.transaction_date, o.excess_return_60d, o.hit_60d, o.prior_momentum_20d,
             row_number() OVER (PARTITION BY t.insider_id, t.transaction_date ORDER BY t.txn_id) AS pick
           FROM fx_transactions t JOIN ox_outcomes o USING (txn_id)
           WHERE t.is_discretionary AND o.excess_return_60d IS NOT NULL) WHERE pick = 1) e
  ON e.insider_id = r.insider_id AND e.transaction_date < r.as_of
GROUP BY r.insider_id, r.as_of"""
ORACLE_VIEWS["ox_asof_direct_input"] = f"""
SELECT r.insider_id, r.as_of, {RECORD_SQL} FROM
 (SELECT DISTINCT insider_id, transaction_date AS as_of FROM fx_transactions WHERE is_discretionary) r
LEFT JOIN (SELECT * FROM (SELECT t.insider_id, t.transaction_date, o.excess_return_60d, o.hit_60d, o.prior_momentum_20d,
             row_number() OVER (PARTITION BY t.insider_id, t.company_id, t.transaction_date
                                ORDER BY coalesce(t.total_value, 0) DESC, t.txn_id) AS pick
           FROM fx_transactions t JOIN ox_outcomes o USING (txn_id)
           WHERE t.is_discretionary AND o.excess_return_60d IS NOT NULL) WHERE pick = 1) e
  ON e.insider_id = r.insider_id AND e.transaction_date < r.as_of
GROUP BY r.insider_id, r.as_of"""
ORACLE_VIEWS["ox_asof_cached"] = score_sql("ox_asof_cached_input", "insider_id, as_of")
ORACLE_VIEWS["ox_asof_direct"] = score_sql("ox_asof_direct_input", "insider_id, as_of")
ORACLE_VIEWS["ox_peers"] = """
SELECT d.company_id, d.transaction_date, count(DISTINCT m.insider_id) AS unique_buyers
FROM (SELECT DISTINCT company_id, transaction_date FROM fx_transactions) d
JOIN (SELECT t.* FROM fx_transactions t JOIN fx_insiders i USING (insider_id)
      WHERE t.is_discretionary AND NOT i.is_institution) m
  ON m.company_id = d.company_id AND m.transaction_date BETWEEN d.transaction_date - 7 AND d.transaction_date + 7
GROUP BY d.company_id, d.transaction_date"""
ORACLE_VIEWS["ox_eligible"] = """
SELECT * FROM (
  SELECT t.*, s.total AS txn_value, row_number() OVER (PARTITION BY t.insider_id, t.company_id, t.transaction_date
                                                       ORDER BY t.txn_id) AS pick
  FROM fx_transactions t JOIN fx_insiders i USING (insider_id)
  JOIN (SELECT insider_id, company_id, transaction_date, sum(total_value) AS total FROM fx_transactions
        WHERE is_discretionary GROUP BY 1, 2, 3) s USING (insider_id, company_id, transaction_date)
  WHERE t.is_discretionary AND NOT i.is_institution AND coalesce(t.is_common_stock, true)
    AND s.total BETWEEN 500 AND 10000000000) WHERE pick = 1"""
ORACLE_VIEWS["ox_alerts"] = """
SELECT e.txn_id AS transaction_id, e.insider_id, e.company_id,
       CASE WHEN coalesce(p.unique_buyers, 0) >= 2 AND e.txn_value >= 25000 THEN 'cluster_buy' ELSE 'filtered_out' END
         AS alert_type,
       e.txn_value / 100000 AS conviction_score, coalesce(s.skill_score, 0) AS insider_skill_score,
       e.txn_value AS transaction_value, e.transaction_date AS trade_date, concat('T', e.company_id) AS ticker
FROM ox_eligible e LEFT JOIN ox_peers p USING (company_id, transaction_date) LEFT JOIN ox_scores s USING (insider_id)"""

ORACLE_VIEWS["ox_cand"] = """
SELECT *, coalesce(filing_date, transaction_date) AS known_on FROM ox_flagged
WHERE cluster_size >= 2 AND total_value >= 25000"""
ORACLE_VIEWS["ox_last"] = """
SELECT ticker, max(date) AS last_date, arg_max(adj_close, date) AS last_price FROM ox_px GROUP BY ticker"""
ORACLE_VIEWS["ox_entry"] = """
SELECT c.*, e.date AS entry_date, e.adj_close AS entry_price, e.rn AS entry_rn
FROM ox_cand c ASOF JOIN ox_px e ON e.ticker = c.ticker AND c.known_on <= e.date"""
ORACLE_VIEWS["ox_trades60"] = """
SELECT e.*, 60 AS hold_days, coalesce(x.date, l.last_date) AS exit_date, coalesce(x.adj_close, l.last_price) AS exit_price,
       x.date IS NULL AS forced, 500 / e.entry_price AS shares_held,
       500 / e.entry_price * coalesce(x.adj_close, l.last_price) - 500 AS pnl,
       coalesce(x.adj_close, l.last_price) / e.entry_price - 1 AS pnl_pct
FROM ox_entry e LEFT JOIN ox_px x ON x.ticker = e.ticker AND x.rn = e.entry_rn + 60 JOIN ox_last l ON l.ticker = e.ticker"""
ORACLE_VIEWS["ox_first_trades"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY insider_id, ticker, entry_date ORDER BY known_on, txn_id) AS pick
               FROM ox_trades60) WHERE pick = 1"""
ORACLE_VIEWS["ox_sells"] = f"""
SELECT DISTINCT c.ticker, t.transaction_date AS date FROM fx_transactions t
JOIN fx_companies c USING (company_id) JOIN fx_roles r USING (insider_id, company_id)
WHERE t.transaction_code = 'S' AND {CSUITE_SQL}"""
ORACLE_VIEWS["ox_curve"] = """
SELECT d.date, d.bench, 1000000 + coalesce((SELECT sum(-500) FROM ox_first_trades t WHERE t.entry_date <= d.date), 0)
         + coalesce((SELECT sum(t.shares_held * t.exit_price) FROM ox_first_trades t WHERE t.exit_date <= d.date), 0) AS cash,
       coalesce(h.market_value, 0) AS market_value, coalesce(h.n, 0) AS num_positions
FROM (SELECT date, adj_close AS bench FROM fx_prices WHERE ticker = 'SPY'
       AND date BETWEEN (SELECT min(entry_date) FROM ox_first_trades) AND (SELECT max(exit_date) FROM ox_first_trades)) d
LEFT JOIN (SELECT s.date, sum(t.shares_held * p.adj_close) AS market_value, count(*) AS n
           FROM (SELECT g.date, g.ticker, p.adj_close FROM
                  (SELECT s.date, x.ticker FROM fx_prices s CROSS JOIN (SELECT DISTINCT ticker FROM ox_first_trades) x
                   WHERE s.ticker = 'SPY') g
                 ASOF JOIN ox_px p ON p.ticker = g.ticker AND g.date <= p.date) p
           JOIN (SELECT date FROM fx_prices WHERE ticker = 'SPY') s ON s.date = p.date
           JOIN ox_first_trades t ON t.ticker = p.ticker AND t.entry_date <= s.date AND t.exit_date > s.date
           GROUP BY s.date) h ON h.date = d.date"""

ORACLE_VIEWS["ox_spec_trades"] = """
SELECT txn_id, insider_id, ticker, known_on, own, entry_date, hold_days, exit_date, pnl, pnl_pct FROM (
  SELECT f.*, e.date AS entry_date, h.hold AS hold_days, coalesce(x.date, l.last_date) AS exit_date,
    500 / e.adj_close * coalesce(x.adj_close, l.last_price) - 500 AS pnl,
    coalesce(x.adj_close, l.last_price) / e.adj_close - 1 AS pnl_pct
  FROM (SELECT *, coalesce(filing_date, transaction_date) AS known_on,
      (CASE WHEN cluster_size >= 2 THEN 1 ELSE 0 END)
      + (CASE WHEN role_title IN ('Chief Executive Officer', 'CFO') THEN 2 ELSE 0 END)
      + (CASE WHEN total_value >= 100000 THEN 4 ELSE 0 END)
      + (CASE WHEN NOT coalesce(is_10b5_1_plan, false) THEN 8 ELSE 0 END)
      + (CASE WHEN NOT is_routine THEN 16 ELSE 0 END) + (CASE WHEN is_first_buy THEN 32 ELSE 0 END)
      + (CASE WHEN cluster_size >= 2 AND total_value >= 25000 THEN 64 ELSE 0 END) AS own FROM ox_flagged) f
  ASOF JOIN ox_px e ON e.ticker = f.ticker AND f.known_on <= e.date
  CROSS JOIN (VALUES (20), (60)) h(hold)
  LEFT JOIN ox_px x ON x.ticker = e.ticker AND x.rn = e.rn + h.hold JOIN ox_last l ON l.ticker = e.ticker)"""
ORACLE_VIEWS["ox_cells"] = """
SELECT * FROM (
  SELECT s.required, w.win AS "window", t.*, row_number() OVER (
      PARTITION BY s.required, t.hold_days, w.win, t.insider_id, t.ticker, t.entry_date ORDER BY t.known_on, t.txn_id) AS pick
  FROM ox_spec_trades t
  JOIN (SELECT CASE WHEN m = 0 THEN 64 ELSE m END AS required FROM range(64) r(m)) s ON (t.own & s.required) = s.required
  JOIN (VALUES ('train', DATE '1900-01-01', DATE '1997-12-31'), ('validate', DATE '1998-01-01', DATE '1999-12-31'))
    w(win, a, b) ON t.known_on BETWEEN w.a AND w.b)
WHERE pick = 1"""
ORACLE_VIEWS["ox_cell_stats"] = """
SELECT required, hold_days, "window", count(*) AS trades, sum(pnl) / 10000 AS ret,
  coalesce(avg(pnl_pct) / nullif(stddev_samp(pnl_pct), 0), 0) AS sr_hat,
  coalesce(avg(pnl_pct) / nullif(stddev_samp(pnl_pct), 0), 0) * sqrt(252 / hold_days) AS sharpe,
  avg(pow(pnl_pct - mu, 3)) / nullif(pow(var_pop(pnl_pct), 1.5), 0) AS skew,
  avg(pow(pnl_pct - mu, 4)) / nullif(pow(var_pop(pnl_pct), 2), 0) AS kurtosis,
  sum(CASE WHEN r <= 20 AND pnl > 0 THEN pnl END) / nullif(sum(CASE WHEN pnl > 0 THEN pnl END), 0) AS top20
FROM (SELECT *, avg(pnl_pct) OVER (PARTITION BY required, hold_days, "window") AS mu,
        row_number() OVER (PARTITION BY required, hold_days, "window" ORDER BY pnl DESC, txn_id) AS r FROM ox_cells)
GROUP BY required, hold_days, "window" """
ORACLE_VIEWS["ox_cell_dd"] = """
SELECT required, hold_days, "window", least(min((equity - peak) / peak), 0) AS maxdd FROM (
  SELECT *, greatest(10000, max(equity) OVER (PARTITION BY required, hold_days, "window" ORDER BY exit_date)) AS peak FROM (
    SELECT required, hold_days, "window", exit_date,
      10000 + sum(sum(pnl)) OVER (PARTITION BY required, hold_days, "window" ORDER BY exit_date) AS equity
    FROM ox_cells GROUP BY required, hold_days, "window", exit_date))
GROUP BY required, hold_days, "window" """
ORACLE_VIEWS["ox_validate"] = """
SELECT concat('m', CASE WHEN s.required = 64 THEN 0 ELSE s.required END, '_h', s.hold_days) AS id,
  CAST(bit_count(CASE WHEN s.required = 64 THEN 0 ELSE s.required END) AS INT) AS complexity,
  round(s.sharpe, 4) AS val_sharpe, round(s.ret, 4) AS val_ret, round(d.maxdd, 4) AS val_maxdd,
  round(s.top20, 4) AS val_top20, 0.0::DOUBLE AS val_cv, CAST(s.trades AS DOUBLE) AS val_trades
FROM ox_cell_stats s JOIN ox_cell_dd d USING (required, hold_days, "window") WHERE s."window" = 'validate'"""


def normal_cdf_sql(z: str) -> str:
    """The normal distribution as its power series within eight deviations."""
    return f"""CASE WHEN abs({z}) > 8 THEN CASE WHEN {z} > 0 THEN 1.0 ELSE 0.0 END
  ELSE abs(0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(160), lambda k:
    exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) - lgamma(2.0 * k + 2) + k * ln(2) + lgamma(k + 1.0))))) END"""


def deflated_sharpe_sql(expected_max: str) -> str:
    """(required, hold_days, dsr) of the validate window, given the Sharpe that chance alone would reach."""
    return f"""SELECT *, CASE WHEN n_obs >= 2 THEN {normal_cdf_sql("z")} ELSE 0.0 END AS dsr FROM (
  SELECT *, (sr_hat - {expected_max}) * sqrt(greatest(n_obs - 1, 0)) / sqrt(greatest(1e-12,
    1 - coalesce(skew, 0) * sr_hat + (coalesce(kurtosis, 3) - 1) / 4 * sr_hat * sr_hat)) AS z
  FROM (SELECT *, CAST(trades AS DOUBLE) AS n_obs FROM ox_cell_stats WHERE "window" = 'validate'))"""


def spec_id_sql(cell: str) -> str:
    return f"concat('m', CASE WHEN {cell}.required = 64 THEN 0 ELSE {cell}.required END, '_h', {cell}.hold_days)"


ORACLE_VIEWS["ox_matured"] = """
SELECT t.txn_id, later.date AS matured_on
FROM ox_trades t ASOF LEFT JOIN ox_px p ON p.ticker = t.ticker AND t.d >= p.date
JOIN ox_px later ON later.ticker = t.ticker AND later.rn = coalesce(p.rn, 0) + 60"""
ORACLE_VIEWS["ox_asof_matured_input"] = f"""
SELECT r.insider_id, r.as_of, {RECORD_SQL} FROM
 (SELECT DISTINCT insider_id, transaction_date AS as_of FROM fx_transactions WHERE is_discretionary) r
LEFT JOIN (SELECT e.*, m.matured_on FROM (SELECT * FROM (
             SELECT t.txn_id, t.insider_id, t.transaction_date, o.excess_return_60d, o.hit_60d, o.prior_momentum_20d,
                    row_number() OVER (PARTITION BY t.insider_id, t.transaction_date ORDER BY t.txn_id) AS pick
             FROM fx_transactions t JOIN ox_outcomes o USING (txn_id)
             WHERE t.is_discretionary AND o.excess_return_60d IS NOT NULL) WHERE pick = 1) e
           JOIN ox_matured m USING (txn_id)) e
  ON e.insider_id = r.insider_id AND e.matured_on < r.as_of
GROUP BY r.insider_id, r.as_of"""
ORACLE_VIEWS["ox_asof_matured"] = score_sql("ox_asof_matured_input", "insider_id, as_of")
ORACLE_VIEWS["ox_company_score_input"] = f"""
SELECT i.insider_id, i.company_id, coalesce(r.n, 0) AS n, coalesce(r.hits, 0) AS hits, r.mean_y, r.sum_y, r.std_y, r.icpt
FROM (SELECT DISTINCT insider_id, company_id FROM fx_transactions t JOIN fx_insiders USING (insider_id)
      WHERE is_discretionary AND NOT is_institution) i
LEFT JOIN (SELECT insider_id, company_id, {RECORD_SQL} FROM ox_events GROUP BY ALL) r USING (insider_id, company_id)"""
ORACLE_VIEWS["ox_company_scores"] = score_sql("ox_company_score_input", "insider_id, company_id")


def chance_sharpe(n_trials: int, sr_variance: float) -> float:
    """The largest Sharpe that chance alone would be expected to reach, for check SQL."""
    from math import e, sqrt
    from statistics import NormalDist

    q = NormalDist().inv_cdf
    return sqrt(sr_variance) * ((1 - 0.5772156649015329) * q(1 - 1 / n_trials) + 0.5772156649015329 * q(1 - 1 / (n_trials * e)))


def normal_quantile_sql(p: str) -> str:
    """The quantile by halving an interval of eight deviations fifty times."""
    at = normal_cdf_sql("((b[1] + b[2]) / 2)")
    return f"""list_reduce(
  list_prepend([-8.0::DOUBLE, 8.0::DOUBLE], list_transform(range(50), lambda k: [0.0::DOUBLE, 0.0::DOUBLE])),
  lambda b, k: CASE WHEN {at} < {p} THEN [(b[1] + b[2]) / 2, b[2]] ELSE [b[1], (b[1] + b[2]) / 2] END)[1]"""
