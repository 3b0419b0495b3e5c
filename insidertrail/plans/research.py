"""Queries on the comparison of many strategy specifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from insidertrail.functions.scalars import ATOMS
from insidertrail.operators import research as R
from insidertrail.params import RESEARCH
from insidertrail.plans.helpers import flagged, rounded
from insidertrail.plans.oracle_views import chance_sharpe, deflated_sharpe_sql, normal_quantile_sql, spec_id_sql
from insidertrail.plans.registry import query

HOLDS = [20, 60]
WINDOWS = [("train", None, "1997-12-31"), ("validate", "1998-01-01", "1999-12-31")]
REQUIRED = [64, *range(1, 64)]


def spec_trades(t):
    base = (F.col("cluster_size") >= 2) & (F.col("total_value") >= 25_000)
    return t.stage("spec_trades", lambda: R.spec_trades(flagged(t), t.prices, HOLDS, base))


def metrics(t):
    """Metrics of every cell, written once per application."""
    return t.stage("cell_metrics", lambda: compute_metrics(t))


def compute_metrics(t):
    return R.cell_metrics(R.counted_trades(spec_trades(t), REQUIRED, WINDOWS), REQUIRED)


def specs(t, window):
    grid = R.spec_grid(t.spark, list(ATOMS), HOLDS, window)
    known = t.spark.createDataFrame([(w, None, None) for w, _, _ in WINDOWS], R.WINDOW_SCHEMA)
    return R.resolve_specs(grid, known)[0]


def results(t, window):
    """Specs of one window with metrics at the precision the ledger stores."""
    out = R.evaluate(specs(t, window), metrics(t))
    return rounded(out, "sharpe", "ret", "maxdd", "top20", "cv", digits=4)


def validate_records(t):
    return results(t, "validate").select(
        "id", "base", "atoms", "complexity", "core_key", "sr_hat", "n_obs", "skew", "kurtosis",
        *[F.col(c).alias(f"val_{c}") for c in ("sharpe", "ret", "maxdd", "top20", "cv", "trades")])


@query("r01_resolve_specs", """
SELECT id, complexity, val_trades AS trades FROM ox_validate""")
def r01(t):
    return R.evaluate(specs(t, "validate"), metrics(t)).select("id", "complexity", "trades")


@query("r02_evaluate_specs", """
SELECT required, hold_days, "window", CAST(trades AS DOUBLE) AS trades, round(sharpe, 5) AS sharpe, round(ret, 5) AS ret,
  round(maxdd, 5) AS maxdd, round(top20, 5) AS top20
FROM ox_cell_stats JOIN ox_cell_dd USING (required, hold_days, "window")""")
def r02(t):
    out = compute_metrics(t).select(F.col("required").cast("bigint"), "hold_days", "window", "trades", "sharpe", "ret", "maxdd", "top20")
    return rounded(out, "sharpe", "ret", "maxdd", "top20", digits=5)


@query("r03_trade_statistics", """
SELECT required, hold_days, "window", trades AS n_obs, round(sr_hat, 6) AS sr_hat, round(skew, 5) AS skew, round(kurtosis, 5) AS kurtosis
FROM ox_cell_stats""")
def r03(t):
    m = metrics(t).select(
        F.col("required").cast("bigint"), "hold_days", "window", F.col("n_obs").cast("bigint"), "sr_hat", "skew", "kurtosis")
    return rounded(rounded(m, "sr_hat"), "skew", "kurtosis", digits=5)


def _deflated(n_trials, sr_variance):
    return deflated_sharpe_sql(repr(chance_sharpe(n_trials, sr_variance)))


@query("r04_deflated_sharpe", f"""
SELECT {spec_id_sql("d")} AS id, round(sr_hat, 6) AS sr_hat, n_obs, round(dsr, 6) AS deflated_sharpe
FROM ({_deflated(128, 0.01)}) d""")
def r04(t):
    return rounded(R.with_deflated_sharpe(results(t, "validate"), n_trials=128, sr_variance=0.01).select(
        "id", "sr_hat", "n_obs", "deflated_sharpe"), "sr_hat", "deflated_sharpe")


def stored_ledger(t):
    """The ledger after two batches: the hold lengths of the validate window one after the other."""
    def build():
        records = validate_records(t).select("id", "sr_hat", F.when(F.col("id").endswith("_h20"), 1).otherwise(2).alias("batch"))
        return R.upsert_ledger(records.where("batch = 1"), records.where("batch = 2"))

    return t.stage("spec_ledger", build)


_LEDGER_VARIANCE = "round(0.5 * round(0.5 * v20, 6) + 0.5 * v60, 6)"
_LEDGER_CHANCE = f"""(SELECT sqrt({_LEDGER_VARIANCE}) * (0.42278433509846713 * {normal_quantile_sql("(1 - 1.0::DOUBLE / n)")}
    + 0.5772156649015329 * {normal_quantile_sql("(1 - 1.0::DOUBLE / (n * exp(1)))")})
  FROM (SELECT count(*) AS n, var_pop(sr_hat) FILTER (hold_days = 20) AS v20, var_pop(sr_hat) FILTER (hold_days = 60) AS v60
        FROM ox_cell_stats WHERE "window" = 'validate'))"""


@query("r04_ledger_fed", f"""
SELECT {spec_id_sql("d")} AS id, round(dsr, 6) AS deflated_sharpe FROM ({deflated_sharpe_sql(_LEDGER_CHANCE)}) d""")
def r04_ledger(t):
    """Trials and variance come from the stored ledger, which earlier batches filled."""
    return rounded(R.with_deflated_sharpe(results(t, "validate"), chance=R.ledger_trials(stored_ledger(t))["chance"]).select(
        "id", "deflated_sharpe"), "deflated_sharpe")


@query("r05_screen_and_confirm", f"""
SELECT {spec_id_sql("t")} AS id, CAST(bit_count(CASE WHEN t.required = 64 THEN 0 ELSE t.required END) AS INT) AS complexity,
  round(t.sharpe, 4) AS train_sharpe, round(v.sharpe, 4) AS val_sharpe, round(v.dsr, 4) AS deflated_sharpe
FROM ox_cell_stats t LEFT JOIN ({_deflated(128, 0.01)}) v
  ON v.required = t.required AND v.hold_days = t.hold_days AND t.sharpe >= {RESEARCH.train_screen_sharpe}
WHERE t."window" = 'train'""")
def r05(t):
    """Train screen, then validate metrics of the specs that pass."""
    asked = R.refuse_locked_window(specs(t, "train").unionByName(specs(t, "validate")))
    train = R.evaluate(asked.where("window = 'train'"), metrics(t))
    validate = R.evaluate(asked.where("window = 'validate'"), metrics(t))
    out = R.screen_and_confirm(train, validate, n_trials=128, sr_variance=0.01)
    return rounded(out.select("id", "complexity", "train_sharpe", "val_sharpe", "deflated_sharpe"),
                   "train_sharpe", "val_sharpe", "deflated_sharpe", digits=4)


@query("r06_ledger_upsert", """
SELECT id, CASE WHEN id LIKE '%_h20' THEN val_sharpe ELSE -1.0::DOUBLE END AS val_sharpe FROM ox_validate""")
def r06(t):
    records = validate_records(t).select("id", "val_sharpe")
    stored = records.withColumn("val_sharpe", F.lit(-1.0))
    return R.upsert_ledger(stored, records.where("id LIKE '%_h20'"))


@query("r06_sharpe_variance", """
SELECT round(0.5::DOUBLE * 0.02 + 0.5 * var_pop(sr_hat), 6) AS sr_variance FROM ox_cell_stats WHERE "window" = 'validate'""")
def r06_variance(t):
    return R.updated_sharpe_variance(validate_records(t), 0.02)


FRONTIER_SQL = """
SELECT a.id FROM ox_validate a WHERE a.val_trades > 0 AND NOT EXISTS (
  SELECT 1 FROM ox_validate b WHERE b.val_trades > 0 AND b.val_sharpe >= a.val_sharpe AND b.val_ret >= a.val_ret
    AND b.val_maxdd >= a.val_maxdd AND coalesce(b.val_top20, 1) <= coalesce(a.val_top20, 1)
    AND coalesce(b.val_cv, 1) <= coalesce(a.val_cv, 1)
    AND (b.val_sharpe > a.val_sharpe OR b.val_ret > a.val_ret OR b.val_maxdd > a.val_maxdd
         OR coalesce(b.val_top20, 1) < coalesce(a.val_top20, 1) OR coalesce(b.val_cv, 1) < coalesce(a.val_cv, 1)))"""
NOMINEE_SQL = f"""
SELECT r.id, r.val_sharpe, r.val_trades, CASE WHEN r.val_trades < {RESEARCH.min_validate_trades} THEN 'too few validate trades'
    WHEN r.val_sharpe < (SELECT greatest(coalesce(max(val_sharpe), 0), 0) FROM ox_validate WHERE complexity = 6)
      + {RESEARCH.nominee_margin} THEN 'no margin over the best incumbent' END AS rejected_because
FROM ox_validate r JOIN ({_deflated(2, 1e-6)}) d ON r.id = {spec_id_sql("d")}
WHERE d.dsr >= {RESEARCH.dsr_pass} AND r.id IN ({FRONTIER_SQL})"""


def nominee_rows(t):
    records = R.with_deflated_sharpe(validate_records(t), n_trials=2, sr_variance=1e-6)
    stored = records.where("complexity = 6").withColumn("core_key", F.lit("older"))
    return R.nominees(records, stored, R.pareto_frontier(records))


@query("r07_stall_counter", f"""
SELECT CASE WHEN count(*) FILTER (rejected_because IS NULL) > 0 THEN 0 ELSE 4 END AS stall_counter FROM ({NOMINEE_SQL})""")
def r07_stall(t):
    """A round without a nominee raises the counter by one, a nominee sets it back."""
    return R.next_stall_counter(3, nominee_rows(t))


@query("r07_nominee_gate", NOMINEE_SQL)
def r07(t):
    return nominee_rows(t).select("id", "val_sharpe", "val_trades", "rejected_because")


@query("r08_complexity", "SELECT complexity, count(*) AS n_specs, 'cluster_buy||0.0|' AS core_key FROM ox_validate GROUP BY complexity")
def r08(t):
    return validate_records(t).groupBy("complexity", "core_key").agg(F.count(F.lit(1)).alias("n_specs"))


@query("k09_pareto_frontier", FRONTIER_SQL)
def k09(t):
    return R.pareto_frontier(validate_records(t))
