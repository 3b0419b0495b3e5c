"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from insidertrail.plans import QUERIES, trades
from insidertrail.plans import helpers as H
from insidertrail.plans import research, scores_and_signals
from insidertrail.plans.adapter import Tables
from insidertrail.session import build_session

# Tables later queries read; building each is timed on its own.
STAGES = {
    "stage_trade_outcomes": H.outcomes,
    "stage_buy_events": H.buy_events,
    "stage_flagged_buys": H.flagged,
    "stage_insider_scores": H.scores,
    "stage_alerts": scores_and_signals.alerts,
    "stage_trades": trades.first_trades,
    "stage_spec_trades": research.spec_trades,
}
HEADLINE = [
    "j04_asof_backward", "j06_n_rows_later", "j07_nearest_price", "j09_other_insider_buys",
    "a01_collapse_lots", "a12_score_refresh", "a13_as_of_score", "a15_cluster_flags", "a16_live_cluster_counts",
    "a28_volume_quintile", "w01_prior_return_60", "w04_realized_vol", "w07_routine_insiders", "w13_volume_percentiles",
    "g01_cluster_buy", "g05_live_features", "g06_buy_alerts", "b02_trade_ledger", "b10_concentration",
    "b11_trade_metrics", "b13_daily_equity", "r02_evaluate_specs", "f15_footnote_classes", "s02_bulk_transactions",
    "k01_alert_feed", "v07_reconcile",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", extra={
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        action()
        timings[name] = round(time.perf_counter() - start, 3)

    timed("warm_up", lambda: Tables(spark, sf_dir).transactions.count())
    warm = timings.pop("warm_up")
    for name, build in STAGES.items():
        timed(name, lambda: build(Tables(spark, sf_dir)))
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus),
                      "warm_up": warm}))


if __name__ == "__main__":
    main()
