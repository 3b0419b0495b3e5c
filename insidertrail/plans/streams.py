"""Streaming jobs driven to completion over the test tables' files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insidertrail.operators import signals as G
from insidertrail.plans.adapter import VIEW_SQL, Tables
from insidertrail.session import shared_folder
from insidertrail.plans.helpers import rounded
from insidertrail.plans.registry import query
from insidertrail.plans.scores_and_signals import _alert_out, _live, live_strategy, _ALERT_OUT
from insidertrail.streaming import jobs as J


def _paths(t: Tables, name: str) -> tuple[str, str]:
    root = f"{shared_folder(t.spark)}/insidertrail/{t.spark.sparkContext.applicationId}/streams/{name}-{uuid.uuid4().hex[:8]}"
    return f"{root}/out", f"{root}/checkpoint"


def _stream(t: Tables, table: str, view: str, **options) -> DataFrame:
    reader = t.spark.readStream.schema(t.base(table).schema).option("pathGlobFilter", f"{table}.parquet")
    source = reader.options(**options).parquet(t.sf_dir)
    return t.spark.sql(VIEW_SQL[view].replace(f"FROM {table}", "FROM {" + table + "}"), **{table: source})


def filings(t: Tables) -> DataFrame:
    """The filing stream; event time needs a zoned timestamp."""
    return _stream(t, "events", "fx_filing_stream").withColumn("filed_at", F.col("filed_at").cast("timestamp"))


@query("st01_unique_filings", "SELECT accession_id, filed_at, insider_id, company_id, transaction_code, total_value FROM fx_filing_stream")
def st01(t):
    """Every filing arrives twice and is kept once."""
    out, check = _paths(t, "st01")
    twice = filings(t).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    J.drain_to_table(J.unique_filings(twice), out, check)
    return t.spark.read.parquet(out).withColumn("filed_at", F.col("filed_at").cast("timestamp_ntz"))


def _halves(t: Tables, out: str) -> Iterator[DataFrame]:
    """The stream of a folder after the later half of the month has come, and again after the earlier one has."""
    landing, cut = f"{out}-landing", F.lit("2024-01-16").cast("timestamp")
    for older in (False, True):
        part = t.filing_stream.where((F.col("filed_at") < cut) if older else (F.col("filed_at") >= cut))
        part.write.mode("append").parquet(landing)
        yield t.spark.readStream.schema(t.filing_stream.schema).parquet(landing)


@query("st01_filings_loaded_once", """
SELECT accession_id, filed_at, insider_id, company_id, transaction_code, total_value FROM fx_filing_stream WHERE accession_id IS NOT NULL""")
def st01_once(t):
    """The month arrives in halves, the later one first, and then once more as a whole: every filing is stored once."""
    out, check = _paths(t, "st01-once")
    load = J.load_once(f"{out}/store", "accession_id", "filed_at")
    for stream in _halves(t, out):
        J.drain_batches(stream, load, check)
    J.drain_batches(stream, lambda batch, i: load(batch, 1_000 + i), f"{check}-again")
    return J.committed(t.spark, f"{out}/store", t.filing_stream.schema).drop("batch_id")


@query("st02_late_rows", """
SELECT accession_id, CASE WHEN filed_at < TIMESTAMP '2024-01-16 00:00:00' THEN 'backfill' ELSE 'stream' END AS route
FROM fx_filing_stream""")
def st02(t):
    """The second half of the month arrives first; the first half is then too late."""
    out, check = _paths(t, "st02")
    landing = f"{out}-landing"
    cut = F.lit("2024-01-16").cast("timestamp")
    for older in (False, True):
        part = t.filing_stream.where((F.col("filed_at") < cut) if older else (F.col("filed_at") >= cut))
        part.coalesce(1).write.mode("append").parquet(landing)
    stream = t.spark.readStream.schema(t.filing_stream.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    J.drain_batches(stream, J.route_late_rows(f"{out}/on_time", f"{out}/late"), check)
    read = t.spark.read.schema(t.filing_stream.schema)
    return (read.parquet(f"{out}/on_time").select("accession_id", F.lit("stream").alias("route"))
            .unionByName(read.parquet(f"{out}/late").select("accession_id", F.lit("backfill").alias("route"))))


@query("st03_daily_event_value", """
SELECT CAST(filed_at AS DATE) AS day, insider_id, company_id, round(sum(total_value), 4) AS day_value, count(*) AS lots
FROM fx_filing_stream WHERE transaction_code = 'P' GROUP BY 1, 2, 3""")
def st03(t):
    out, check = _paths(t, "st03")
    stream = J.daily_event_value(filings(t))
    J.drain_batches(stream, J.batch_partitions(out), check, mode="update")
    updates = t.spark.read.schema(J.with_batch_id(stream.schema)).parquet(out)
    return rounded(J.latest_updates(updates, ["day", "insider_id", "company_id"]), "day_value", digits=4)


@query("st04_sliding_clusters", """
SELECT day - k AS window_day, company_id, count(DISTINCT insider_id) AS unique_buyers, count(*) AS buys
FROM (SELECT CAST(filed_at AS DATE) AS day, company_id, insider_id FROM fx_filing_stream WHERE transaction_code = 'P') e
CROSS JOIN (SELECT CAST(k AS INT) AS k FROM range(7) r(k)) r
WHERE CAST(day - k + 7 AS TIMESTAMP) <= (SELECT max(filed_at) FROM fx_filing_stream WHERE transaction_code = 'P') - INTERVAL 1 HOUR
GROUP BY 1, 2""")
def st04(t):
    """Daily panes come from the stream; windows are put together from the closed ones."""
    out, check = _paths(t, "st04")
    done = J.drain_to_table(J.buyer_panes(filings(t), lateness="1 hour"), out, check)
    return J.sliding_clusters(t.spark.read.parquet(out), J.watermark(done))


@query("st05_first_observed_buys", """
SELECT insider_id, accession_id, company_id FROM (
  SELECT *, row_number() OVER (PARTITION BY insider_id ORDER BY filed_at, accession_id) AS pick FROM fx_filing_stream
  WHERE transaction_code = 'P') WHERE pick = 1""")
def st05(t):
    """The later half of the month comes first; buys of the earlier half then correct what it gave."""
    out, check = _paths(t, "st05")
    for filed in _halves(t, out):
        stream = J.first_observed_buys(filed)
        J.drain_batches(stream, J.batch_partitions(out), check, mode="update")
    updates = t.spark.read.schema(J.with_batch_id(stream.schema)).parquet(out)
    return J.latest_updates(updates, ["insider_id"]).select("insider_id", "accession_id", "company_id")


@query("st06_alert_batches", f"SELECT {_ALERT_OUT} FROM ox_alerts")
def st06(t):
    """New transactions raise alerts batch by batch against stored tables."""
    out, check = _paths(t, "st06")
    schema = J.with_batch_id(G.buy_alerts(live_strategy(), *_live(t)).schema)

    def make(batch, stored):
        return G.buy_alerts(live_strategy(), *_live(t), existing=stored, only=batch)

    J.drain_batches(_stream(t, "orders", "fx_transactions"), J.emit_alerts(out, make, schema), check)
    return _alert_out(t.spark.read.schema(schema).parquet(out))


@query("st07_filing_sessions", """
SELECT company_id, session_start, session_end, filings, round(value, 4) AS value FROM (
  SELECT company_id, min(filed_at) AS session_start, max(filed_at) + INTERVAL 2 HOUR AS session_end, count(*) AS filings,
         sum(total_value) AS value FROM (
    SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY company_id ORDER BY filed_at, accession_id) AS grp FROM (
      SELECT *, coalesce(filed_at - lag(filed_at) OVER (PARTITION BY company_id ORDER BY filed_at, accession_id)
                         > INTERVAL 2 HOUR, true) AS gap FROM fx_filing_stream))
  GROUP BY company_id, grp)
WHERE session_end <= (SELECT max(filed_at) FROM fx_filing_stream) - INTERVAL 10 MINUTE""")
def st07(t):
    out, check = _paths(t, "st07")
    J.drain_to_table(J.filing_sessions(filings(t), lateness="10 minutes"), out, check)
    rows = t.spark.read.parquet(out).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})
    return rounded(rows, "value", digits=4)
