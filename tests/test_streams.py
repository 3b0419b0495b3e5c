"""Streaming jobs over reversed, repeated and interrupted batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from insidertrail.streaming import jobs as J

FILING = "accession_id long, filed_at timestamp, insider_id int, company_id int, transaction_code string, total_value double"
START = datetime(2024, 1, 1)


def filing(i, hours, insider=1, company=1, code="P"):
    return (i, START + timedelta(hours=hours), insider, company, code, float(i or 0))


def land(spark, folder, rows):
    spark.createDataFrame(rows, FILING).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(FILING).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_an_earlier_buy_in_a_later_batch_wins(spark, tmp_path):
    batches = [[filing(5, 100, 1), filing(6, 90, 2), filing(7, 1, 3, code="S")], [filing(4, 50, 1), filing(8, 95, 2)],
               [filing(3, 50, 1), filing(9, 200, 3)]]
    for rows in batches:  # each batch is a restart from the checkpoint
        stream = J.first_observed_buys(land(spark, tmp_path / "in", rows))
        J.drain_batches(stream, J.batch_partitions(f"{tmp_path}/out"), f"{tmp_path}/check", mode="update")
    updates = spark.read.schema(J.with_batch_id(stream.schema)).parquet(f"{tmp_path}/out")
    assert {(r.insider_id, r.accession_id) for r in J.latest_updates(updates, ["insider_id"]).collect()} == {(1, 3), (2, 6), (3, 9)}


def test_windows_from_panes(spark, tmp_path):
    rng = random.Random(4)
    rows = [filing(i, rng.randint(0, 24 * 20), rng.randint(1, 9), rng.randint(1, 3), rng.choice("PPS")) for i in range(300)]
    rows.append(filing(999, 24 * 30))
    done = J.drain_to_table(J.buyer_panes(land(spark, tmp_path / "in", rows), lateness="1 hour"), f"{tmp_path}/out", f"{tmp_path}/check")
    got = J.sliding_clusters(spark.read.parquet(f"{tmp_path}/out"), J.watermark(done)).collect()
    want = {}
    for _, at, insider, company, code, _ in rows[:-1]:
        if code == "P":
            for k in range(7):
                want.setdefault(((at - timedelta(days=k)).date(), company), []).append(insider)
    assert {(r.window_day, r.company_id): (r.unique_buyers, r.buys) for r in got} == {k: (len(set(v)), len(v)) for k, v in want.items()}
    held = max(o["numRowsTotal"] for p in done.recentProgress for o in p["stateOperators"])
    assert held <= len({(r[1].date(), r[2], r[3]) for r in rows if r[4] == "P"})


def stored(spark, store):
    schema = spark.createDataFrame([], FILING).schema
    return sorted(r.accession_id for r in J.committed(spark, store, schema).collect())


def test_filings_are_loaded_once_however_late(spark, tmp_path):
    store = f"{tmp_path}/store"
    load = J.load_once(store, "accession_id", "filed_at")
    first = [filing(i, i) for i in range(1, 40)] + [filing(7, 500), filing(None, 1)]
    late = [filing(i, 24 * 40 + i) for i in range(20, 60)]
    for number, rows in enumerate((first, late, first + late)):
        load(spark.createDataFrame(rows, FILING), number)
    assert stored(spark, store) == list(range(1, 60))
    schema = spark.createDataFrame([], FILING).schema
    seven = J.committed(spark, store, schema).where("accession_id = 7").collect()
    assert [r.filed_at for r in seven] == [START + timedelta(hours=7)]


def test_a_killed_batch_leaves_no_row_and_runs_again(spark, tmp_path, monkeypatch):
    store = f"{tmp_path}/store"
    load = J.load_once(store, "accession_id", "filed_at")
    load(spark.createDataFrame([filing(1, 1)], FILING), 0)

    def killed(keys):
        raise RuntimeError("killed")

    with monkeypatch.context() as broken:
        broken.setattr(J, "key_filters", killed)
        with pytest.raises(RuntimeError):
            load(spark.createDataFrame([filing(1, 1), filing(2, 2), filing(3, 3)], FILING), 1)
    assert stored(spark, store) == [1]
    load(spark.createDataFrame([filing(1, 1), filing(2, 2)], FILING), 1)
    assert stored(spark, store) == [1, 2]


def test_filters_never_lose_a_key(spark):
    keys = spark.range(5000).select(F.col("id").alias("key")).withColumn("part", J._key_part(F.col("key")))
    bits = {(r.part, r.word): r.bits for r in J.key_filters(keys).collect()}
    rows = keys.select("part", J._filter_places(F.col("key")).alias("places")).collect()
    assert all(bits[r.part, p // 64] >> (p % 64) & 1 for r in rows for p in r.places)
