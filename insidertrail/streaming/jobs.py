"""Structured Streaming jobs over filing streams.

A filing stream has accession_id, filed_at, insider_id, company_id,
transaction_code and total_value.  Jobs return streaming DataFrames, or take
output paths where they write inside ``foreachBatch``; sinks are files, so a
restart continues from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from insidertrail.operators.single import single_row

LATENESS = "7 days"


def drain_to_table(stream: DataFrame, out: str, checkpoint: str, *, mode: str = "append",
                   fmt: str = "parquet") -> StreamingQuery:
    """Processes everything available and stops; the query that ended tells its progress."""
    query = (stream.writeStream.format(fmt).option("path", out).option("checkpointLocation", checkpoint)
             .outputMode(mode).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def watermark(query: StreamingQuery) -> Column:
    """How far an ended query's event time is closed."""
    return F.lit(query.lastProgress["eventTime"]["watermark"]).cast("timestamp")


def drain_batches(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, *,
                  mode: str = "append") -> None:
    (stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
     .outputMode(mode).trigger(availableNow=True).start().awaitTermination())


def unique_filings(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each accession once; a repeat within the lateness bound is dropped."""
    return stream.withWatermark("filed_at", lateness).dropDuplicatesWithinWatermark(["accession_id"])


def with_batch_id(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("batch_id", LongType())])


def _table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at a path, empty while nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def route_late_rows(on_time: str, late: str, *, days: int = 7) -> Callable[[DataFrame, int], None]:
    """Rows older than the newest earlier filing minus ``days`` go to the backfill table.

    Each batch overwrites its own partition, so a replayed batch changes nothing.  The newest filing of a
    batch is kept as one row beside the table, so a batch costs the same however old the stream is.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = _table(spark, f"{on_time}-mark", with_batch_id(batch.select(F.col("filed_at").alias("newest")).schema))
        mark = single_row(marks.where(F.col("batch_id") < batch_id).agg(F.max("newest").alias("newest")))["newest"]
        limit = F.col("_mark") - F.expr(f"INTERVAL {days} DAYS")
        # The path still being written is read first, so the routed rows are cut here.
        routed = (batch.withColumn("_mark", mark)
                  .withColumn("_late", F.coalesce(F.col("filed_at") < limit, F.lit(False)))
                  .drop("_mark").persist())
        try:
            for flag, path in ((False, on_time), (True, late)):
                (routed.where(F.col("_late") == flag).drop("_late")
                 .write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}"))
            newest = routed.where(~F.col("_late")).agg(F.max("filed_at").alias("newest"))
            newest.write.mode("overwrite").parquet(f"{on_time}-mark/batch_id={batch_id}")
        finally:
            routed.unpersist()

    return handle


def daily_event_value(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Running value per (insider, company, day); use with update mode."""
    return (stream.where("transaction_code = 'P'").withWatermark("filed_at", lateness)
            .groupBy(F.window("filed_at", "1 day"), "insider_id", "company_id")
            .agg(F.sum("total_value").alias("day_value"), F.count(F.lit(1)).alias("lots"))
            .select(F.col("window.start").cast("date").alias("day"), "insider_id", "company_id", "day_value", "lots"))


def batch_partitions(path: str) -> Callable[[DataFrame, int], None]:
    """Handler that stores each batch of updates under its own id."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return handle


def latest_updates(updates: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in updates.columns if c not in keys and c != "batch_id"]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*keys, "_r.*")


def buyer_panes(stream: DataFrame, *, lateness: str = LATENESS) -> DataFrame:
    """Buys per (day, company, insider), given out when the day is closed: one state row per buyer and open day."""
    return (stream.where("transaction_code = 'P'").withWatermark("filed_at", lateness)
            .groupBy(F.window("filed_at", "1 day"), "company_id", "insider_id").agg(F.count(F.lit(1)).alias("buys"))
            .select(F.col("window.start").cast("date").alias("day"), "company_id", "insider_id", "buys"))


def sliding_clusters(panes: DataFrame, closed_before: Column, *, days: int = 7) -> DataFrame:
    """Distinct buyers and buys per company in windows of ``days``, one beginning each day, that ended by ``closed_before``.

    Windows are put together from closed daily panes, so the stream's state does not hold a buy once per window.
    Buyers are made distinct before they are counted; no value grows with a company's activity.
    """
    start = F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda k: F.date_sub("day", k)))
    rows = panes.select(start.alias("window_day"), "company_id", "insider_id", "buys")
    rows = rows.where(F.date_add("window_day", days).cast("timestamp") <= closed_before)
    return (rows.groupBy("window_day", "company_id", "insider_id").agg(F.sum("buys").alias("buys"))
            .groupBy("window_day", "company_id").agg(F.count(F.lit(1)).alias("unique_buyers"), F.sum("buys").alias("buys")))


def first_observed_buys(stream: DataFrame) -> DataFrame:
    """The first buy of each insider among those seen so far; use with update mode.

    A batch gives the insiders it met, so an earlier buy that comes in a later batch corrects what was given before
    (``latest_updates`` keeps the last).  The state is one row per insider over the life of the query; equal times are
    told apart by the accession.
    """
    first = F.min(F.struct("filed_at", "accession_id", "company_id")).alias("first")
    return (stream.where("transaction_code = 'P'").groupBy("insider_id").agg(first)
            .select("insider_id", "first.accession_id", "first.filed_at", "first.company_id"))


# --- loading once ------------------------------------------------------------

KEY_PARTS, FILTER_WORDS, FILTER_HASHES = 16, 1 << 12, 4


def _key_part(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("part")), F.lit(KEY_PARTS)).cast("int")


def _filter_places(key: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(64 * FILTER_WORDS)).cast("int") for i in range(FILTER_HASHES)])


def key_filters(keys: DataFrame) -> DataFrame:
    """(part, word, bits): a Bloom filter of ``keys`` (key, part) per part, as an aggregate that other ones merge with by ``or``."""
    places = keys.select("part", F.explode(_filter_places(F.col("key"))).alias("place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") % 64)
    return (places.groupBy("part", F.floor(F.col("place") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")))


def committed(spark: SparkSession, store: str, schema: StructType) -> DataFrame:
    """Rows of a store, with ``batch_id``: those of batches that the manifest lists."""
    done = _table(spark, f"{store}/manifest", StructType([StructField("batch_id", LongType())]))
    return _table(spark, f"{store}/data", with_batch_id(schema)).join(done, "batch_id", "left_semi")


def load_once(store: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """Handler that stores the rows whose key no committed earlier batch has, however late they come.

    Of a batch's rows with one key the first by ``order`` counts.  Beside the rows each batch keeps its keys by part
    and their Bloom filter; only keys that the filters do not rule out are looked for among the stored ones, and only
    in their own parts.  A batch counts from the moment its number is in the manifest, which is written last: what a
    killed batch left behind is not read, and its second run replaces it.  Rows without a key are refused.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = {name: f"{store}/{name}/batch_id={batch_id}" for name in ("data", "keys", "filters", "manifest")}
        number = StructType([StructField("batch_id", LongType())])
        earlier = _table(spark, f"{store}/manifest", number).where(F.col("batch_id") < batch_id)
        kind = batch.schema[key].dataType
        keys_schema = StructType([StructField("key", kind), StructField("part", IntegerType()), StructField("batch_id", LongType())])
        filters_schema = StructType([StructField(n, t) for n, t in (("part", IntegerType()), ("word", IntegerType()), ("bits", LongType()),
                                                                    ("batch_id", LongType()))])
        stored = _table(spark, f"{store}/keys", keys_schema).join(earlier, "batch_id", "left_semi")
        filters = _table(spark, f"{store}/filters", filters_schema).join(earlier, "batch_id", "left_semi")
        # At most KEY_PARTS * FILTER_WORDS rows, whatever has been stored.
        filters = filters.groupBy("part", "word").agg(F.bit_or("bits").alias("bits"))
        names = batch.columns
        fresh = (batch.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"))
                 .agg(F.min_by(F.struct(*names), F.struct(order, F.xxhash64(*names))).alias("row")).withColumn("part", _key_part(F.col("key"))))
        asked = fresh.select("key", "part", F.explode(F.array_distinct(_filter_places(F.col("key")))).alias("place"))
        met = (asked.join(F.broadcast(filters), (asked["part"] == filters["part"]) & (F.floor(F.col("place") / 64) == filters["word"]))
               .where(F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") % 64)) != 0)
               .groupBy("key", asked["part"]).agg(F.count(F.lit(1)).alias("n")))
        doubtful = met.where(F.col("n") == F.size(F.array_distinct(_filter_places(F.col("key")))))
        known = stored.join(doubtful.select("key", "part"), ["part", "key"], "left_semi").select("key")
        fresh.join(known, "key", "left_anti").select("row.*").write.mode("overwrite").parquet(own["data"])
        added = spark.read.schema(batch.schema).parquet(own["data"]).select(F.col(key).alias("key")).withColumn("part", _key_part(F.col("key")))
        added.write.mode("overwrite").partitionBy("part").parquet(own["keys"])
        key_filters(added).write.mode("overwrite").parquet(own["filters"])
        spark.range(1).select(F.lit(1).alias("done")).write.mode("overwrite").parquet(own["manifest"])

    return handle


def emit_alerts(path: str, make_alerts: Callable[[DataFrame, DataFrame], DataFrame], schema) -> Callable:
    """Handler that writes the alerts of a batch that are not stored by an earlier batch."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        stored = _table(batch.sparkSession, path, schema)
        if "batch_id" in stored.columns:
            stored = stored.where(F.col("batch_id") < batch_id)
        make_alerts(batch, stored).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return handle


def filing_sessions(stream: DataFrame, *, gap: str = "2 hours", lateness: str = LATENESS) -> DataFrame:
    """Bursts of filings per company, closed after a quiet gap."""
    return (stream.withWatermark("filed_at", lateness)
            .groupBy(F.session_window("filed_at", gap), "company_id")
            .agg(F.count(F.lit(1)).alias("filings"), F.sum("total_value").alias("value"))
            .select("company_id", F.col("session_window.start").alias("session_start"),
                    F.col("session_window.end").alias("session_end"), "filings", "value"))
