"""Filter interaction audit by incremental retraction streaming.

The files of a table are read as available-now micro-batches.  Every row gets a mask of the filters it fails.  Whether a
text repeats one of a smaller id is known only once all files are read, so a state per text keeps its smallest id and
the masks counted for it: a smaller id takes the earlier masks back from the counters and counts them again as repeats.
The state is a table keyed by the text's digest, which each micro-batch joins and adds to.
"""

from __future__ import annotations

import json
import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from insidertrail.llm.common import WORD, cut, table, work_path

BATCHES = 4  # micro-batches of a run, each a like share of the files
COUNTED = "part string, mask int, good boolean, toxic boolean, delta long"
STATE = ("digest binary, part string, mask int, good boolean, toxic boolean, least long, at_least long, above long, unknown long, "
         "old boolean, smallest long")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of the audited filters on a text without nulls."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _folded(rows: DataFrame) -> DataFrame:
    """Rows (digest, part, mask, good, toxic, key) with the smallest key of each group and the rows that have it.

    ``above`` counts rows with larger keys, ``unknown`` those without one.  Both steps add up before they shuffle, and
    the first deals copies of one text over all tasks by their keys.
    """
    group = ["digest", "part", "mask", "good", "toxic"]
    each = rows.groupBy(*group, "key").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.when(F.col("key").isNotNull(), F.struct("key", "n")))
    known = F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.col("n"))), F.lit(0))
    return each.groupBy(*group).agg(first.alias("first"), known.alias("known"), F.sum("n").alias("all")).select(
        *group, F.col("first.key").alias("least"), F.coalesce("first.n", F.lit(0)).alias("at_least"),
        (F.col("known") - F.coalesce("first.n", F.lit(0))).alias("above"), (F.col("all") - F.col("known")).alias("unknown"))


def _settled(new: DataFrame, stored: DataFrame) -> DataFrame:
    """``new`` folded rows and the stored ones of their texts, each with ``smallest``, the smallest key of its text so far.

    ``stored`` holds a text's rows in the version of each batch that met it; the last version counts.  A text has
    at most one row per part, label and origin, so its window is small whatever its number of copies.
    """
    text = W.partitionBy("digest")
    old = stored.join(new.select("digest").distinct(), "digest", "left_semi").withColumn("last", F.max("batch_id").over(text))
    old = old.filter("batch_id = last and least = smallest").groupBy("digest", "part", "mask", "good", "toxic", "least").agg(
        F.sum("at_least").alias("at_least")).withColumns({"above": F.lit(0).cast("long"), "unknown": F.lit(0).cast("long"), "old": F.lit(True)})
    both = new.withColumn("old", F.lit(False)).unionByName(old)
    return both.withColumn("smallest", F.min("least").over(text))


def _changes(settled: DataFrame, repeat: int) -> DataFrame:
    """What a batch changes in the counters: new rows in, earlier ones that a smaller key made repeats out and in again."""
    mask, failing = F.col("mask"), F.col("mask").bitwiseOR(F.lit(repeat))
    beaten = F.col("least") > F.col("smallest")
    moves = F.array(F.struct(F.when(F.col("old"), F.when(beaten, -F.col("at_least"))).when(~beaten, F.col("at_least")).alias("delta"), mask.alias("to")),
                    F.struct(F.when(beaten, F.col("at_least")).alias("delta"), failing.alias("to")),
                    F.struct(F.col("above").alias("delta"), failing.alias("to")), F.struct(F.col("unknown").alias("delta"), mask.alias("to")))
    return (settled.select("part", "good", "toxic", F.explode(moves).alias("move")).filter("move.delta <> 0")
            .groupBy("part", F.col("move.to").alias("mask"), "good", "toxic").agg(F.sum("move.delta").alias("delta")))


def _settle(folder: str, labels: DataFrame, repeat: int):
    """The handler of a batch: the state of its texts and its changes, each under the batch's number.

    A batch that is run again reads only earlier batches' states and replaces its own folders.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.join(marks, batch["key"] == marks["labelled"], "left").select(
            "digest", "part", "mask", "key", F.coalesce("is_good", F.lit(False)).alias("good"),
            F.coalesce("is_toxic", F.lit(False)).alias("toxic"))
        new = cut(_folded(rows), "audit-batch")
        stored = spark.read.schema(STATE + ", batch_id long").parquet(f"{folder}/state").filter(F.col("batch_id") < batch_id)
        state = f"{folder}/state/batch_id={batch_id}"
        _settled(new, stored).write.mode("overwrite").parquet(state)
        settled = spark.read.schema(STATE).parquet(state)
        _changes(settled, repeat).write.mode("overwrite").parquet(f"{folder}/changes/batch_id={batch_id}")

    return handle


def mask_counters(stream: DataFrame, labels: DataFrame, folder: str, *, key: str = "doc_id", text: str = "text",
                  part: str = "lang", filters=text_filters) -> DataFrame:
    """(part, mask, good, toxic, n): rows of a file stream by the filters they fail, everything available read.

    Bit i of the mask is the ith filter, the last bit says that a smaller key has the same text.  ``folder`` keeps the
    stream's checkpoint, the states of texts and the changes of each batch: a later call on the same folder reads new
    files only and goes on from there.  A state is one narrow row per text (and label), without the text.
    """
    spark = stream.sparkSession
    failing = filters(F.col("text"))
    mask = F.lit(0)
    for i, fails in enumerate(failing.values()):
        mask = mask + F.when(fails, F.lit(1 << i)).otherwise(F.lit(0))
    rows = stream.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                         F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows = rows.select("key", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    for name, schema in (("state", STATE), ("changes", COUNTED)):  # there to be read before the first batch
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/{name}/batch_id=-1")
    (rows.writeStream.foreachBatch(_settle(folder, labels, 1 << len(failing)))
     .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    stored = spark.read.schema(COUNTED).parquet(f"{folder}/changes")
    return stored.groupBy("part", "mask", "good", "toxic").agg(F.sum("delta").alias("n")).filter("n <> 0")


def audit(counters: DataFrame, names: str) -> DataFrame:
    """One row per part, filter order and step from ``counters`` (part, mask, good, toxic, n).

    ``names`` holds a letter per bit of the mask.  Per part there are at most 2 to the number of filters masks, so the
    orders (factorial of that number) are worked out on one array of counts per part.
    """
    def counts(which: str) -> Column:
        each = (f"sum(if(mask = {m} and {which}, n, 0L))" for m in range(1 << len(names)))
        return F.expr(f"array({', '.join(each)})")

    cells = counters.groupBy("part").agg(
        counts("true").alias("total"), counts("good").alias("of_good"), counts("toxic").alias("of_toxic"))
    bits = {c: 1 << i for i, c in enumerate(names)}
    steps = [("".join(order), i + 1, sum(bits[c] for c in order[:i]), bits[c])
             for order in permutations(names) for i, c in enumerate(order)]
    # The orders travel as one short text, not as a literal of thousands of expressions.
    plan = F.from_json(F.lit(json.dumps([dict(zip(("o", "s", "b", "f"), s)) for s in steps])),
                       "array<struct<o: string, s: int, b: int, f: int>>")
    rows = cells.withColumn("step", F.explode(plan)).select("*", "step.*")

    def total(counts: str, keep: str) -> Column:
        return F.expr(f"aggregate(transform({counts}, (n, m) -> if({keep}, n, 0L)), 0L, (a, n) -> a + n)")

    first = "m & f <> 0 and m & b = 0"  # fails here and nowhere before
    done = rows.select(
        "part", F.col("o").alias("filter_order"), F.col("s").alias("step"), "f",
        total("total", "m & (b | f) = 0").alias("kept"), total("total", first).alias("removed"),
        total("total", "m & f <> 0 and m & b <> 0").alias("redundant"), total("total", "m = f").alias("unique_fails"),
        total("of_good", first).alias("good_lost"), total("of_toxic", first).alias("toxic_lost"))
    return done.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "f"))).drop("f")


def filter_audit(spark: SparkSession, path: str, labels: DataFrame, *, batches: int = BATCHES, folder: str | None = None,
                 **columns) -> DataFrame:
    """The audit of the table of parquet files at ``path`` under ``text_filters`` and, as last filter E, repeated texts.

    A null text counts as empty and a null part as "".  A null key is neither smaller nor larger than another: such rows
    repeat nothing and nothing repeats them.  Rows repeated whole count each time; those with the smallest key of a
    text repeat nothing.  Of several labels of a document, one that says good (toxic) counts.  An empty table gives no rows.

    ``batches`` micro-batches take a like share of the files each, so their number, and the readings of ``labels``, do not
    grow with the table.
    """
    source = spark.read.parquet(path)
    files = source.inputFiles()
    reader = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", max(1, math.ceil(len(files) / batches)))
    parent, name = path.rstrip("/").rsplit("/", 1)
    if len(files) == 1 and files[0].endswith(f"/{name}"):  # one file, which a stream finds in its folder
        stream = reader.option("pathGlobFilter", name).parquet(parent)
    else:
        stream = reader.parquet(path)
    counters = mask_counters(stream, labels, folder or work_path(spark, "filter-audit"), **columns)
    return audit(counters, "ABCDE")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


OP11_SQL = """
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM texts t LEFT JOIN marks m ON t.doc_id = m.doc_id),
cells AS (SELECT part, mask, good, toxic, count(*) AS n FROM masks GROUP BY part, mask, good, toxic),
orders(filter_order) AS (
  SELECT '' UNION ALL SELECT filter_order || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f)
  WHERE length(filter_order) < 5 AND NOT contains(filter_order, f)),
steps AS (
  SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS f, 1 << (ascii(filter_order[step]) - 65) AS own,
    CAST(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS BIGINT) AS earlier
  FROM orders, range(1, 6) r(step) WHERE length(filter_order) = 5),
done AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN mask & (own | coalesce(earlier, 0)) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(earlier, 0) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(earlier, 0) <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(earlier, 0) = 0 AND good = 1 THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(earlier, 0) = 0 AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM done
"""
