"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from insidertrail.session import shared_folder

# A run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A table of at most this many narrow rows may be broadcast (about 20 MB).
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared folder."""
    return f"{shared_folder(spark)}/insidertrail/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage ends there."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote and that nothing will read again; others are left alone."""
    for table_ in tables:
        context = table_.sparkSession.sparkContext
        for folder in {file.rsplit("/", 1)[0] for file in table_.inputFiles()}:
            if f"/insidertrail/{context.applicationId}/" in folder:
                path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(folder))
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for ``mapInArrow``, giving back at its end what the worker no longer uses: workers live on between tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def global_rank(df: DataFrame, order: Column, name: str) -> DataFrame:
    """``df`` with ``rank``, the 0-based place of each row by ``order``, without sorting all rows in one task.

    Rows are range-partitioned and written; ranks add the rows of the partitions before.  Only the
    partition sizes, one row each, pass a single task.
    """
    parts = cut(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), name)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
               .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")))
    return (parts.join(offsets, "__part")
            .withColumn("rank", F.col("__offset") + F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1)
            .drop("__part", "__offset"))


def attach_small(rows: DataFrame, small: DataFrame, key: str, n_small: int, salts: int = 64) -> DataFrame:
    """``rows`` inner-joined (null-safe) to ``small``, one row per key, without gathering a hot key.

    ``small`` (renamed columns, key ``__<key>``) is broadcast when its measured size allows that.  Beyond
    it every key is split over ``salts`` join keys, to each of which ``small`` is copied.
    """
    same = F.col(key).eqNullSafe(F.col(f"__{key}"))
    if n_small <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), same).drop(f"__{key}")
    spread = small.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    return (salted.join(spread, same & (F.col("__salt") == F.col("__copy")))
            .drop(f"__{key}", "__salt", "__copy"))
