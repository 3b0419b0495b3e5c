"""What both vector searches share: distinct vectors, blocks of vectors, and the merging of found vectors.

Joins that carry vectors have the hint to merge.  Spark guesses a table's size from its compressed files, in which vectors
are many times smaller than in memory, and would send them through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from insidertrail.llm.common import cut

BLOCK_ROWS = 8192
QUERY_BLOCK_ROWS = 1024


def valid(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vec): rows with a key whose vector is not null or empty and holds only finite numbers, as doubles.

    Repeated rows count once.
    """
    named = rows.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return named.filter(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & finite).dropDuplicates(["vec_id", "vec"])


def split_queries(rows: DataFrame, is_query: Column, k: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(asked, stored): asked (rep, vec, vec_id) has all query rows, stored the ``k + 1`` smallest ids per vector.

    ``rep`` is the smallest id with the same vector.  Ties go to smaller ids and a query skips only itself, so
    of the rows that share a vector no others can be in a result.  Ranks are cut before the shuffle: a
    vector that a third of all rows share stays small.
    """
    order = Window.partitionBy("vec").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first("vec_id").over(order)
    stored = (rows.withColumn("rep", first).withColumn("n", F.row_number().over(order))
              .filter(F.col("n") <= k + 1).drop("n"))
    queries = rows.filter(is_query)
    reps = queries.groupBy("vec").agg(F.min("vec_id").alias("rep"))
    return cut(queries.join(reps.hint("merge"), "vec").select("rep", "vec", "vec_id"), name + "-asked"), cut(stored, name + "-stored")


def only_reps(rows: DataFrame) -> DataFrame:
    return rows.filter("vec_id = rep").select("rep", "vec")


def block_count(rows: DataFrame, size: int) -> int:
    return max(1, -(-rows.count() // size))


def packed(rows: DataFrame, n_blocks: int) -> DataFrame:
    """(block, ids, vecs): ``rows`` (rep, vec) in blocks by the hash of rep, as bytes of longs and doubles."""
    spread = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(n_blocks)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_numpy().astype("<i8")
        order = np.argsort(ids, kind="stable")
        vecs = matrix(table.column("vec"))[order]
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()),
                         "ids": pa.array([ids[order].tobytes()], pa.binary()),
                         "vecs": pa.array([vecs.tobytes()], pa.binary())})

    return spread.groupBy("block").applyInArrow(pack, "block int, ids binary, vecs binary")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of doubles as rows; shorter ones are filled up with zeros, which no inner product sees."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(n), n.max(initial=0)))
    out[np.arange(out.shape[1]) < n[:, None]] = lists.flatten().to_numpy()
    return out


def unpack(ids: bytes, vecs: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, "<i8")
    return keys, np.frombuffer(vecs, "<f8").reshape(len(keys), -1)


def widened(a: np.ndarray, width: int) -> np.ndarray:
    """``a`` with exactly ``width`` columns."""
    return np.pad(a, ((0, 0), (0, max(0, width - a.shape[1]))))[:, :width]


def meet(data: DataFrame, asked: DataFrame, n_blocks: int) -> DataFrame:
    """Every packed block of the query set beside every block of ``data``, joined on the block number.

    The query blocks come first, as the side of which one row passes at a time while a block of ``data`` is held: there is a
    copy of them for each block.
    """
    queries = packed(only_reps(asked.withColumn("vec_id", F.col("rep")).dropDuplicates(["rep"])),
                     block_count(asked, QUERY_BLOCK_ROWS))
    sent = queries.select(F.col("ids").alias("query_ids"), F.col("vecs").alias("query_vecs"),
                          F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    return sent.hint("merge").join(data, "block")


def ranked(found: DataFrame, asked: DataFrame, stored: DataFrame, k: int, key: str) -> DataFrame:
    """query_id, rank, key, score: the ``k`` best rows of each query from ``found`` (query_rep, rep, score)."""
    best = Window.partitionBy("query_rep").orderBy(F.col("score").desc(), "rep")
    few = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")
    rows = (few.join(asked.select(F.col("rep").alias("query_rep"), F.col("vec_id").alias("query_id")), "query_rep")
            .join(stored.select("rep", "vec_id"), "rep").filter("query_id <> vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("vec_id").alias(key), "score"))
