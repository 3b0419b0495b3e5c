"""Exact top-k by inner product with vector-approximation files: cells give bounds, bounds give the reading order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from insidertrail.llm import vectors as V
from insidertrail.llm.common import cut, table

CELLS = 256  # per dimension, so that a component is one byte
QUERIES_AT_ONCE = 128
READ_AT_ONCE = 32


def approximations(blocks: DataFrame) -> DataFrame:
    """(block, ids, cells, low, width): each block's own grid of equal cells and the cell of every component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, vecs in zip(*(c.to_pylist() for c in batch.columns)):
                _, v = V.unpack(ids, vecs)
                low = v.min(axis=0)
                width = (v.max(axis=0) - low) / CELLS
                cells = np.clip((v - low) / np.where(width > 0, width, 1), 0, CELLS - 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int32())] + [pa.array([x.tobytes()], pa.binary()) for x in (
                        np.frombuffer(ids, "<i8"), cells, low, width)], ["block", "ids", "cells", "low", "width"])

    return blocks.mapInArrow(run, "block int, ids binary, cells binary, low binary, width binary")


def bounded(pairs: DataFrame, k: int) -> DataFrame:
    """(query_rep, rep, lower, upper): per block, all vectors whose upper bound reaches the kth best lower bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                low, width = np.frombuffer(row["low"]), np.frombuffer(row["width"])
                cells = np.frombuffer(row["cells"], np.uint8).reshape(len(ids), -1)
                middle = low + (cells + 0.5) * width
                query_ids, queries = V.unpack(row["query_ids"], row["query_vecs"])
                queries = V.widened(queries, middle.shape[1])
                for at in range(0, len(query_ids), QUERIES_AT_ONCE):
                    q = queries[at:at + QUERIES_AT_ONCE]
                    score = q @ middle.T
                    # Half a cell in every dimension, and room for the rounding of both sums.
                    slack = np.abs(q) @ (0.5 * width) + 1e-12 * (np.abs(q) @ np.abs(middle).max(axis=0)) + 1e-300
                    if len(ids) > k:
                        reach = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k] - 2 * slack
                    else:
                        reach = np.full(len(q), -np.inf)
                    who, what = np.nonzero(~(score < reach[:, None]))  # what overflows stays in
                    near, room = score[who, what], slack[who]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(query_ids[at:at + QUERIES_AT_ONCE][who]), pa.array(ids[what]), pa.array(near - room),
                         pa.array(near + room)], ["query_rep", "rep", "lower", "upper"])

    return pairs.mapInArrow(run, "query_rep long, rep long, lower double, upper double")


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products, also where they pass the 53 bits of a double; beyond 64 bits they saturate."""
    largest = [float(np.abs(x).max(initial=0)) for x in (q, v)]
    if max(largest) < 2.0 ** 53 and largest[0] * largest[1] * max(1, len(q)) < 2.0 ** 53:
        return (v @ q).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in v], object) @ np.array([int(x) for x in q], object)
    return np.array([max(-2 ** 63, min(2 ** 63 - 1, s)) for s in whole], np.int64)


def refined(candidates: DataFrame, k: int) -> DataFrame:
    """(query_rep, rep, score): vectors read in bound order until the kth best score reaches the next bound."""

    def read(group: pa.Table) -> pa.Table:
        upper = group.column("upper").to_numpy()
        order = np.argsort(-upper, kind="stable")
        upper, reps = upper[order], group.column("rep").to_numpy()[order]
        vecs = V.matrix(group.column("vec"))[order]
        q = V.widened(np.array([group.column("query_vec")[0].as_py()]), vecs.shape[1])[0]
        scores = np.zeros(0, np.int64)
        for at in range(0, len(reps), READ_AT_ONCE):
            if len(scores) >= k and np.partition(scores, len(scores) - k)[len(scores) - k] > upper[at]:
                break
            scores = np.concatenate([scores, exact_scores(q, vecs[at:at + READ_AT_ONCE])])
        best = np.lexsort((reps[:len(scores)], -scores))[:k]
        return pa.table({"query_rep": group.column("query_rep").slice(0, 1).take(pa.array([0] * len(best))),
                         "rep": pa.array(reps[best]), "score": pa.array(scores[best])})

    return candidates.groupBy("query_rep").applyInArrow(read, "query_rep long, rep long, score long")


def top_k(rows: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, key, score: the ``k`` highest inner products of every query row with all other rows.

    Vectors hold whole numbers (as any numeric type); ties go to the smaller key.  ``is_query`` is a condition
    on the key, named vec_id.  All queries are held against the cells of all vectors, block by block; the kth
    best lower bound over all blocks then decides which exact vectors are read at all.  Rows with a null
    key, or a null or empty vector or one with null or non-finite components, take no part; repeated rows
    count once; a shorter vector counts as filled up with zeros; fewer than ``k`` others are all
    returned; an empty table gives no rows.
    """
    asked, stored = V.split_queries(V.valid(rows, key, vector), is_query, k, "exact")
    most = k + 1  # one of them may be the query itself
    reps = V.only_reps(stored)
    n_blocks = V.block_count(reps, V.BLOCK_ROWS)
    cells = approximations(V.packed(reps, n_blocks))
    bounds = cut(bounded(V.meet(cells, asked, n_blocks), most), "exact-bounds")
    whole = Window.partitionBy("query_rep").orderBy(F.col("lower").desc()).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    reach = F.nth_value("lower", most).over(whole)
    needed = bounds.withColumn("reach", reach).filter("reach is null or upper >= reach").select("query_rep", "rep", "upper")
    queries = asked.groupBy(F.col("rep").alias("query_rep")).agg(F.first("vec").alias("query_vec"))
    candidates = needed.join(reps.hint("merge"), "rep").join(queries.hint("merge"), "query_rep")
    return V.ranked(refined(candidates, most), asked, stored, k, key)


def op5_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    # The quotient leaves the doubles where 64 * x is no longer finite; such vectors take no part.
    scaled = rows.select("vec_id", F.transform(F.col("embedding").cast("array<double>"),
                                               lambda x: _floor(64 * x)).alias("scaled"))
    return top_k(scaled, F.col("vec_id") % 20 == 0, vector="scaled")


def _floor(x: Column) -> Column:
    """floor as a double: beyond 2^52 a double is whole already."""
    return F.when(F.abs(x) < 2.0 ** 52, F.floor(x).cast("double")).otherwise(x)


OP5_SQL = """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM scaled q JOIN scaled c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
