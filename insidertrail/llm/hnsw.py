"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, results merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from insidertrail.llm import vectors as V
from insidertrail.llm.common import cut, table

LINKS = 16  # neighbours per node in the upper layers; twice as many in the lowest
BUILD_WIDTH = 64
SEARCH_WIDTH = 128
SIBLINGS = 16  # of the points inserted together, so many nearest are candidates too
OPENED_AT_ONCE = 4
QUERIES_AT_ONCE = 512


class Graph:
    """Points in order of falling level, so that layer ``l`` holds the first ``counts[l]`` of them.

    ``layers[l]`` is a flat array of neighbour numbers, one row per point, -1 where there is none.  Points get
    one more component that makes all of them equally long; the nearest by inner product are then the nearest
    by distance, for which the graph is made.
    """

    def __init__(self, points: np.ndarray, counts: list[int], layers: list[np.ndarray] | None = None):
        square = (points ** 2).sum(axis=1)
        self.points = np.column_stack([points, np.sqrt(np.maximum(square.max(initial=0) - square, 0))]).astype(np.float32)
        self.counts = counts
        self.layers = layers or [np.full((n, LINKS * (1 + (l == 0))), -1, np.int32) for l, n in enumerate(counts)]

    @classmethod
    def build(cls, points: np.ndarray) -> Graph:
        counts = [len(points)]
        while counts[-1] > LINKS * LINKS:
            counts.append(counts[-1] // LINKS)
        graph = cls(points, counts)
        at = 0
        while at < len(points):
            upto = min(len(points), at + max(LINKS, min(at // 2, QUERIES_AT_ONCE)),
                       *(n for n in counts if n > at))
            graph._insert(at, upto)
            at = upto
        return graph

    def _insert(self, start: int, end: int) -> None:
        new = np.arange(start, end)
        own = self.points[start:end] @ self.points[start:end].T
        np.fill_diagonal(own, -np.inf)
        near = np.argsort(-own, axis=1)[:, :SIBLINGS]
        siblings = np.where(np.take_along_axis(own, near, 1) > -np.inf, near + start, -1)
        entry = np.zeros((len(new), 1), np.int64)
        for layer in range(len(self.counts) - 1, -1, -1):
            inside = start < self.counts[layer]
            found = np.full((len(new), 1), -1)
            if start:
                found = self._search(layer, self.points[start:end], entry, BUILD_WIDTH if inside else LINKS)[0]
                entry = found[:, :LINKS]
            if inside:
                cap = self.layers[layer].shape[1]
                chosen = self._diverse(self.points[start:end], np.concatenate([found, siblings], axis=1), cap)
                self.layers[layer][start:end] = chosen
                self._link_back(layer, new, chosen)

    def _similar(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.where(ids >= 0, np.matmul(self.points[ids], q[:, :, None])[:, :, 0], -np.inf)

    def _diverse(self, q: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
        """Of the candidates, those nearer to ``q`` than to any one taken before; then the nearest of the rest."""
        sims = self._similar(q, ids)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        vecs = self.points[ids]
        between = np.matmul(vecs, vecs.transpose(0, 2, 1))
        taken = np.zeros(ids.shape, bool)
        for c in range(ids.shape[1]):
            hidden = (taken & (between[:, c] > sims[:, c, None])).any(axis=1)
            taken[:, c] = (ids[:, c] >= 0) & ~hidden & (taken.sum(axis=1) < most)
        first = np.argsort(np.where(taken, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(ids, first, 1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _link_back(self, layer: int, new: np.ndarray, chosen: np.ndarray) -> None:
        """Adds the new points to the lists of those they chose; a list that overflows is chosen anew."""
        rows, cols = np.nonzero(chosen >= 0)
        to, back = chosen[rows, cols], new[rows]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        targets, begin, n = np.unique(to, return_index=True, return_counts=True)
        cap = self.layers[layer].shape[1]
        for some in np.array_split(np.argsort(n), max(1, len(n) // 256)):  # lists of like length together
            if not len(some):
                continue
            extra = np.full((len(some), n[some].max()), -1)
            slot = np.arange(extra.shape[1])[None, :]
            fill = slot < n[some, None]
            extra[fill] = back[(begin[some, None] + slot)[fill]]
            held = self.layers[layer][targets[some]]
            extra = np.where((extra[:, :, None] == held[:, None, :]).any(axis=2), -1, extra)
            both = np.concatenate([held, extra], axis=1)
            self.layers[layer][targets[some]] = self._diverse(self.points[targets[some]], both, cap)

    def _search(self, layer: int, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best points found by each row of ``q``, best first, and how similar they are."""
        links = self.layers[layer]
        ids = np.full((len(q), width), -1, np.int64)
        sims = np.full((len(q), width), -np.inf, np.float32)
        seen = np.zeros((len(q), self.counts[layer]), bool)
        opened = np.zeros((len(q), width), bool)
        some = min(width, entry.shape[1])
        ids[:, :some] = entry[:, :some]
        sims[:, :some] = self._similar(q, ids[:, :some])
        who, what = np.nonzero(ids >= 0)
        seen[who, ids[who, what]] = True
        active = np.arange(len(q))
        while len(active):
            waiting = np.where(opened[active] | (ids[active] < 0), -np.inf, sims[active])
            pick = np.argpartition(-waiting, OPENED_AT_ONCE - 1, axis=1)[:, :OPENED_AT_ONCE]
            real = np.take_along_axis(waiting, pick, 1) > -np.inf
            go = real.any(axis=1)
            active, pick, real = active[go], pick[go], real[go]
            if not len(active):
                break
            at = np.where(real, ids[active[:, None], pick], -1)
            opened[active[:, None], pick] |= real
            near = np.where(at[:, :, None] >= 0, links[at], -1).reshape(len(active), -1)
            near = np.where((near >= 0) & ~seen[active[:, None], near], near, -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1  # two opened points may share a neighbour
            near = near[:, (near >= 0).any(axis=0)]
            row, col = np.nonzero(near >= 0)
            seen[active[row], near[row, col]] = True
            s = np.full(near.shape, -np.inf, np.float32)
            s[row, col] = np.einsum("ij,ij->i", self.points[near[row, col]], q[active[row]])
            all_ids = np.concatenate([ids[active], near], axis=1)
            all_sims = np.concatenate([sims[active], s], axis=1)
            all_open = np.concatenate([opened[active], np.zeros(near.shape, bool)], axis=1)
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[active], sims[active], opened[active] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_sims, all_open))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def nearest(self, queries: np.ndarray, width: int = SEARCH_WIDTH) -> np.ndarray:
        """Per query the numbers of about ``width`` near points, -1 where fewer were found."""
        q = np.column_stack([queries, np.zeros(len(queries))]).astype(np.float32)
        entry = np.zeros((len(q), 1), np.int64)
        for layer in range(len(self.counts) - 1, 0, -1):
            entry = self._search(layer, q, entry, LINKS)[0][:, :LINKS]
        return self._search(0, q, entry, width)[0]


def shard_graphs(blocks: DataFrame) -> DataFrame:
    """(block, ids, vecs, counts, links): one row per shard with its graph as flat arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, vecs in zip(*(c.to_pylist() for c in batch.columns)):
                keys, points = V.unpack(ids, vecs)
                # Points come in the order of their keys; a fixed shuffle makes levels independent of it.
                order = np.random.default_rng(len(keys)).permutation(len(keys))
                graph = Graph.build(points[order])
                flat = np.concatenate([layer.reshape(-1) for layer in graph.layers]).astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int32()), pa.array([keys[order].tobytes()], pa.binary()),
                     pa.array([points[order].tobytes()], pa.binary()), pa.array([graph.counts], pa.list_(pa.int32())),
                     pa.array([flat.tobytes()], pa.binary())], ["block", "ids", "vecs", "counts", "links"])

    return blocks.mapInArrow(run, "block int, ids binary, vecs binary, counts array<int>, links binary")


def stored_graph(points: np.ndarray, counts: list[int], links: bytes) -> Graph:
    flat, layers = np.frombuffer(links, "<i4"), []
    for layer, n in enumerate(counts):
        size = n * LINKS * (1 + (layer == 0))
        layers.append(flat[:size].reshape(n, -1))
        flat = flat[size:]
    return Graph(points, counts, layers)


def searched(pairs: DataFrame, most: int, width: int) -> DataFrame:
    """(query_rep, rep, score): the ``most`` best points that each shard finds, with exact inner products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, points = V.unpack(row["ids"], row["vecs"])
                graph = stored_graph(points, row["counts"], row["links"])
                query_ids, queries = V.unpack(row["query_ids"], row["query_vecs"])
                queries = V.widened(queries, points.shape[1])
                for at in range(0, len(queries), QUERIES_AT_ONCE):
                    q, who = queries[at:at + QUERIES_AT_ONCE], query_ids[at:at + QUERIES_AT_ONCE]
                    found = graph.nearest(q, width)
                    score = np.where(found >= 0, np.einsum("qpd,qd->qp", points[found], q), -np.inf)
                    best = np.lexsort((keys[found], -score))[:, :most]
                    real = np.take_along_axis(found, best, 1) >= 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(who, real.sum(axis=1))), pa.array(keys[np.take_along_axis(found, best, 1)[real]]),
                         pa.array(np.take_along_axis(score, best, 1)[real])], ["query_rep", "rep", "score"])

    return pairs.mapInArrow(run, "query_rep long, rep long, score double")


def nearest(rows: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
            width: int = SEARCH_WIDTH) -> DataFrame:
    """query_id, rank, key, score: about the ``k`` nearest other rows of every query row by inner product.

    Every row is indexed: distinct vectors are dealt into shards of about ``vectors.BLOCK_ROWS`` by the hash of
    their id, each shard becomes one graph, written to the shared folder, every query searches every
    shard, and what the shards found is merged.  Scores are inner products of the original vectors in double
    precision; ties go to the smaller key.  Rows with a null key, or with a null, empty or all-zero vector or
    one with null or non-finite components, take no part; repeated rows count once; a shorter vector counts as
    filled up with zeros; fewer than ``k`` others are all returned; an empty table gives no rows.
    """
    some = V.valid(rows, key, vector).filter(F.exists("vec", lambda x: x != 0))
    asked, stored = V.split_queries(some, is_query, k, "hnsw")
    reps = V.only_reps(stored)
    n_shards = V.block_count(reps, V.BLOCK_ROWS)
    index = cut(shard_graphs(V.packed(reps, n_shards)), "hnsw-index")
    found = searched(V.meet(index, asked, n_shards), k + 1, max(width, 2 * (k + 1)))
    return V.ranked(found, asked, stored, k, key)


def op10_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
