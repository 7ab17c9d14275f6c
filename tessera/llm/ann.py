"""Operator 3, approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised by their own k-means codebook, fitted on a bounded sample
(`SAMPLE` vectors, those with the smallest id hashes); a cell is a pair of centroids. Every row is
indexed. A query walks the pairs with a heap in the order of the summed inner products of its halves with
the centroids, until the cells that it has visited hold a share of all rows; it reranks their entries by
the exact inner product in double precision. The share is calibrated on the sample so that `RECALL` of
the sample's own neighbours is reached, by the same rule at every size.

The codebooks grow with the table, so that a cell holds about `CELL` rows, up to one centroid for each
`SAMPLE_A_CENTROID` sampled vectors (256); so the driver sees at most 65,536 cells. Cells in order share
places of `BLOCK` rows; a cell of more rows (one vector that most rows hold, say) is a place of several
blocks. A query is sent once to each block of the places that have a cell it visits, and where more than
`QUERIES` queries visit a place, its entries are repeated for each so many of them: what is shuffled is in
proportion to the comparisons, at most one row for `QUERIES` or `BLOCK` of them beside the table itself.
Places that no query visits are not sent at all.

Defined cases: rows with a null id, or a vector that is null, zero, of another length than most, or holds
null or non-finite components, take no part. Rows that repeat an id and its vector count once; an id with
several vectors is a candidate with each, and queries with its least one. Ties go to the smaller id. No
valid rows: an empty result. Columns beside those named are passed over.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import read, work_table

SAMPLE, PROBES = 8192, 256
CELL, SAMPLE_A_CENTROID = 64, 32
RECALL = 0.95
BLOCK, QUERIES = 4096, 2048
K = 20


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from distinct points; an empty cluster keeps its centroid."""
    points = np.unique(x, axis=0)
    centres = points[np.random.default_rng(seed).permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        of = _nearest(x, centres)
        for c in range(len(centres)):
            if (mine := x[of == c]).size:
                centres[c] = mine.mean(0)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None] - 2 * x @ centres.T, axis=1)


class MultiIndex:
    """Two codebooks, and how many rows each of their cells holds."""

    def __init__(self, first: np.ndarray, second: np.ndarray, sizes: np.ndarray | None = None, share: float = 1.0):
        self.first, self.second, self.sizes, self.share = first, second, sizes, share
        self.half = first.shape[1]

    @classmethod
    def fit(cls, sample: np.ndarray, centroids: int, recall: float = RECALL, k: int = K) -> MultiIndex:
        half = sample.shape[1] // 2
        index = cls(_kmeans(sample[:, :half], centroids, 1), _kmeans(sample[:, half:], centroids, 2))
        cells = index.cells(sample)
        index.sizes = np.bincount(cells, minlength=len(index.first) * len(index.second))
        probes = sample[:: max(1, len(sample) // PROBES)]
        scores = probes @ sample.T
        scores[np.arange(len(probes)), np.arange(0, len(sample), max(1, len(sample) // PROBES))] = -np.inf
        best = np.argsort(-scores, axis=1)[:, : min(k, max(1, len(sample) - 1))]
        needed = []
        for q, mine in zip(probes, best, strict=True):
            order = list(index.walk(q))
            held = np.cumsum([index.sizes[c] for c in order])
            at = dict(zip(order, held, strict=True))
            needed += [at[c] for c in cells[mine]]
        index.share = min(1.0, float(np.quantile(needed, recall)) / len(sample)) if needed else 1.0
        return index

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x[:, : self.half], self.first) * len(self.second) + _nearest(x[:, self.half :], self.second)

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Cells by falling sum of the halves' inner products: a heap over the two sorted lists."""
        a, b = self.first @ q[: self.half], self.second @ q[self.half :]
        oa, ob = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        heap, seen = [(-(a[oa[0]] + b[ob[0]]), 0, 0)], {(0, 0)}
        while heap:
            _, i, j = heapq.heappop(heap)
            yield int(oa[i] * len(self.second) + ob[j])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(oa) and y < len(ob) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (-(a[oa[x]] + b[ob[y]]), x, y))

    def visited(self, q: np.ndarray, k: int) -> list[int]:
        """Cells with a share of all rows, and k + 1 rows at least."""
        quota, held, out = max(k + 1, math.ceil(self.share * self.sizes.sum())), 0, []
        for c in self.walk(q):
            if self.sizes[c]:
                out.append(c)
                held += self.sizes[c]
                if held >= quota:
                    break
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _valid(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))


def _layout(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each cell and the number of blocks of that place; cells in order share one up to `block` rows."""
    place, many, at, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for c, n in enumerate(sizes):
        if held and held + n > block:
            at, held = at + 1, 0
        place[c], many[c], held = at, max(1, -(-n // block)), held + n
    return place, many


def codebook_size(rows: int, sample: int = SAMPLE) -> int:
    """Centroids of a half, by which a table of so many rows has about CELL of them in a cell."""
    return max(2, min(math.ceil(math.sqrt(rows / CELL)), sample // SAMPLE_A_CENTROID))


def search(base: DataFrame, queries: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, sample: int = SAMPLE, centroids: int | None = None, recall: float = RECALL, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each row of queries among the
    rows of base with another id. The number of centroids is that of `codebook_size` where it is None."""
    spark = base.sparkSession
    rows = _valid(base, vec_id, embedding)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return empty
    w, centroids = width["w"], centroids or codebook_size(width["count"], sample)
    rows = rows.where(F.size("v") == w)
    drawn = rows.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample).toArrow()
    index = MultiIndex.fit(_matrix(drawn.column("v").combine_chunks()), centroids, recall, k) if w > 1 else None
    if index is None:  # one component has no halves
        x = _matrix(drawn.column("v").combine_chunks())
        index = MultiIndex.fit(np.hstack([x, np.zeros_like(x)]), centroids, recall, k)
    pad = index.half * 2 if w == 1 else w
    wide = lambda x: x if x.shape[1] == pad else np.hstack([x, np.zeros((len(x), pad - x.shape[1]))])
    books = spark.sparkContext.broadcast((index.first, index.second))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = MultiIndex(*books.value)
        for b in batches:
            x = wide(_matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.cells(x) if len(x) else [], pa.int32())], names=["id", "v", "cell"])

    indexed = work_table(rows.mapInArrow(assign, "id long, v array<double>, cell int"), "indexed")
    sizes = np.zeros(len(index.first) * len(index.second), np.int64)
    for r in indexed.groupBy("cell").agg(F.count("*").alias("n")).collect():  # centroids ** 2 rows at most
        sizes[r["cell"]] = r["n"]
    place, many = _layout(sizes, block)
    asked = _valid(queries, vec_id, embedding).where(F.size("v") == w).groupBy("id").agg(F.min("v").alias("v"))
    state = spark.sparkContext.broadcast((index.first, index.second, sizes, index.share, place, many))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b_, n, share, at, _ = state.value
        own = MultiIndex(a, b_, n, share)
        for b in batches:
            cells = [own.visited(q, k) for q in wide(_matrix(b.column(1)))] if len(b) else []
            places = [np.unique(at[c]).tolist() for c in cells]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int32()))], names=["id", "v", "cells", "places"])

    routed = work_table(asked.mapInArrow(walk, "id long, v array<double>, cells array<int>, places array<int>"), "routed")
    parts = np.zeros(int(place[-1]) + 1, np.int64)
    for r in routed.select(F.explode("places").alias("place")).groupBy("place").agg(F.count("*").alias("n")).collect():  # no more than cells
        parts[r["place"]] = -(-r["n"] // query_block)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks = state.value[4:]
        for b in batches:
            rows, keys, block_of, cells = [], [], [], []
            for i, mine in enumerate(b.column(2).to_pylist()):
                to: dict[int, list[int]] = {}
                for c in mine:
                    to.setdefault(int(at[c]), []).append(c)
                for p, held in to.items():
                    for j in range(blocks[held[0]]):
                        rows.append(i)
                        keys.append(p)
                        block_of.append(j)
                        cells.append(held)
            for s in range(0, len(rows), 4096):
                e, take = s + 4096, pa.array(rows[s : s + 4096], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(keys[s:e], pa.int32()), pa.array(block_of[s:e], pa.int32()), pa.array(cells[s:e], pa.list_(pa.int32()))], names=["id", "v", "place", "block", "cells"])

    layout = spark.createDataFrame([(int(c), int(place[c]), int(many[c]), int(parts[place[c]])) for c in np.flatnonzero(sizes) if parts[place[c]]], "cell int, place int, many int, parts int")
    splits = layout.select("place", "parts").distinct()
    entries = indexed.join(F.broadcast(layout), "cell").select("id", "v", "cell", "place", F.expr("cast(pmod(xxhash64(id), many) as int)").alias("block"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    sent = routed.mapInArrow(send, "id long, v array<double>, place int, block int, cells array<int>").join(F.broadcast(splits), "place").withColumn("part", F.expr("cast(pmod(xxhash64(id), parts) as int)")).drop("parts")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, cell = left.column("id").to_numpy(), left.column("cell").to_numpy()
            x = _matrix(left.column("v").combine_chunks())
            order = np.lexsort((*x.T[::-1], ids))
            ids, cell, x = ids[order], cell[order], x[order]
            same = np.zeros(len(ids), bool)
            same[1:] = (ids[1:] == ids[:-1]) & (x[1:] == x[:-1]).all(1)
            ids, cell, x = ids[~same], cell[~same], x[~same]
            qid, q, cells = right.column("id").to_numpy(), _matrix(right.column("v").combine_chunks()), right.column("cells").to_pylist()
            scale = np.abs(x).max() * x.shape[1]
            for s in range(0, len(q), 128):
                scores = q[s : s + 128] @ x.T
                for i, row in enumerate(scores, s):
                    ok = np.flatnonzero(np.isin(cell, cells[i]) & (ids != qid[i]))
                    if len(ok) > k:
                        least = np.partition(row[ok], len(ok) - k)[len(ok) - k]
                        ok = ok[row[ok] >= least - 1e-12 * scale * np.abs(q[i]).max()]
                    exact = (x[ok] * q[i]).sum(1)  # one order of summation, wherever the row lies
                    best = np.lexsort((ids[ok], -exact))[:k]
                    out.append((np.full(len(best), qid[i]), ids[ok][best], exact[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = entries.groupBy("place", "block", "part").cogroup(sent.groupBy("place", "block", "part")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read(spark, sf_dir, "embeddings")
    return search(base, base.where("vec_id % 20 = 0"))
