"""Approximate nearest neighbours by inner product: collision-counting hashing.

Vectors are dealt, once, into blocks of bounded size. Inner products become distances
by one more component that lifts all vectors of a block to one length. Each of
`projections` orthogonal random directions gives a sorted array of a block's projected
values. A query opens in every array a window centred on its own projected
value; virtual rehashing widens the windows, level by level, and counts for
each vector in how many arrays it collides with the query. Vectors that collide in
at least the threshold of arrays are candidates, and are verified with their
original components in double precision. A query stops widening a block when
it has enough candidates there.

Queries are a stated set. They are broadcast in runs of QUERY_RUN, and visit every block:
vectors are shuffled once for each run and never copied, and a block returns at most k rows
per query, of which the best are taken by a window over the queries. The arithmetic is the
product of queries and vectors, at a small constant (see the README).

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, neither as queries nor as candidates, nor do those whose
length isn't the most frequent one (of ties the greatest); fewer candidates
than k are all returned; ties go to the smaller id; empty tables give empty
results. Rows that repeat an id are candidates of their own, but never
neighbours of that id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import importable, materialise

PROJECTIONS = 64
#: Share of the arrays in which a candidate collides with the query.
THRESHOLD = 0.70
#: Candidates a query wants from a block, as a share of the block, and at least so many times k.
SHARE, TIMES = 0.10, 8
#: First window, in standard deviations of a projection, and its growth by level.
WIDTH, GROWTH, LEVELS = 0.5, 1.15, 24
#: Vectors of a block (ranks have 16 bits), and queries that are broadcast at once.
BLOCK, QUERY_RUN = 8192, 20_000


def usable(vector: Column) -> Column:
    """Neither null nor zero nor with a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(dims: int, n: int, seed: int = 7) -> np.ndarray:
    """n random unit directions, orthogonal within each run of dims."""
    rng, parts = np.random.default_rng(seed), []
    while sum(len(p) for p in parts) < n:
        parts.append(np.linalg.qr(rng.standard_normal((dims, dims)))[0].T)
    return np.concatenate(parts)[:n]


class Index:
    """The sorted arrays of one block: of each vector its rank in every array."""

    def __init__(self, vectors: np.ndarray, projections: int = PROJECTIONS):
        norms = np.einsum("ij,ij->i", vectors, vectors)
        lifted = np.concatenate((vectors, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]), axis=1)
        self.radius = float(np.sqrt(norms.max()))
        self.axes = directions(lifted.shape[1], projections)
        values = self.axes @ lifted.T
        order = np.argsort(values, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values, order, axis=1)
        self.rank = np.empty(order.shape, np.uint16)
        np.put_along_axis(self.rank, order, np.arange(len(vectors), dtype=np.uint16)[None], axis=1)
        self.scale = max(float(values.std()), 1e-12)
        self.vectors, self.level = vectors, LEVELS // 2
        self.shifted, self.inside = np.empty_like(self.rank), np.empty(self.rank.shape, bool)

    def collisions(self, centre: np.ndarray, width: float) -> np.ndarray:
        """In how many arrays each vector's rank lies in the query's window."""
        a = np.array([v.searchsorted(c - width) for v, c in zip(self.sorted, centre)], np.uint16)
        b = np.array([v.searchsorted(c + width, "right") for v, c in zip(self.sorted, centre)], np.int64)
        # Unsigned: ranks before the window wrap around to large numbers.
        np.subtract(self.rank, a[:, None], out=self.shifted)
        np.less(self.shifted, (b - a).astype(np.uint16)[:, None], out=self.inside)
        return np.add.reduce(self.inside.view(np.uint8), axis=0, dtype=np.uint8)

    def candidates(self, query: np.ndarray, wanted: int, threshold: int) -> np.ndarray:
        """Numbers of the vectors that collide often enough, at the first level
        of virtual rehashing at which there are as many as wanted; all of them where the
        widest windows don't find so many."""
        # A query of the block's length: inner products keep their order.
        centre = self.axes[:, :-1] @ (query * (self.radius / float(np.sqrt(query @ query))))
        found, level = {}, self.level  # starts where the last query ended
        while 0 <= level < LEVELS:
            near = np.flatnonzero(self.collisions(centre, WIDTH * GROWTH**level * self.scale) >= threshold)
            found[level] = near
            if len(near) < wanted:
                if level + 1 in found:
                    break
                level += 1
            elif level == 0 or level - 1 in found:
                break
            elif len(near) < 1.5 * wanted:
                self.level = level
                return near
            else:
                level -= 1
        enough = [k for k, v in found.items() if len(v) >= wanted]
        if not enough:
            return np.arange(len(self.vectors))
        self.level = min(enough)
        return found[self.level]


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    flat = table.column("vector").combine_chunks()
    return table.column("id").to_numpy(), np.asarray(flat.flatten(), np.float64).reshape(table.num_rows, -1)


def _search(shared, k: int, share: float, projections: int, threshold: float):
    def run(block: pa.Table) -> pa.Table:
        ids, vectors = _matrix(block)
        wanted_ids, wanted = shared.value
        index, out = Index(vectors, projections), []
        enough = max(TIMES * k, int(share * len(ids)))
        for q, query in zip(wanted_ids.tolist(), wanted):
            at = index.candidates(query, enough, max(1, int(threshold * projections)))
            at = at[ids[at] != q]
            scores = vectors[at] @ query
            if len(at) > 2 * k:  # keeps ties with the last
                near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - 1e-9
                at, scores = at[near], scores[near]
            # Summed the same way for every pair of vectors, whatever the block.
            scores = np.array([np.dot(vectors[i], query) for i in at])
            best = np.lexsort((ids[at], -scores))[:k]
            out.append((np.full(len(best), q), ids[at][best], scores[best]))
        return pa.table(dict(zip(["query_id", "vec_id", "score"], (np.concatenate(c) for c in zip(*out)))))

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, share: float = SHARE, run: int = QUERY_RUN) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows, found approximately."""
    spark = vectors.sparkSession
    importable(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("is_query")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q")).orderBy(F.desc("n"), F.desc("dims")).first()
    empty = spark.createDataFrame([], "query_id long, vec_id long, score double")
    found = empty
    if sizes is not None and sizes.q:
        rows = rows.where(F.size("vector") == sizes.dims)
        blocks, runs = max(1, -(-sizes.n // block)), -(-sizes.q // run)
        # A block of 64 dimensions has 4 MB: the number of tasks is that of the blocks.
        dealt = rows.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).repartition(min(blocks, 100_000), "block")
        queries = rows.where("is_query").select("id", "vector", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(runs)).alias("run"))
        parts = []
        for number in range(runs):
            own = queries.where(F.col("run") == number).orderBy("id").select("id", "vector").toArrow()  # about QUERY_RUN rows
            if own.num_rows:
                shared = spark.sparkContext.broadcast(_matrix(own))
                searched = dealt.groupBy("block").applyInArrow(_search(shared, k, share, PROJECTIONS, THRESHOLD), "query_id long, vec_id long, score double")
                parts.append(materialise(searched, "nearest"))
        found = parts[0]
        for more in parts[1:]:
            found = found.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
