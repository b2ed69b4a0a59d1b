"""Nearest neighbours by largest inner product, with a permutation index.

Every vector is represented by its nearest pivots in order. Rows are dealt to shards
by a hash of their id, so shards are even whatever the vectors are; each shard keeps
inverted files: for each pivot, the vectors that have it among their nearest, with
its place in their order. A query's own nearest pivots name the files to read; the
footrule distance of the two orders (a pivot that a vector lacks costs the full
length) ranks the shard's vectors, and the best are reranked by the inner product in
double precision. The best of each shard are merged.

For inner products vectors get one more component that makes all norms equal (zero
for queries), which turns the order by inner product into one by angle. Equal vectors
of a shard are indexed once and keep their ids, so a vector that occurs very often
takes one candidate's place. All queries meet all shards, in blocks of queries.

Vectors that are null, zero, hold null or non-finite components, or have another
dimension than most take no part; nor do rows without an id. Rows that share an id are
rows of their own: each is a candidate for the others, and each different vector of a
query's id is a query. Of rows with equal id and vector one is the query's own, the rest
are candidates, and they ask once. No vectors give no rows; fewer than k candidates
give all of them. Other columns have no effect. On vectors without clusters (as in the
tables at hand) nearest rows share few pivots, so SHARE has to be large for the recall.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Vectors that become pivots, pivots in an order, rows of a shard, queries of a block.
PIVOTS, LENGTH, SHARD, BLOCK = 256, 64, 8192, 65_536
#: Share of a shard's vectors that are reranked, and the least number.
SHARE, LEAST = 0.3, 256


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    own = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    own = own.where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))
    return own


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the `length` nearest pivots of each row, nearest first, ties by number."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :length]


def raised(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with one more component, so that all have the norm `most`."""
    return np.concatenate((x, np.sqrt(np.maximum(most * most - (x * x).sum(axis=1), 0))[:, None]), axis=1)


class Shard:
    """Inverted files of some vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, length: int, most: float):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        self.x, back = np.unique(x, axis=0, return_inverse=True)
        back = back.ravel()
        by = np.argsort(back, kind="stable")
        self.ids, self.starts = ids[by], np.concatenate(([0], np.cumsum(np.bincount(back, minlength=len(self.x)))))
        self.length = length
        near = nearest_pivots(raised(self.x, most), pivots, length)
        self.length = near.shape[1]
        flat = near.ravel()
        order = np.argsort(flat, kind="stable")
        self.posted, self.place = order // self.length, order % self.length
        self.files = np.searchsorted(flat[order], np.arange(len(pivots) + 1))

    def footrule(self, near: np.ndarray) -> np.ndarray:
        """Distance of a query's order to every vector's; pivots that either lacks are at place `length`."""
        n = self.length
        out = np.full(len(self.x), n * (n + 1), np.int64)
        for i, p in enumerate(near.tolist()):
            lo, hi = self.files[p], self.files[p + 1]
            place = self.place[lo:hi]
            out[self.posted[lo:hi]] -= (n - i) + (n - place) - np.abs(i - place)
        return out

    def search(self, vec_id: int, q: np.ndarray, near: np.ndarray, k: int, candidates: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k, the query's own row left out."""
        distance = self.footrule(near) * len(self.x) + np.arange(len(self.x))
        found = np.argpartition(distance, candidates)[:candidates] if candidates < len(distance) else np.argsort(distance)
        score = (self.x[found] * q).sum(axis=1)
        best = np.lexsort((self.ids[self.starts[found]], -score))[: k + 1]
        parts = []
        for i in found[best].tolist():
            own = self.ids[self.starts[i] : self.starts[i + 1]][: k + 1]  # ascending; of more than these the query's own isn't missed
            if (self.x[i] == q).all():
                at = int(np.searchsorted(own, vec_id))
                if at < len(own) and own[at] == vec_id:
                    own = np.delete(own, at)
            parts.append(own[:k])
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        scores = np.repeat(score[best], [len(p) for p in parts])
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table["vec_id"].to_numpy()
    flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS, length: int = LENGTH, shard: int = SHARD, block: int = BLOCK, share: float = SHARE, least: int = LEAST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found of each query among the vectors of other ids.

    Both tables have an id and a vector. The pivots are a sample of at most `pivots`
    vectors by a hash of their id; everything else covers all rows.
    """
    own, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    sizes = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("most")).orderBy(F.desc("n"), "d").first()
    empty = own.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if sizes is None:
        return empty
    own, asked = own.where(F.size("v") == sizes["d"]), asked.where(F.size("v") == sizes["d"])
    most = math.sqrt(sizes["most"])
    chosen = own.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots).toArrow()
    table = np.unique(raised(_matrix(chosen)[1], most), axis=0)
    sent = own.sparkSession.sparkContext.broadcast(table)
    shards = max(1, -(-sizes["n"] // shard))
    blocks = max(1, -(-asked.count() // block))
    left = own.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    right = asked.select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("b"))
    schema = pa.schema([("query_id", pa.int64()), ("asked", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        index = Shard(*_matrix(a), sent.value, length, most)
        ids, q = _matrix(b)
        order = np.lexsort((*q.T[::-1], ids))
        ids, q = ids[order], q[order]
        fresh = np.concatenate(([True], (ids[1:] != ids[:-1]) | (q[1:] != q[:-1]).any(axis=1)))
        ids, q = ids[fresh], q[fresh]
        near = nearest_pivots(np.concatenate((q, np.zeros((len(q), 1))), axis=1), sent.value, index.length)
        candidates = max(least, math.ceil(share * len(index.x)))
        found = [index.search(int(i), v, p, k, candidates) for i, v, p in zip(ids, q, near, strict=True)]
        n = [len(f[0]) for f in found]
        marks = np.array([xxhash.xxh64_intdigest(v.tobytes()) for v in q], np.uint64).view(np.int64)  # tells queries of one id apart
        return pa.table([pa.array(np.repeat(ids, n)), pa.array(np.repeat(marks, n)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], schema=schema)

    local = left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInArrow(run, "query_id bigint, asked bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
