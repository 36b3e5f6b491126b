"""Approximate nearest neighbours: hash-prefix forests (LSH forests).

Equal vectors become one class first, with its ``k + 1`` smallest ids: more of
them can never be among the k nearest. Classes are dealt into shards of about
``shard_rows``; each shard holds a forest of ``trees`` sorted arrays of 32-bit
hash strings (signs of random projections; maximum inner product is made an
angle by one more coordinate that lifts every vector to the same norm). A query
descends every tree to its longest matching prefix by binary search and then
ascends all trees together, one bit at a time, scoring what it meets exactly in double
precision, until its prefix ranges hold ``share`` of the trees' entries or the k-th
score has stayed the same while the vectors looked at doubled.
Queries meet shards in blocks, so a task holds one shard and one block.

Vectors null, empty, zero, or holding null or non-finite components take no part;
vectors are compared with those of their own length only. Repeated ids count as
several rows. Ties go to the smaller vec_id. No vectors or queries: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

BITS = 32


class Forest:
    def __init__(self, x: np.ndarray, norm: float, trees: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.planes = rng.normal(size=(x.shape[1] + 1, trees * BITS)).astype(np.float32)
        self.norm, self.trees = norm, trees
        lift = np.sqrt(np.maximum(norm**2 - (x * x).sum(1), 0))
        keys = self.keys(np.column_stack((x, lift)))
        self.order = np.argsort(keys, axis=0, kind="stable")
        self.sorted = np.take_along_axis(keys, self.order, axis=0)

    def keys(self, lifted: np.ndarray) -> np.ndarray:
        bits = (lifted.astype(np.float32) @ self.planes > 0).reshape(len(lifted), self.trees, BITS)
        return (bits * (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))).sum(2).astype(np.int64)

    def nearest(self, x: np.ndarray, q: np.ndarray, enough: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of the shard x that each query has looked at, and their scores.

        All trees ascend together until the ranges hold `enough` entries and k rows, or the k-th
        best score has stayed the same while the rows looked at doubled.
        """
        keys = self.keys(np.column_stack((q, np.zeros(len(q)))))
        low, high = [], []
        for bits in range(BITS + 1):  # a prefix range shrinks as the prefix grows
            a = keys >> (BITS - bits) << (BITS - bits)
            lo = np.column_stack([np.searchsorted(self.sorted[:, t], a[:, t]) for t in range(self.trees)])
            hi = np.column_stack([np.searchsorted(self.sorted[:, t], a[:, t] + (1 << (BITS - bits))) for t in range(self.trees)])
            low.append(lo)
            high.append(hi)
            if ((hi - lo).sum(1) < k).all():
                break
        held = (np.array(high) - np.array(low)).sum(2)
        first, last = (np.maximum((held >= m).sum(0) - 1, 0) for m in (k, enough))
        for i in range(len(q)):
            seen, rows, scores, best, at = np.zeros(len(x), bool), np.zeros(0, np.int64), np.zeros(0), -np.inf, 0
            for level in range(first[i], -1, -1):
                before = seen.copy()
                for t in range(self.trees):
                    seen[self.order[low[level][i, t] : high[level][i, t], t]] = True
                new = np.flatnonzero(seen & ~before)
                rows, scores = np.concatenate((rows, new)), np.concatenate((scores, (x[new] * q[i]).sum(1)))
                if len(rows) < k:  # trees that agree hold one vector many times
                    continue
                if level <= last[i]:
                    break
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                if kth > best:
                    best, at = kth, len(rows)
                elif len(rows) >= 2 * at:
                    break
            yield rows, scores


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _search(k: int, trees: int, share: float, norms: dict[int, float]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            x, q = _matrix(left["v"]), _matrix(right["v"])
            forest = Forest(x, norms[x.shape[1]], trees, 1)
            xid, qid = left["id"].to_numpy(), right["id"].to_numpy()
            enough = max(4 * k, int(np.ceil(share * len(x) * trees)))
            for i, (c, s) in enumerate(forest.nearest(x, q, enough, k + 1)):
                if len(c) > 2 * k + 1:
                    cut = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                    c, s = c[s >= cut], s[s >= cut]
                out.append((np.full(len(c), qid[i]), xid[c], s))
        cols = [np.concatenate(z) for z in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table({"q": pa.array(cols[0]), "c": pa.array(cols[1]), "score": pa.array(cols[2])})

    return run


def search(vectors: DataFrame, every: int = 20, k: int = 20, trees: int = 10, share: float = 0.1, shard_rows: int = 4096, block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, its k nearest other rows found.

    share: of the trees' entries in a shard, what a query's prefix ranges must hold.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.expr("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    v = v.where(fine)
    # classes of equal vectors, with counts by salt first so that a common vector is no hot group
    few = lambda c: F.slice(F.array_sort(c), 1, k + 1)
    rows = v.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    near = rows.withColumn("r", F.row_number().over(Window.partitionBy("v", "salt").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    classes = near.groupBy("v").agg(few(F.collect_list("vec_id")).alias("ids")).withColumn("id", F.monotonically_increasing_id())
    classes = settle(classes, "vector-classes")
    sizes = {r[0]: (r[1], r[2]) for r in classes.groupBy(F.size("v")).agg(F.count("*"), F.max(F.expr("sqrt(aggregate(v, 0D, (a, x) -> a + x * x))"))).collect()}  # a row for each length
    norms, n = {d: m for d, (_, m) in sizes.items()}, sum(c for c, _ in sizes.values())
    asked = v.where(F.col("vec_id") % every == 0).select("vec_id", "v")
    q = asked.select("v").distinct().join(classes.select(F.col("v").alias("w"), "id"), F.col("v") == F.col("w")).select("id", "v")
    q = settle(q, "query-classes")
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-q.count() // block))
    dim = F.size("v").alias("dim")
    left = classes.select("id", "v", dim, F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    right = q.select("id", "v", dim, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int").alias("b"))
    found = left.groupBy("dim", "s", "b").cogroup(right.groupBy("dim", "s", "b")).applyInArrow(_search(k, trees, share, norms), "q long, c long, score double")
    found = found.withColumn("r", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("r") <= k + 1).drop("r")
    ids = classes.select(F.col("id").alias("cid"), F.explode("ids").alias("vec_id"))
    found = found.join(ids, F.col("c") == F.col("cid")).select("q", "score", "vec_id")
    # of a class's queries each drops itself, so k + 1 rows of the class are enough
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1).drop("r")
    own = asked.join(classes.select(F.col("v").alias("w"), "id"), F.col("v") == F.col("w")).select(F.col("vec_id").alias("query_id"), F.col("id").alias("q2"))
    hits = own.join(found, F.col("q2") == F.col("q")).where("vec_id <> query_id")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
