"""SimHash near-dedup with BK-trees.

Fingerprints link at ``radius`` or fewer differing bits. 64 bits are cut into
``radius + 2`` blocks; two linked fingerprints agree on two blocks at least, so
the fingerprints are dealt by each pair of blocks. Every such shard is a BK-tree
(children keyed by their integer Hamming distance to the parent), built once and
searched by its own members along the edges within the radius only. A shard
emits a spanning forest, not its pairs; star rounds join the forests.

The trees go to the queries by shuffle and not by broadcast: all fingerprints
have no size bound, a shard's have (those that share half of the bits).

Nulls and empty texts have no words: fingerprint zero, linked like any other.
Repeated rows each get a row. A null doc_id never names a component unless
nothing else could. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, slices, strings
from .components import components
from .words import split_words, xxh64

SLICE = 1 << 20
ONES = np.uint64(0x0101010101010101)


def shingles(start: np.ndarray, length: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length in bytes of every shingle, and the number of shingles of each text."""
    words = np.diff(first)
    many = np.where(words == 0, 0, np.maximum(words - width + 1, 1))
    a = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    b = a + np.repeat(np.minimum(words, width), many) - 1
    return start[a], start[b] + length[b] - start[a], many


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int = 3) -> np.ndarray:
    """A bit is 1 if it is set in over half of the text's shingle hashes."""
    buf, start, length, first = split_words(data, offsets)
    s, n, many = shingles(start, length, first, width)
    return majority(xxh64(buf, s, n) if len(s) else np.zeros(0, np.uint64), many)


def majority(h: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For texts of so many hashes each: the bits that are set in over half of them."""
    out = np.zeros(len(many), np.uint64)
    if not len(h):
        return out
    full = np.flatnonzero(many)
    begin = np.concatenate(([0], np.cumsum(many[full])[:-1]))
    parts = -(-many[full] // 255)  # bytes count up to 255 shingles
    of = np.concatenate(([0], np.cumsum(parts)[:-1]))
    cut = np.repeat(begin, parts) + 255 * (np.arange(parts.sum()) - np.repeat(of, parts))
    for j in range(8):
        sums = np.add.reduceat((h >> np.uint64(j)) & ONES, cut).view(np.uint8).reshape(-1, 8)
        sums = np.add.reduceat(sums.astype(np.int64), of, axis=0)
        for k in range(8):
            out[full] |= (2 * sums[:, k] > many[full]).astype(np.uint64) << np.uint64(8 * k + j)
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = strings(b.column(1))
        got = [fingerprints(data, offsets[x : y + 1]) for x, y in slices(offsets, SLICE)]
        if got:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(got).view(np.int64))], ["doc_id", "fp"])


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of a[i] with b[i] in place; root[i] is the least member of i's set."""
    while True:
        x, y = root[a], root[b]
        if not (apart := x != y).any():
            return
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := root[root], root):
            root[:] = up


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints of one word each, or of several (a row each)."""
    bits = np.bitwise_count(a ^ b).astype(np.int64)
    return bits.sum(1) if bits.ndim > 1 else bits


class BkForest:
    """BK-trees of several shards: shard[i] is ascending, its first member is the root."""

    def __init__(self, shard: np.ndarray, value: np.ndarray) -> None:
        self.value, n = value, len(value)
        opens = np.concatenate(([True], shard[1:] != shard[:-1])) if n else np.zeros(0, bool)
        self.root = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        todo = np.flatnonzero(~opens)
        at = self.root[todo]
        while len(todo):
            d = distance(value[todo], value[at])
            _, lead, back = np.unique(at * (64 * value[0].size + 1) + d, return_index=True, return_inverse=True)
            child = todo[lead]
            parent[child], edge[child] = at[lead], d[lead]
            at = child[back]
            at, todo = at[at != todo], todo[at != todo]
        order = np.argsort(parent, kind="stable")
        self.child, self.edge = order[np.searchsorted(parent[order], 0) :], None
        self.edge = edge[self.child]
        self.begin = np.searchsorted(parent[self.child], np.arange(n + 1))

    def links(self, radius: int, most: int = 1 << 16, asked: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j) of one shard within the radius, a block of queries at a time: j < i, or for the asked members i all others j."""
        whole = np.arange(len(self.value)) if asked is None else asked
        for q0 in range(0, len(whole), most):
            q = whole[q0 : q0 + most]
            stack = [(q, self.root[q])]
            while stack:
                q, node = stack.pop()
                if len(q) > most:
                    half = len(q) // 2
                    stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                    continue
                d = distance(self.value[q], self.value[node])
                near = (d <= radius) & ((node < q) if asked is None else (node != q))
                if near.any():
                    yield q[near], node[near]
                many = self.begin[node + 1] - self.begin[node]
                if total := int(many.sum()):
                    c = np.repeat(self.begin[node] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(total)
                    go = np.abs(self.edge[c] - np.repeat(d, many)) <= radius
                    if go.any():
                        stack.append((np.repeat(q, many)[go], self.child[c[go]]))


def _forest(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spanning(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            again = key[1:] == key[:-1]
            keep = np.concatenate((again, [False])) | np.concatenate(([False], again))
            key, fp = key[keep], fp[keep]
            root = np.arange(len(fp))
            for a, b in BkForest(key, fp.view(np.uint64)).links(radius):
                unite(root, a, b)
            own = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[root[own]])], ["a", "b"])

        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:  # sorted by key; the last shard may go on in the next batch
            key, fp = np.concatenate((key, b.column(0).to_numpy())), np.concatenate((fp, b.column(1).to_numpy()))
            if len(key) and (cut := int(np.searchsorted(key, key[-1]))):
                yield spanning(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield spanning(key, fp)

    return run


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) for every row of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, fp (long), component_id (smallest doc_id reachable) for every row of docs."""
    fps = settle(fingerprint_table(docs), "fingerprints")
    distinct = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    blocks = radius + 2
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in pair) for pair in combinations(range(blocks), 2)]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(masks)])
    shards = distinct.select(F.explode(keys).alias("key"), "fp")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = shards.repartition(parts, "key").sortWithinPartitions("key", "fp").mapInArrow(_forest(radius), "a long, b long")
    roots = components(links)
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.where("root <> fp").groupBy("root").agg(F.min("least").alias("below")).withColumnRenamed("root", "top")
    labels = named.join(least, F.col("root") == F.col("top"), "left").select("fp", F.least("least", "below").alias("mine"), "root", "top")
    # a root's label is that of its whole group; members look it up
    tops = labels.where("root = fp").select(F.col("fp").alias("r"), F.col("mine").alias("component_id"))
    labels = settle(labels.join(tops, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id"), "labels")
    return fps.join(labels, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")
