"""Packing by column generation for the cutting-stock problem.

Documents of more than ``capacity`` ids are cut at its multiples; what is left of
a document is one piece. Pieces fall into length classes of ``grain`` ids. Over
the histogram of the classes (as many rows as classes, whatever the input) the
driver solves the cutting-stock linear program: a revised simplex whose columns,
patterns of classes that fit one sequence, are priced by an unbounded knapsack
dynamic program. Patterns are used a whole number of times (rounded down); the
few pieces left over are packed best-fit by class. Then every piece gets its
rank within its class, and the class's slots (pattern, copy) are dealt out by
rank. Ranks come from counts by (class, salt), so a class that holds a third of
all pieces is many groups.

Each document ends with ``end_id``, so a null or empty text is a piece of one
id. Repeated rows and null doc_ids are documents of their own, told apart by a
number in the pieces' table. Equal lengths are ranked by that number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, slices, strings
from .linalg import inverse as inverted
from .linalg import times
from .tokens import SLICE, encoder

CAPACITY, GRAIN, END_ID, SALTS = 4096, 16, 2, 256


def knapsack(value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Best multiset of classes 1..room (class w weighs w, is worth value[w - 1])."""
    best, pick = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        worth = value[:c] + best[c - 1 :: -1][:c]
        k = int(worth.argmax())
        best[c], pick[c] = worth[k], k + 1
        if best[c - 1] >= best[c]:
            best[c], pick[c] = best[c - 1], 0
    made, c = np.zeros(room, np.int64), room
    while c > 0:
        if pick[c]:
            made[pick[c] - 1] += 1
            c -= pick[c]
        else:
            c -= 1
    return float(best[room]), made


def patterns(demand: np.ndarray, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """(classes of a sequence, copies): together they hold demand[w - 1] pieces of class w, no more.

    demand: pieces of each class 1..room, room grains to a sequence.
    """
    room, left, out = len(demand), demand.astype(np.int64).copy(), []
    rows = np.flatnonzero(left)
    if not len(rows):
        return out
    need = left[rows].astype(float)
    basis = np.zeros((room, len(rows)), np.int64)  # a pattern in each column
    for j, r in enumerate(rows):
        basis[r, j] = room // (r + 1)
    inverse = np.diag(1 / basis[rows, np.arange(len(rows))].astype(float))
    use = times(inverse, need)
    for step in range(1, rounds + 1):
        price = np.zeros(room)
        price[rows] = np.maximum(inverse.sum(0), 0)
        gain, column = knapsack(price, room)
        if gain <= 1 + 1e-7:
            break
        d = times(inverse, column[rows].astype(float))
        if not (d > 1e-9).any():
            break
        ratio = np.where(d > 1e-9, np.maximum(use, 0) / np.where(d > 1e-9, d, 1), np.inf)
        j = int(ratio.argmin())
        theta = ratio[j]
        use -= theta * d
        use[j] = theta
        inverse[j] /= d[j]
        others = np.arange(len(rows)) != j
        inverse[others] -= d[others, None] * inverse[j]
        basis[:, j] = column
        if step % 200 == 0:
            inverse = inverted(basis[rows])
            use = times(inverse, need)
    for j in np.argsort(-use, kind="stable"):
        p = basis[:, j].copy()
        p[np.setdiff1d(np.arange(room), rows)] = 0
        some = p > 0
        if some.any() and (n := min(int(use[j] + 1e-9), int((left[some] // p[some]).min()))) > 0:
            out.append((p, n))
            left -= n * p
    while left.any():  # best fit: the largest class that is left, then whatever fits next
        p, free = np.zeros(room, np.int64), room
        for w in range(room, 0, -1):
            if w <= free and left[w - 1]:
                p[w - 1] = min(left[w - 1], free // w)
                free -= w * int(p[w - 1])
        n = int((left[p > 0] // p[p > 0]).min())
        out.append((p, n))
        left -= n * p
    return out


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for a, z in slices(strings(b.column(1))[1], SLICE):
                part = b.slice(a, z - a)
                ids, many = enc.encode(part.column(1))
                rows, at = [], 0
                for doc, n in zip(part.column(0).to_pylist(), many.tolist()):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    rows += [(doc, s, min(capacity, n + 1 - s), zlib.crc32(own[s : s + capacity]), n + 1) for s in range(0, n + 1, capacity)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, grain: int = GRAIN, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece."""
    cut = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(tokenizer, capacity, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    cut = settle(cut.withColumn("nr", F.monotonically_increasing_id()), "pieces")
    cut = cut.withColumn("class", F.ceil(F.col("length") / grain).cast("int")).withColumn("salt", F.pmod(F.xxhash64("nr"), F.lit(SALTS)).cast("int"))
    counts = cut.groupBy("class", "salt").count()
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("class").orderBy("salt")) - F.col("count")).select(F.col("class").alias("c"), F.col("salt").alias("s"), "before")
    demand = np.zeros(capacity // grain, np.int64)
    for c, n in counts.groupBy("class").agg(F.sum("count")).collect():  # a row for each class
        demand[c - 1] = n
    slots, base, seen = [], 0, np.zeros(len(demand), np.int64)
    for p, n in patterns(demand):
        for w in np.flatnonzero(p).tolist():
            slots.append((w + 1, int(seen[w]), int(seen[w] + n * p[w]), int(p[w]), base))
            seen[w] += n * p[w]
        base += n
    spark = docs.sparkSession
    slot = F.broadcast(spark.createDataFrame(slots or [(0, 0, 0, 1, 0)], "c int, lo long, hi long, per long, base long"))  # classes x patterns: bounded
    # the rank of a piece in its class: what lower salts hold, then the row number within its salt
    own = cut.withColumn("own", F.row_number().over(Window.partitionBy("class", "salt").orderBy("nr")) - 1)
    b = F.broadcast(before)  # classes x salts rows at most
    ranked = own.join(b, (own["class"] == b["c"]) & (own["salt"] == b["s"])).withColumn("rank", F.col("own") + F.col("before")).drop("c", "s")
    placed = ranked.join(slot, (ranked["class"] == slot["c"]) & (ranked["rank"] >= slot["lo"]) & (ranked["rank"] < slot["hi"]))
    placed = placed.withColumn("sequence_id", F.col("base") + F.expr("(rank - lo) div per"))
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0).cast("long")).alias("offset"))
