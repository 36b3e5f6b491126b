"""Token-ID output in training order.

Texts become token ids (each document ends with ``end_id``) and sequences of at
most ``stride`` ids. Sequences are numbered 0..N-1 by the offsets of their part
files. A keyed Feistel network permutes the least even-bit domain that holds N,
and cycle-walking (applying it again while the value is N or more) makes it a
permutation of 0..N-1: every sequence gets a global slot without a sort or any
state to keep. Range partitions by shard write the slots in order as records of
fixed size (stride ids, padded with ``pad_id``), ``shard_rows`` records to a
shard, whose bytes are one value of a Parquet row: slot s is in shard s div
shard_rows at byte (s mod shard_rows) x record of that value,
so a reader starts anywhere (``resume``).

A null or empty text is the end id alone. Repeated rows and null doc_ids are
documents of their own. No rows: no shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, slices, strings
from .tokens import SLICE, encoder


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser of x under a round key."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """The slot of each index: a permutation of 0..n-1 that depends on the key."""
    half = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [int.from_bytes(zlib.crc32(f"{key}/{r}".encode()).to_bytes(4, "big") * 2, "big") for r in range(rounds)]
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _sequences(path: str, stride: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, nr, part = encoder(path), 0, TaskContext.get().partitionId()
        kind = "<u2" if enc.tok.get_vocab_size() <= 1 << 16 else "<u4"
        for b in batches:
            for a, z in slices(strings(b.column(1))[1], SLICE):
                rows, at, some = [], 0, b.slice(a, z - a)
                ids, many = enc.encode(some.column(1))
                for doc, n in zip(some.column(0).to_pylist(), many.tolist()):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype(kind)
                    at += n
                    for s in range(0, n + 1, stride):
                        rows.append((doc, s, min(stride, n + 1 - s), part, nr, own[s : s + stride].tobytes()))
                        nr += 1
                cols = zip(zip(*rows), (pa.int64(),) * 5 + (pa.binary(),))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], ["doc_id", "start", "length", "part", "nr", "ids"])

    return run


def _slots(n: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(feistel(b.column(4).to_numpy(), n, key))], ["doc_id", "start", "length", "ids", "slot"])

    return run


def _shards(record: int, shard_rows: int, pad: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by slot; a shard is whole within its partition."""
        now, parts, first = None, [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([first], pa.int64()), pa.array([len(parts)], pa.int64()), pa.array([b"".join(parts)], pa.binary())], ["shard", "first_slot", "records", "bytes"])

        for b in batches:
            for slot, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if slot // shard_rows != now:
                    if parts:
                        yield done()
                    now, parts, first = slot // shard_rows, [], slot
                parts.append(ids + pad * ((record - len(ids)) // len(pad)))
        if parts:
            yield done()

    return run


def materialise(docs: DataFrame, tokenizer: str, key: int = 17, stride: int = 1024, shard_rows: int = 2048, end_id: int = 2, pad_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """(index: doc_id, start, length, slot; shards: shard, first_slot, records, bytes), both written."""
    run = _sequences(tokenizer, stride, end_id)
    seq = settle(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, length long, part long, nr long, ids binary"), "sequences")
    counts = seq.groupBy("part").count()  # a row for each part file
    before = counts.select(F.col("part").alias("p"), (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    n = seq.count()
    numbered = seq.join(F.broadcast(before), F.col("part") == F.col("p")).select("doc_id", "start", "length", "ids", (F.col("before") + F.col("nr")).alias("index"))
    slotted = numbered.mapInArrow(_slots(n, key), "doc_id long, start long, length long, ids binary, slot long")
    index = settle(slotted.drop("ids"), "slots")
    width = 2 if encoder(tokenizer).tok.get_vocab_size() <= 1 << 16 else 4
    parts = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // shard_rows)))
    ordered = slotted.select("slot", "ids").withColumn("shard", F.expr(f"slot div {shard_rows}")).repartitionByRange(parts, "shard").sortWithinPartitions("slot").select("slot", "ids")
    shards = settle(ordered.mapInArrow(_shards(width * stride, shard_rows, pad_id.to_bytes(width, "little")), "shard long, first_slot long, records long, bytes binary"), "shards")
    return index, shards


def resume(shards: DataFrame, slot: int, stride: int = 1024, width: int = 2, shard_rows: int = 2048) -> DataFrame:
    """slot, record (stride ids as bytes) from the given slot on.

    The shards are in ranges, one to a part file, so the filter on the shard is pushed to
    the scan: of files with earlier shards only the footer is read.
    """
    record = stride * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, many, data in zip(*(b.column(k).to_pylist() for k in range(3))):
                skip = max(0, slot - first)
                own = range(skip, many)
                yield pa.RecordBatch.from_arrays([pa.array([first + k for k in own], pa.int64()), pa.array([data[k * record : (k + 1) * record] for k in own], pa.binary())], ["slot", "record"])

    return shards.where(F.col("shard") >= slot // shard_rows).select("first_slot", "records", "bytes").mapInArrow(run, "slot long, record binary")
