"""Sharding by Karmarkar-Karp differencing: groups of equal texts, shards of near-equal bytes.

Rows with equal texts go together. Bytes are summed by group, then:

* a group of at least 1 of ``shards * fine`` parts of all bytes is an item of its own
  (``shards * fine`` of them at most, whatever the input);
* the groups below that share ``fine_bundles`` bundles by their hash; each is an item.

The items (a few thousand numbers) are differenced: an item is a partial partition with
one filled lane, and the two partials with the largest spread are combined, the fullest
lane of one with the emptiest of the other, until one is left. An item that is no less
than the mean of what it would share the shards with has a shard to itself: no
partition is more even with it than without. Shards go back to the rows by two
broadcast maps of items, so only sums by group are shuffled.

A slot is a row's place in its shard: rows of the shard in earlier input parts, then
its number within the part, so no shard is one task.

A null text is an empty one. A group is known by a 64-bit hash of its text; were two
texts to share it, they would share a shard. Repeated rows and null doc_ids are rows of
their own. No rows: no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, settle

SHARDS, FINE, BUNDLES, EACH = 40, 64, 4096, 16


def alone(sizes: dict, bins: int) -> list:
    """Items no smaller than the mean of what is left, largest first: each fills a bin of its own."""
    left, out = sum(sizes.values()), []
    for key in sorted(sizes, key=lambda k: (-sizes[k], k)):
        if len(out) >= bins - 1 or sizes[key] * (bins - len(out)) < left:
            break
        out.append(key)
        left -= sizes[key]
    return out


def difference(sizes: dict, bins: int) -> list[list]:
    """The items of each bin by largest differencing; ties go to the smaller key."""
    if not sizes or bins < 1:
        return [[] for _ in range(bins)]
    heap = [(-n, key, [(n, [key]), *((0, []) for _ in range(bins - 1))]) for key, n in sizes.items()]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, key, a = heapq.heappop(heap)
        _, other, b = heapq.heappop(heap)
        lanes = [(x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))]
        lanes.sort(key=lambda lane: -lane[0])
        heapq.heappush(heap, (lanes[-1][0] - lanes[0][0], min(key, other), lanes))
    return [items for _, items in heap[0][2]]


def deal(sizes: dict, bins: int) -> dict:
    """The bin of each item."""
    large = alone(sizes, bins)
    rest = {k: n for k, n in sizes.items() if k not in set(large)}
    return {k: b for b, items in enumerate([[k] for k in large] + difference(rest, bins - len(large))) for k in items}


def shard(docs: DataFrame, shards: int = SHARDS, fine: int = FINE, bundles: int = BUNDLES, each: int = EACH) -> DataFrame:
    """doc_id, size (UTF-8 bytes and `each` for the row), text_crc32, law, shard, slot, grown_shard (null: bytes decide)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + each).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    rows = settle(rows.withColumn("nr", F.monotonically_increasing_id()), "sized")
    sums = settle(rows.groupBy("text_hash").agg(F.sum("size").alias("bytes")), "text-bytes")
    total = sums.agg(F.sum("bytes")).first()[0] or 0
    bundle = F.pmod(F.xxhash64("text_hash"), F.lit(bundles))
    big = F.col("bytes") * (shards * fine) >= total
    items = sums.groupBy(F.when(big, F.col("text_hash")).alias("item"), F.when(~big, bundle).alias("bundle")).agg(F.sum("bytes").alias("bytes"))
    sizes = {(r["bundle"] is not None, r["bundle"] if r["item"] is None else r["item"]): r["bytes"] for r in items.collect()}  # shards * fine + bundles at most
    forget(sums)
    bins = deal(sizes, shards)
    make = rows.sparkSession.createDataFrame
    own = F.broadcast(make([(k, b) for (rest, k), b in bins.items() if not rest], "item long, item_bin int"))
    rest = F.broadcast(make([(k, b) for (rest, k), b in bins.items() if rest], "bundle long, bundle_bin int"))
    placed = rows.join(own, F.col("text_hash") == F.col("item"), "left").join(rest, F.col("bundle") == bundle, "left")
    placed = placed.select("doc_id", "size", "text_crc32", "nr", F.shiftrightunsigned("nr", 33).alias("part"), F.coalesce("item_bin", "bundle_bin").alias("shard"))
    counts = placed.groupBy("part", "shard").agg(F.count("*").alias("many"))
    before = counts.select(F.col("part").alias("p"), F.col("shard").alias("s"), (F.sum("many").over(Window.partitionBy("shard").orderBy("part")) - F.col("many")).alias("before"))
    placed = placed.withColumn("own", F.row_number().over(Window.partitionBy("part", "shard").orderBy("nr")) - 1)
    slotted = placed.join(before, (F.col("part") == F.col("p")) & (F.col("shard") == F.col("s")))
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("own")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
