"""SimHash near-dedup at a similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Shards: of two sets that similar, each one's first n - ceil(0.8 n) + 1 shingles, in
any order common to all texts, share one; so a text is dealt to the shards of
these shingles only. The order puts seldom shingles first, by counts in a table
of fixed size, which keeps common passages from making shards.

In a shard the texts meet as SimHash fingerprints (of the set of shingles, 1024 bits) in
BK-trees whose edges are followed within a radius. At a similarity of 0.8 a bit differs
with a probability of 0.152, by the sizes of the sets 0.161 at worst (0.188 for sets of four),
and the radius is that share of the bits and five standard deviations: 223 of 1024 bits. Texts
that have nothing in common differ in 512 (16). Pairs within the radius are verified on
their whole sets; star rounds join the links. Texts without words are equal to each other.

A text meets the least text of each of its shards, first only the one with which it
shares most shards, then those that are not of its group yet. Last, shards whose
members are still of several groups are searched for pairs of different groups, first
for each text's 2 and 16 nearest, then for all. A group of near copies is joined by
the first of these, so no shard gives all its pairs. In the last search shards of over
``LARGE`` texts use 4096 bits, whose radius (777) is a narrower share. Equal texts are one text
throughout; a task sends the keys of a text that it has seen once only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle, slices, strings
from .components import components
from .linededup import held, marked
from .simhash import SLICE, BkForest, distance, majority, shingles
from .words import split_words, xxh64

WIDTH = 5
WORDS, WIDE, LARGE = 16, 64, 64
BUCKETS = 1 << 20
#: A task forgets which texts it has seen after so many.
SEEN = 1 << 18


def _hashes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All shingle hashes of the texts, and how many each has, for slices of the column."""
    data, offsets = strings(column)
    for x, y in slices(offsets, SLICE):
        buf, start, length, first = split_words(data, offsets[x : y + 1])
        s, n, many = shingles(start, length, first, WIDTH)
        yield xxh64(buf, s, n) if len(s) else np.zeros(0, np.uint64), many


def _sets(column: pa.Array) -> list[np.ndarray]:
    """Each text's distinct shingle hashes."""
    return [np.unique(p) for h, many in _hashes(column) for p in np.split(h, np.cumsum(many)[:-1])]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for h, _ in _hashes(b.column(0)):
            count += np.bincount(_bucket(h), minlength=BUCKETS)
    some = np.flatnonzero(count > 2 * count.mean() + 8)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["bucket", "many"])


def fingerprints(sets: list[np.ndarray], many: np.ndarray, words: int = WORDS) -> np.ndarray:
    """words x 64 bits of each set: majorities of the hashes and of mixtures of them."""
    h = np.concatenate([np.zeros(0, np.uint64), *sets])
    out = []
    with np.errstate(over="ignore"):
        for k in range(words):
            out.append(majority(h, many))
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
            h ^= h >> np.uint64(29)
    return np.column_stack(out)


def radius(words: int, few: bool) -> int:
    """Bits in which fingerprints of sets with a similarity of 0.8 may differ."""
    p, bits = 0.1875 if few else 0.1611, 64 * words
    return int(bits * p + 5 * (bits * p * (1 - p)) ** 0.5)


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = _sets(b.column(1))
        f = fingerprints(sets, np.array([len(h) for h in sets], np.int64), WIDE)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in f], pa.binary())], ["wn", "w"])


def _keys(count: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """nr, n, key of a text's shards; and one row with its fingerprint."""
        seen: set[int] = set()
        for b in batches:
            fresh = []
            for k, x in enumerate(b.column(0).to_pylist()):
                if x not in seen:
                    seen.add(x)
                    fresh.append(k)
            if len(seen) > SEEN:
                seen = set()
            b = b.take(pa.array(fresh, pa.int64()))
            sets, nr = _sets(b.column(1)), b.column(0).to_numpy()
            n = np.array([len(h) for h in sets], np.int64)
            own = []
            for h in sets:
                take = len(h) - -(-4 * len(h) // 5) + 1
                order = np.argsort(count[_bucket(h)], kind="stable")[:take]  # ties by hash
                own.append(h[order].view(np.int64) if len(h) else np.zeros(1, np.int64))
            size = [len(k) for k in own]
            keys = np.concatenate([np.zeros(0, np.int64), *own])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nr, size)), pa.array(np.repeat(n, size)), pa.array(keys), pa.nulls(len(keys), pa.binary())], ["nr", "n", "key", "f"])
            yield pa.RecordBatch.from_arrays([pa.array(nr), pa.array(n), pa.array(nr), pa.array([x.tobytes() for x in fingerprints(sets, n)], pa.binary())], ["nr", "n", "key", "f"])

    return run


def _alike(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sets of these sizes can reach the similarity."""
    return 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)


def _within(bits: np.ndarray, n: np.ndarray, m: np.ndarray, words: int) -> np.ndarray:
    return _alike(n, m) & (bits <= np.where(np.minimum(n, m) < 5, radius(words, True), radius(words, False)))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of (key, nr) those whose key another text has, once each, with the shard's least if it is of a like size. Fingerprints pass."""
    held_back, hub = np.zeros((0, 3), np.int64), None
    for b in chain(batches, [None]):
        if b is not None:
            some = pc.is_valid(b.column(3))
            f = b.filter(some)
            yield pa.RecordBatch.from_arrays([f.column(0), f.column(1), pa.nulls(len(f), pa.int64()), pa.nulls(len(f), pa.int64()), f.column(3)], ["nr", "n", "key", "hub", "f"])
            b = b.filter(pc.invert(some))
        rows = held_back if b is None else np.concatenate((held_back, np.column_stack([b.column(k).to_numpy() for k in range(3)])))
        if not len(rows):
            continue
        cut = len(rows) if b is None else len(rows) - 1  # the last may have a like behind it
        part, after = rows[:cut], rows[cut : cut + 1]
        held_back = rows[cut:]
        if not len(part):
            continue
        nr, key = part[:, 0], part[:, 2]
        opens = np.concatenate(([hub is None or key[0] != hub[1]], key[1:] != key[:-1]))
        again = np.concatenate(([not opens[0] and nr[0] == hub[2]], (nr[1:] == nr[:-1]) & ~opens[1:]))
        goes_on = np.concatenate((~opens[1:], [bool(len(after)) and after[0, 2] == key[-1]]))
        lead = np.maximum.accumulate(np.where(opens, np.arange(len(part)), -1))
        base = np.concatenate((part, [hub[0] if hub else part[0]]))[lead]  # a lead of -1: the shard began before
        meets = _alike(part[:, 1], base[:, 1]) & (nr != base[:, 0])
        hub = (base[-1], key[-1], nr[-1])
        keep = ~again & (~opens | goes_on)
        yield pa.RecordBatch.from_arrays([*(pa.array(part[keep, k]) for k in range(3)), pa.array(base[keep, 0], mask=~meets[keep]), pa.nulls(int(keep.sum()), pa.binary())], ["nr", "n", "key", "hub", "f"])


def _words(column: pa.Array, words: int = WORDS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a, b, shared, and both fingerprints and sizes, the pairs within the radius."""
    for b in batches:
        if b.num_rows:
            ok = _within(distance(_words(b.column(3)), _words(b.column(4))), b.column(5).to_numpy(), b.column(6).to_numpy(), WORDS)
            yield b.filter(pa.array(ok)).select([0, 1, 2])


def _nearest(a: np.ndarray, b: np.ndarray, d: np.ndarray, best: int) -> tuple[np.ndarray, ...]:
    """Of pairs (a, b) at distance d the `best` nearest of each a."""
    order = np.lexsort((b, d, a))
    a, b, d = a[order], b[order], d[order]
    lead = np.maximum.accumulate(np.where(np.concatenate(([True], a[1:] != a[:-1])), np.arange(len(a)), 0)) if len(a) else a
    keep = np.arange(len(a)) - lead < best
    return a[keep], b[keep], d[keep]


def _pairs(best: int | None, words: int = WORDS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From whole shards, in the order of the key: pairs of different groups within the radius, all or the nearest of each text."""

        def search(rows: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
            nr, n, key, root = rows.T
            # in each shard the members of its largest group are found, but do not ask
            group = np.lexsort((root, key))
            k, r = key[group], root[group]
            opens = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (r[1:] != r[:-1]))))
            size = np.diff(np.append(opens, len(k)))
            by = np.lexsort((r[opens], size, k[opens]))
            last = by[np.concatenate((k[opens][by][1:] != k[opens][by][:-1], [True]))]
            largest = np.zeros(len(rows), bool)
            for a, m in zip(opens[last].tolist(), size[last].tolist()):
                largest[group[a : a + m]] = True

            def made(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
                x, y = nr[a], nr[b]
                return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

            held_back: list[tuple[np.ndarray, ...]] = []
            for a, b in BkForest(key, value).links(radius(words, True), (1 << 17) // words, np.flatnonzero(~largest)):
                ok = root[a] != root[b]
                a, b = a[ok], b[ok]
                d = distance(value[a], value[b])
                ok = _within(d, n[a], n[b], words)
                if best is None:
                    yield made(a[ok], b[ok])
                    continue
                held_back.append((a[ok], b[ok], d[ok]))
                if sum(len(x) for x, _, _ in held_back) > 1 << 20:
                    held_back = [_nearest(*(np.concatenate(x) for x in zip(*held_back)), best)]
            if held_back:
                yield made(*_nearest(*(np.concatenate(x) for x in zip(*held_back)), best)[:2])

        rows, value = np.zeros((0, 4), np.int64), np.zeros((0, words), np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.concatenate((rows, np.column_stack([b.column(k).to_numpy() for k in range(4)])))
            value = np.concatenate((value, _words(b.column(4), words)))
            if cut := int(np.searchsorted(rows[:, 2], rows[-1, 2])):
                yield from search(rows[:cut], value[:cut])
                rows, value = rows[cut:], value[cut:]
        if len(rows):
            yield from search(rows, value)

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = _sets(b.column(2)), _sets(b.column(3))
        ok = [9 * (len(p) + len(q) - len(np.union1d(p, q))) >= 4 * (len(p) + len(q)) for p, q in zip(x, y)]
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of which the whole sets have a similarity of 0.8 or more."""
    asked = pairs.select(F.col("a").alias("asked")).union(pairs.select("b")).distinct()
    some = held(texts, "nr", marked(asked, "asked")).select("nr", "text").dropDuplicates(["nr"])
    x = some.select(F.col("nr").alias("xn"), F.col("text").alias("xt"))
    y = some.select(F.col("nr").alias("yn"), F.col("text").alias("yt"))
    both = pairs.join(x, F.col("a") == F.col("xn")).join(y, F.col("b") == F.col("yn")).select("a", "b", "xt", "yt")
    return settle(both.mapInArrow(_verify, "a long, b long"), "shingle-links")


def groups(docs: DataFrame) -> DataFrame:
    """nr (hash of a text), root (one nr of its group) for texts that have near copies. docs: nr, text."""
    texts = docs.select("nr", "text")
    count = np.zeros(BUCKETS, np.int64)
    for k, n in texts.select("text").mapInArrow(_counts, "bucket long, many long").groupBy("bucket").agg(F.sum("many")).collect():  # BUCKETS at most
        count[k] = n
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = texts.mapInArrow(_keys(count), "nr long, n long, key long, f binary").repartition(parts, "key").sortWithinPartitions("key", "nr")
    keys = settle(keys.mapInArrow(_shared, "nr long, n long, key long, hub long, f binary"), "shingle-keys")
    prints = keys.where("f IS NOT NULL").select(F.col("nr").alias("pn"), "f", "n").dropDuplicates(["pn"])
    stars = keys.where("hub IS NOT NULL").groupBy(F.col("hub").alias("a"), F.col("nr").alias("b")).agg(F.count("*").alias("shared"))
    x, y = prints.select(F.col("pn").alias("xn"), F.col("f").alias("xf"), F.col("n").alias("xm")), prints.select(F.col("pn").alias("yn"), F.col("f").alias("yf"), F.col("n").alias("ym"))
    both = stars.join(x, F.col("a") == F.col("xn")).join(y, F.col("b") == F.col("yn")).select("a", "b", "shared", "xf", "yf", "xm", "ym")
    stars = settle(both.mapInArrow(_near, "a long, b long, shared long"), "shingle-stars")
    most = stars.groupBy("b").agg(F.max(F.struct("shared", -F.col("a"))).alias("m")).select((-F.col("m.col2")).alias("a"), "b")
    first = verified(texts, settle(most, "shingle-firsts"))
    above = components(first)
    up = lambda c, name: above.select(F.col("node").alias(f"{name}_node"), F.col("root").alias(name))
    rest = stars.join(up("a", "ra"), F.col("a") == F.col("ra_node"), "left").join(up("b", "rb"), F.col("b") == F.col("rb_node"), "left")
    rest = rest.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    links = first.union(verified(texts, settle(rest, "shingle-rest")))
    for best in (2, 16, None):  # what is joined by its nearest texts need not meet all the others; two texts have met
        roots = components(links).withColumnRenamed("root", "above")
        named = settle(keys.where("f IS NULL").join(roots, F.col("nr") == F.col("node"), "left").select("nr", "n", "key", F.coalesce("above", "nr").alias("root")), "shingle-roots")
        mixed = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("many")).where("lo <> hi AND many > 2").select(F.col("key").alias("key2"), "many")
        shards = settle(named.join(mixed, F.col("key") == F.col("key2")).drop("key2"), "shingle-shards")
        dealt = lambda x: x.repartition(parts, "key").sortWithinPartitions("key")
        small = shards if best else shards.where(f"many <= {LARGE}")
        small = small.join(prints.select("pn", "f"), F.col("nr") == F.col("pn")).select("nr", "n", "key", "root", "f")
        pairs = dealt(small).mapInArrow(_pairs(best), "a long, b long")
        if not best:
            large = shards.where(f"many > {LARGE}")
            wide = held(texts, "nr", marked(large, "nr")).select("nr", "text").mapInArrow(_wide, "wn long, w binary").dropDuplicates(["wn"])
            large = large.join(wide, F.col("nr") == F.col("wn")).select("nr", "n", "key", "root", "w")
            pairs = pairs.union(dealt(large).mapInArrow(_pairs(None, WIDE), "a long, b long"))
        pairs = settle(pairs.distinct(), "shingle-pairs")
        links = links.union(verified(texts, pairs))
        forget(named, shards, pairs)
    out = settle(components(links).select(F.col("node").alias("nr"), "root"), "shingle-groups")
    forget(keys, stars)
    return out
