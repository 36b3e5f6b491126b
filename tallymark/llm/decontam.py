"""Benchmark decontamination by latent semantic retrieval.

Passages are 32-word windows (two blocks of 16 words, a step of one block) of the
documents. The terms are the words of the benchmark items, so the term space
grows with the benchmark and not with the corpus. One pass writes every text as
term numbers; on these follow

1. how many blocks of the whole corpus hold each term, for the squared inverse
   document frequency (smoothed; every term weighs something);
2. a distributed randomised SVD of the TF-IDF passages: tasks add up their part
   of (A' A) Omega for a Gaussian Omega, and the terms-by-rank sum gives the
   right singular vectors by a Nystroem step on the driver;
3. cosine candidate search: every passage of the corpus is projected, and its latent
   vector is compared with every item's; passages within ``cosine`` of an item are
   its candidates;
4. the windows of 1.25 times an item's length around its candidates are compared by
   the longest common subsequence of words, which must reach ``lcs`` of the item (first
   by counts of the item's rarest words, ``_prefix``: of these so many must stand in a
   window as ``lcs`` leaves no way around). An item's answer (column ``answer``,
   if there is one and it is not null) must also stand in the window, word for word;
5. a cosine has no sure bound, as words that often leaked weigh little. So an exact way
   takes the rest: windows far from every candidate whose rare words suffice are
   compared too. ``strict`` leaves this step out: its rows are those of the retrieval.

The column ``cosine`` has the largest of the passages that meet the window found.

Items go in blocks of ``item_block``, so that what tasks are sent is bounded.
Null and empty texts hold nothing. Items without words match nothing. Repeated
rows give repeated results. Ties do not matter: every pair above the limits is
returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, slices, strings
from .linalg import left_singular, times
from .words import LETTERS, split_words, xxh64

BLOCK = 16


def hashed(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes, and each text's first word, for slices of the column."""
    data, offsets = strings(column)
    for a, b in slices(offsets, 1 << 20):
        buf, start, length, first = split_words(data, offsets[a : b + 1], LETTERS)
        yield xxh64(buf, start, length), first


def _numbered(vocab: np.ndarray):
    """Texts as term numbers (0: none of the terms), four bytes each or two."""
    kind = np.uint16 if len(vocab) < 65535 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, first in hashed(b.column(1)):
                at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
                n = np.where(vocab[at] == h, at + 1, 0).astype(kind).tobytes()
                w = kind().itemsize
                out += [n[w * x : w * y] for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "terms"])

    return run, kind


def _stacked(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All terms of a batch, each text's first word and each word's block (no block spans two texts)."""
    texts = column.to_pylist()
    terms = np.frombuffer(b"".join(texts), kind).astype(np.int64)
    size = np.array([len(t) // kind().itemsize for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(size)))
    blocks = -(-size // BLOCK) + 2  # two empty ones behind each text: neither passages nor runs of them span texts
    base = np.cumsum(blocks) - blocks
    word = np.arange(len(terms)) - np.repeat(first[:-1], size)
    return terms, first, np.repeat(base, size) + word // BLOCK


def _parts(batches: Iterator[pa.RecordBatch], kind, most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        sizes = np.concatenate(([0], np.cumsum([len(x.as_buffer()) for x in b.column(1)]))) if b.num_rows else np.zeros(1, np.int64)
        for a, z in slices(sizes, most):
            part = b.slice(a, z - a)
            yield part, *_stacked(part.column(1), kind)


def _frequencies(size: int, kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size + 1, np.int64)  # at 0 the number of blocks
        for _, terms, _, block in _parts(batches, kind):
            if len(terms):
                df[0] += len(np.unique(block))
                own = np.unique(block * (size + 1) + terms) % (size + 1)
                df += np.bincount(own[own > 0], minlength=size + 1)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    return run


def _block_sums(terms: np.ndarray, block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The sum of the basis rows of each block's words, from block 0 to one behind the last."""
    many = np.bincount(block, minlength=int(block[-1]) + 2)
    place = np.arange(len(terms)) - np.repeat(np.cumsum(many) - many, many)
    words = np.zeros((len(many), BLOCK), np.int64)  # number 0 has a row of zeros
    words[block, place] = terms
    sums = np.empty((len(words), basis.shape[1]), basis.dtype)
    for k in range(0, len(words), 8192):  # a very long text in bounded pieces
        sums[k : k + 8192] = np.take(basis, words[k : k + 8192], axis=0).sum(1)
    return sums


def _projected(terms: np.ndarray, block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Latent vectors of all passages, of length 1 (0 if nothing weighs): row j is that of blocks j - 1 and j."""
    y = _block_sums(terms, block, basis)
    y[1:] += y[:-1].copy()
    return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-30)


def _candidates(y: np.ndarray, latent: np.ndarray, cosine: float, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, from, to): runs of passages whose cosine with the item is not under the limit, by item and passage."""
    least = np.where(y.any(1), cosine, np.inf).astype(np.float32)
    wide, step, out = len(y) + 1, max(1, cells // len(y)), []
    for k in range(0, len(latent), step):
        near = np.zeros((min(step, len(latent) - k), wide), bool)  # the last column parts the items
        np.greater_equal(latent[k : k + step] @ y.T, least, out=near[:, :-1])
        edge = np.flatnonzero(np.diff(near.ravel(), prepend=False))
        out.append((edge[::2] // wide + k, edge[::2] % wide, edge[1::2] % wide))
    return tuple(np.concatenate(x) for x in zip(*out))


def _add_by_term(total: np.ndarray, terms: np.ndarray, rows: np.ndarray, of: np.ndarray) -> None:
    """total[terms[i]] += rows[of[i]]: terms that stand equally often are summed as one array (far cheaper than reduceat)."""
    order = np.argsort(terms, kind="stable")  # a radix sort for two bytes
    terms, of = terms[order], of[order]
    lead = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1])))
    many = np.diff(np.append(lead, len(terms)))
    for n in np.flatnonzero(np.bincount(many)).tolist():
        own = lead[many == n]
        for k in range(0, n, 256):  # a very frequent word in bounded pieces
            at = own[:, None] + np.arange(k, min(n, k + 256))
            total[terms[own]] += np.take(rows, of[at], axis=0).sum(1)


def _sketch(weight: np.ndarray, omega: np.ndarray, kind):
    basis = (omega * weight[:, None]).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(omega.shape, np.float32)
        for _, terms, _, block in _parts(batches, kind, 1 << 17):  # small, so that rows of a part stay near the processor
            live = np.flatnonzero(terms)
            if not len(live):
                continue
            # a passage is a block and the one behind it; each word adds the sketches of its (one or two) passages to its term
            sums = _block_sums(terms, block, basis)
            passages = sums[:-1] + sums[1:]
            both = passages.copy()
            both[1:] += passages[:-1]
            _add_by_term(total, terms[live].astype(kind), both, block[live])
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([x.tobytes() for x in total[some]], pa.binary())], ["term", "row"])

    return run


def _sum_rows(rank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for t, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[t] = sums.get(t, 0) + np.frombuffer(r, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["term", "row"])

    return run


def nystroem(y: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of the C for which y = C omega."""
    shift = 1e-6 * max(np.sqrt((y * y).sum()), 1e-30)
    y = y + shift * omega
    m = times(omega.T, y)
    vectors, values = left_singular((m + m.T) / 2)  # no negative eigenvalues: C has none
    keep = values > 1e-10 * values.max(initial=0)
    u, _ = left_singular(times(y, vectors[:, keep] / np.sqrt(values[keep])))
    return u[:, :rank]


def masks(words: list[int]) -> dict[int, int]:
    """Where each word stands, as bits (0 matches nothing)."""
    out: dict[int, int] = {}
    for i, x in enumerate(words):
        if x:
            out[x] = out.get(x, 0) | 1 << i
    return out


def common_words(a: list[int], b: list[int], at: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    at = masks(a) if at is None else at
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if x in at:
            u = v & at[x]
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _prefix(words: list[int], reach: int, wide: int, share: np.ndarray) -> tuple[list[int], int]:
    """Some of the item's rarest words, and how many of them every window holds that shares `reach` words with the item.

    A window misses len(words) - reach words at most. Any cut gives right results;
    the one is taken that makes the least work on texts without the item: the words
    to look at, and the windows that reach the number by chance.
    """
    order = sorted(words, key=lambda w: (share[w], w))
    best, expected = (order, reach, np.inf), 0.0
    for k, w in enumerate(order):
        if k == 0 or w != order[k - 1]:
            expected += wide * share[w] / BLOCK
        need = k + 1 - (len(words) - reach)
        if need > 0 and (k + 1 == len(order) or order[k + 1] != w):
            chance = need * np.log(max(expected, 1e-12) / need) + need - expected if need > expected else 0.0
            if (work := expected + 20 * wide * np.exp(chance)) < best[2]:
                best = (order[: k + 1], need, work)
    return best[0], best[1]


class Items:
    """A block of items as sorted arrays: the size is that of their words, not items times terms."""

    def __init__(self, items: list[tuple[int, list[int], list[int]]], share: np.ndarray, least: float) -> None:
        self.items, self.terms = items, len(share)
        size = [len(words) for _, words, _ in items]
        self.size = np.array(size, np.int64)
        self.wide = np.array([int(1.25 * m) + 2 for m in size], np.int64)
        self.reach = np.array([next(c for c in range(m + 1) if c / m >= least) for m in size], np.int64)
        cuts = [_prefix(words, int(r), int(w), share) for (_, words, _), r, w in zip(items, self.reach, self.wide)]
        self.need = np.array([n for _, n in cuts], np.int64)
        pairs = np.array(sorted((t, i) for i, (some, _) in enumerate(cuts) for t in set(some)), np.int64).reshape(-1, 2)
        self.post = pairs[:, 1]
        self.begin = np.searchsorted(pairs[:, 0], np.arange(self.terms + 1))
        self.member = np.array(sorted({i * self.terms + w for i, (_, words, _) in enumerate(items) for w in words}), np.int64)
        self.masks: dict[int, dict[int, int]] = {}

    def holds(self, item: np.ndarray | int, terms: np.ndarray) -> np.ndarray:
        key = item * self.terms + terms
        return self.member[np.minimum(np.searchsorted(self.member, key), len(self.member) - 1)] == key

    def hits(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, word): where the items' rarest words stand, by item and word."""
        many = np.diff(self.begin)
        at = np.flatnonzero(many[terms])
        n = many[terms[at]]
        item = self.post[np.repeat(self.begin[terms[at]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        at = np.repeat(at, n)
        order = np.argsort(item, kind="stable")
        return item[order], at[order]

    def around(self, item: np.ndarray, at: np.ndarray, near: tuple[np.ndarray, np.ndarray, np.ndarray], first: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Which hits stand in a window (of their text) that meets a candidate of their item."""
        own, a, z = near
        if not len(own) or not len(item):
            return np.zeros(len(item), bool)
        start = np.searchsorted(block, np.arange(int(block[-1]) + 3))  # of each block the first word
        a, z = start[np.maximum(a - 1, 0)], start[z]
        text = np.searchsorted(first, a, "right") - 1
        a, z = np.maximum(a - self.wide[own] + 1, first[text]), np.minimum(z + self.wide[own] - 1, first[text + 1])
        n = len(block) + 1
        k = np.searchsorted(own * n + a, item * n + at, "right") - 1  # of one item the ranges come in the order of their starts and ends
        return (k >= 0) & (own[k] == item) & (at < z[k])

    def spans(self, item: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, from, to) of words: disjoint spans, by item, that hold every window in which hits suffice for the item."""
        last = np.arange(len(at)) + self.need[item] - 1
        ok = np.flatnonzero(last < len(at))
        ok = ok[(item[last[ok]] == item[ok]) & (at[last[ok]] - at[ok] < self.wide[item[ok]])]
        text = np.searchsorted(first, at[ok], "right") - 1
        same = at[last[ok]] < first[text + 1]
        ok, text = ok[same], text[same]
        item, wide = item[ok], self.wide[item[ok]]
        a, z = np.maximum(at[last[ok]] - wide + 1, first[text]), np.minimum(at[ok] + wide, first[text + 1])
        if not len(ok):
            return item, a, z
        # of one item the spans come in the order of their starts and ends
        fresh = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (a[1:] >= z[:-1]))))
        return item[fresh], a[fresh], z[np.append(fresh[1:], len(z)) - 1]

    def best(self, text: np.ndarray, i: int) -> tuple[int, int] | None:
        """(first word, common words) of the best window of a text for item i, if one reaches it."""
        _, words, answer = self.items[i]
        wide, reach = int(self.wide[i]), int(self.reach[i])
        if len(text) < reach:
            return None
        run = np.concatenate(([0], np.cumsum(self.holds(i, text) & (text > 0))))
        start = np.arange(0, max(1, len(text) - wide + 1))
        held = run[np.minimum(start + wide, len(text))] - run[start]
        found = None
        if (held >= reach).any():
            at = self.masks.setdefault(i, masks(words))
            for s in start[held >= reach].tolist():
                if found and held[s] <= found[1]:
                    continue
                w = text[s : s + wide].tolist()
                n = common_words(words, w, at)
                if n >= reach and (found is None or n > found[1]) and (not answer or any(w[k : k + len(answer)] == answer for k in range(len(w)))):
                    found = (s, n)
        return found


def _beyond(spans: tuple[np.ndarray, np.ndarray, np.ndarray], done: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans that do not lie in one of those done (of texts with n words in all)."""
    (item, a, z), (own, b, y) = spans, done
    k = np.searchsorted(own * (n + 1) + b, item * (n + 1) + a, "right") - 1
    rest = np.ones(len(item), bool)
    if len(own):
        rest = (k < 0) | (own[k] != item) | (y[k] < z)
    return item[rest], a[rest], z[rest]


def _matches(items: Items, basis: np.ndarray, latent: np.ndarray, cosine: float, strict: bool, kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, terms, first, block in _parts(batches, kind, 1 << 17):
            best = {}
            if len(terms):
                y = _projected(terms, block, basis)
                near = _candidates(y, latent, cosine)
                item, at = items.hits(terms)
                kept = items.around(item, at, near, first, block)
                found = items.spans(item[kept], at[kept], first)
                rest = [] if strict else [_beyond(items.spans(item, at, first), found, len(terms))]
                for i, a, z in (x for some in [found, *rest] for x in zip(*(c.tolist() for c in some))):
                    got = items.best(terms[a:z], i)
                    if not got:
                        continue
                    d, s = int(np.searchsorted(first, a, "right")) - 1, a + got[0]
                    word = s - int(first[d])
                    if (d, i) in best and (best[d, i][2], -best[d, i][1]) >= (got[1], -word):
                        continue
                    end = min(s + int(items.wide[i]), int(first[d + 1])) - 1
                    cos = float((y[block[s] : block[end] + 2] @ latent[i]).max())
                    best[d, i] = (min(cos, 1.0), word, got[1])
            ids = part.column(0).to_pylist()
            rows = [(ids[d], items.items[i][0], cos, n / len(items.items[i][1]), word) for (d, i), (cos, word, n) in best.items()]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()))], ["doc_id", "item_id", "cosine", "lcs", "word"])

    return run


def _block(docs: DataFrame, got: pa.Table, cosine: float, lcs: float, rank: int, strict: bool) -> DataFrame:
    answers = got["answer"] if "answer" in got.column_names else pa.nulls(len(got), pa.string())
    both = [[h[a:b] for h, first in hashed(c) for a, b in zip(first[:-1], first[1:])] for c in (got["text"], answers)]
    vocab = np.unique(np.concatenate([*both[0], *both[1], np.zeros(0, np.uint64)]))
    name = "doc_id long, item_id long, cosine double, lcs double, word long"
    spark = docs.sparkSession
    if not len(vocab):
        return spark.createDataFrame([], name)
    number = lambda h: (np.searchsorted(vocab, h) + 1).tolist()
    items = [(i, number(a), number(b)) for i, a, b in zip(got["item_id"].to_pylist(), *both) if len(a)]
    items.sort(key=lambda x: len(x[1]))
    run, kind = _numbered(vocab)
    terms = settle(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, terms binary"), "terms")
    size = len(vocab)
    df = np.zeros(size + 1)
    for t, n in terms.mapInArrow(_frequencies(size, kind), "term long, df long").groupBy("term").agg(F.sum("df")).collect():  # terms of the block
        df[t] = n
    weight = (np.log((df[0] + 1000) / (df + 1)) ** 2).astype(np.float32)
    share = df / max(df[0], 1)
    weight[0] = 0
    width = rank + 8
    omega = np.random.default_rng(3).normal(size=(size + 1, width)).astype(np.float32)
    parts = terms.mapInArrow(_sketch(weight, omega, kind), "term long, row binary")
    sketch = np.zeros((size + 1, width))
    for t, r in parts.repartition("term").mapInArrow(_sum_rows(width), "term long, row binary").collect():  # terms x rank
        sketch[t] = np.frombuffer(r, np.float64)
    # the items' own rows, word by word: sums over words instead of a matrix of items by terms
    flat, many = np.array([w for _, words, _ in items for w in words], np.int64), np.array([len(words) for _, words, _ in items])
    if not len(flat):
        return spark.createDataFrame([], name)
    lead = np.cumsum(many) - many
    rows = lambda m: np.add.reduceat(weight[flat, None] * m[flat], lead, axis=0)
    sketch = weight[:, None] * sketch
    np.add.at(sketch, flat, weight[flat, None] * np.repeat(rows(omega.astype(float)), many, axis=0))
    basis = nystroem(sketch, omega.astype(float), rank)
    latent = rows(basis)
    latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-30)).astype(np.float32)
    find = _matches(Items(items, share, lcs), (weight[:, None] * basis).astype(np.float32), latent, cosine, strict, kind)
    return terms.mapInArrow(find, name)


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.3, lcs: float = 0.6, rank: int = 64, item_block: int = 20_000, strict: bool = False) -> DataFrame:
    """doc_id, item_id, cosine, lcs (share of the item's words), word (where): a row for each contaminated document and item."""
    cols = [F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), *[F.col("answer").cast("string").alias("answer") for c in benchmark.columns if c == "answer"]]
    items, out = benchmark.select(*cols), None
    blocks = max(1, -(-items.count() // item_block))
    for k in range(blocks):
        got = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        found = _block(docs, got, cosine, lcs, rank, strict)
        out = found if out is None else out.unionAll(found)
    return out
