"""Cross-tokenizer alignment: minimal groups of tokens of two vocabularies that cover the same bytes.

Tokens of A and B whose byte ranges overlap are the edges of a bipartite graph. Its
connected components, by union-find over arrays (hook the larger root under the smaller,
then compress every path), are the minimal groups: a component ends where tokens of both
sides end. The members of a component that end together are its links. Links are counted
by id pair over the whole corpus, and each document gets its links' counts back.

No token of either side reaches over a single space between visible characters, a line
break next to one, or a change between letters and punctuation that no piece of B
holds, so a text falls into chunks there; a worker aligns each distinct chunk of 4 MB of
text once and keeps a bounded table. tests/llm holds ids and groups against the libraries
on whole texts.

Counting is by shuffle on the pair, combined first. For the way back, pairs with at
least 1 of ``HOT`` links are broadcast (there are ``HOT`` of them at most, whatever the
input); all others, none of which is common, meet their links by a shuffle join.

A text that is null, empty, or whose tokens do not spell it byte for byte has no tokens.
Repeated rows and null doc_ids are documents of their own. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, numbered, settle, slices, strings
from .tokens import BYTE_CHARS, SLICE

HOT = 100_000
#: Ids of B in a pair's number a * SIDE + b.
SIDE = 1 << 24

VISIBLE, LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
VISIBLE[33:127] = True
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = True  # an apostrophe may begin a token of letters
#: Chunks that are one match of A's split pattern, whose model can be asked without the pattern.
SINGLE = re.compile(r" ?(?:[A-Za-z]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")
#: Longer chunks are not kept.
KEPT = 64
LATIN = 0xC3  # the first byte of the letters from U+00C0 to U+00FF, none of which is a space


def unite(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of the nodes 0..n-1 reaches over the edges a[i] - b[i]."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        live = root[a] != root[b]
        a, b = a[live], b[live]
    return root


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The values of two ascending arrays, once each, ascending."""
    there = np.zeros(max(a[-1:].max(initial=-1), b[-1:].max(initial=-1)) + 1, bool)
    there[a] = there[b] = True
    return np.flatnonzero(there)


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The component of each token of A and of B, named by its first token of A.

    Both sides cover the bytes 0..end without gaps or empty tokens; ends ascend."""
    ends = union(a_ends, b_ends)
    a, b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)  # the tokens over the bytes before each end overlap
    root = unite(len(a_ends) + len(b_ends), a, b + len(a_ends))
    return root[: len(a_ends)], root[len(a_ends) :]


def links(a_ends: np.ndarray, b_ends: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token of A, token of B) of the members of each component whose ranges end together."""
    b = np.minimum(np.searchsorted(b_ends, a_ends), len(b_ends) - 1)
    a = np.flatnonzero((b_ends[b] == a_ends) & (b_group[b] == a_group)) if len(b_ends) else np.zeros(0, np.int64)
    return a, b[a]


def chunk_cuts(data: np.ndarray, texts: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Starts of chunks in the texts data[texts[i]:texts[i + 1]], and the end. joined[x, y]: a piece of B holds the byte y behind x."""
    if len(data) < 3:
        return np.unique(texts)
    x, y, z = data[:-2], data[1:-1], data[2:]  # cuts before y, with one byte more on either side
    seen, cut = VISIBLE[x], np.zeros(len(data) + 1, bool)
    left = seen.copy()
    left[1:] |= (x[1:] >= 0x80) & (x[:-1] == LATIN)
    own = (y == 32) & left & (VISIBLE[z] | (z == LATIN))
    own |= (y == 10) & seen
    own |= ((LETTER[x] & MARK[y]) | (MARK[x] & LETTER[y])) & ~joined[x, y]
    cut[1 : len(data) - 1] = own
    cut[2 : len(data)] |= (y == 10) & seen & VISIBLE[z]  # behind a line break between visible characters
    cut[texts] = True
    return np.flatnonzero(cut)


class Aligner:
    """Ids, groups and links of chunks.

    B puts a space before what it encodes, so chunks go to it behind a line break, which is in no piece of its own."""

    def __init__(self, a_path: str, b_path: str, most: int = 1 << 19) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has its core, not the machine
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings in a text are text
        value = {c: b for b, c in enumerate(BYTE_CHARS)}
        own = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.a_bytes = self._table([bytes(value[c] for c in t) if t and all(c in value for c in t) else b"" for t in own])
        pieces = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = self._table(pieces)
        self.joined = np.zeros((256, 256), bool)
        for p in pieces:
            for x, y in itertools.pairwise(p):
                self.joined[x, y] = True
        if self.joined[10].any() or self.joined[:, 10].any() or len(self.b.encode("\n")) != 2:
            raise ValueError("a piece of B holds a line break")
        self.digits = self._decimals(max(len(own), self.b.get_piece_size()))
        self.most = most
        self.clear()

    def _piece(self, i: int) -> bytes:
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    @staticmethod
    def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        long = np.array([len(t) for t in tokens])
        return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(long) - long, long

    @staticmethod
    def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
        """The decimal digits of 0..n-1, right-aligned, and which of them are written."""
        width = len(str(n))
        place = np.arange(n)[:, None] // 10 ** np.arange(width - 1, -1, -1)
        shown = place > 0
        shown[:, -1] = True
        return (place % 10 + 48).astype(np.uint8), shown

    def clear(self) -> None:
        self.index = {}
        #: Of each chunk: whether both sides spell it, tokens of A, of B, groups, links.
        self.facts = np.zeros((0, 5), np.int64)
        self.said: list[bytes] = []
        self.pairs, self.begin = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A one after the other, how many each chunk has, and the same of B."""
        a, many, tokenize, single = [], [], self.a.model.tokenize, SINGLE.fullmatch
        for c in chunks:
            if single(c):
                a += [t.id for t in tokenize(c if c[0] != " " else f"{BYTE_CHARS[32]}{c[1:]}")]
            else:
                a += self.a.encode(c, add_special_tokens=False).ids
            many.append(len(a))
        b = self.b.encode([f"\n{c}" for c in chunks], num_threads=1)
        nb = np.fromiter(map(len, b), np.int64, len(b)) - 2
        flat = np.fromiter(itertools.chain.from_iterable(b), np.int64, int(nb.sum()) + 2 * len(b))
        keep = np.ones(len(flat), bool)
        first = np.cumsum(nb + 2) - nb - 2
        keep[first] = keep[first + 1] = False
        return np.array(a, np.int64), np.diff(np.array([0, *many])), flat[keep], nb

    @staticmethod
    def _spelled(table, ids: np.ndarray, many: np.ndarray, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each chunk, whether the bytes of its tokens are its own."""
        pool, start, long = table
        n = long[ids]
        total = np.diff(np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(many)))])
        ok = total == np.diff(ends)
        keep = np.repeat(ok, many)
        ids, n = ids[keep], n[keep]
        got = pool[np.repeat(start[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        there = np.repeat(ok, np.diff(ends))
        wrong = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(there, out=wrong[1:])
        differ = np.concatenate(([0], np.cumsum(got != raw[there])))
        ok[ok] = (np.diff(differ[wrong[ends]]) == 0)[ok]
        return ok

    def align(self, chunks: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """facts, groups as text, pairs one after the other, and links of each chunk."""
        a, na, b, nb = self._encoded(chunks)
        texts = [c.encode() for c in chunks]
        raw, ends = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        ok = self._spelled(self.a_bytes, a, na, raw, ends) & self._spelled(self.b_bytes, b, nb, raw, ends)
        a, b = a[np.repeat(ok, na)], b[np.repeat(ok, nb)]
        na, nb = na * ok, nb * ok
        a_ends, b_ends = np.cumsum(self.a_bytes[2][a]), np.cumsum(self.b_bytes[2][b])
        a_group, b_group = groups(a_ends, b_ends)
        at, bt = links(a_ends, b_ends, a_group, b_group)
        chunk = np.repeat(np.arange(len(chunks)), na)
        count = lambda of: np.bincount(of, minlength=len(chunks))
        facts = np.stack([ok, na, nb, count(chunk[a_group == np.arange(len(a))]), count(chunk[at])], 1).astype(np.int64)
        # members of a component one after the other, A's before B's, each with the mark that follows it
        order = np.argsort(np.concatenate((a_group, b_group)), kind="stable")
        ids, side = np.concatenate((a, b))[order], order >= len(a)
        group, of = np.concatenate((a_group, b_group))[order], np.concatenate((chunk, np.repeat(np.arange(len(chunks)), nb)))[order]
        same = lambda x: x[1:] == x[:-1]
        mark = np.full(len(ids), 59, np.uint8)  # ;
        mark[:-1] = np.where(same(group), np.where(same(side), 44, 124), 59)  # , and |
        digit, shown = self.digits
        last = np.ones(len(ids), bool)
        last[:-1] = ~same(of)
        shape = np.concatenate((shown[ids], ~last[:, None]), 1)
        text = np.concatenate((digit[ids], mark[:, None]), 1)[shape].tobytes()
        stop = np.concatenate(([0], np.cumsum(shape.sum(1))))[np.concatenate(([0], np.cumsum(na + nb)))].tolist()
        return facts, [text[x:y] for x, y in zip(stop[:-1], stop[1:])], a[at] * SIDE + b[bt], facts[:, 4]

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The number of each (distinct) chunk in the table, which learns those that it lacks.

        What it can't keep (long chunks, and all new ones when it is full) stays until the next call."""
        n = len(self.index)
        self.facts, self.said, self.begin = self.facts[:n], self.said[:n], self.begin[: n + 1]
        self.pairs = self.pairs[: self.begin[-1]]
        k = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        miss = np.flatnonzero(k < 0)
        if n >= self.most and 2 * len(miss) > len(chunks):  # other texts than those that it knows
            self.clear()
            n, miss = 0, np.arange(len(chunks))
        if len(miss):
            miss = np.array(sorted(miss.tolist(), key=lambda i: len(chunks[i]) > KEPT))
            own = [chunks[i] for i in miss.tolist()]
            facts, said, pairs, many = self.align(own)
            k[miss] = n + np.arange(len(miss))
            self.facts, self.said = np.concatenate((self.facts, facts)), self.said + said
            self.pairs, self.begin = np.concatenate((self.pairs, pairs)), np.concatenate((self.begin, self.begin[-1] + np.cumsum(many)))
            if n < self.most:
                self.index.update(zip(itertools.takewhile(lambda c: len(c) <= KEPT, own), range(n, n + len(own))))
        return k

    def texts(self, column: pa.Array) -> pa.RecordBatch:
        """A row for each text: n_a, n_b, n_groups, n_links, groups_sha256, pairs (distinct), many (links of each)."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        empty = pc.equal(column, "")
        data, texts = strings(pc.if_else(empty, column, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string()))))
        data, texts = data[texts[0] : texts[-1]], texts - texts[0]
        cuts = chunk_cuts(data, texts, self.joined)
        chunks, which = numbered(data, cuts)
        k = self.numbers(chunks)[which] if chunks else np.zeros(0, np.int64)
        first = np.searchsorted(cuts, texts)
        sums = np.concatenate((np.zeros((1, 5), np.int64), np.cumsum(self.facts[k], 0)))[first]
        sums = np.diff(sums, axis=0)
        good = (sums[:, 0] == np.diff(first)) & (np.diff(texts) > 0)
        sums[~good] = 0
        sha, at = [], k.tolist()
        for ok, x, y in zip(good.tolist(), first[:-1].tolist(), first[1:].tolist()):
            sha.append(hashlib.sha256(b";".join([self.said[i] for i in at[x:y]])).hexdigest() if ok else "")
        doc = np.repeat(np.arange(len(good)), np.diff(first))
        k, doc = k[good[doc]], doc[good[doc]]
        n = self.begin[k + 1] - self.begin[k]
        pair = self.pairs[np.repeat(self.begin[k] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        doc = np.repeat(doc, n)
        order = np.lexsort((pair, doc))
        pair, doc = pair[order], doc[order]
        new = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])))) if len(pair) else np.zeros(0, np.int64)
        stops = pa.array(np.searchsorted(doc[new], np.arange(len(good) + 1)).astype(np.int32))
        many = np.diff(np.append(new, len(pair)))
        lists = [pa.ListArray.from_arrays(stops, pa.array(x)) for x in (pair[new], many)]
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(sums[:, j])) for j in range(1, 5)), pa.array(sha, pa.string()), *lists], ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "many"])


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each Python worker; it outlives a task."""
    return Aligner(a_path, b_path)


def _align(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for b in batches:
            for x, y in slices(strings(b.column(1))[1], SLICE):
                part = b.slice(x, y - x)
                rows = own.texts(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *rows.columns], ["doc_id", *rows.schema.names])

    return run


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and many (its distinct id pairs a * 2^24 + b and their links)."""
    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, many array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_align(a_path, b_path), kinds)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, count (links that hold it), best (no other pair with its id of B has more): a row for each pair of the corpus, written."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "many")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.many").alias("many"))
    counts = each.groupBy("pair").agg(F.sum("many").alias("count"))
    counts = settle(counts, "pair-counts")
    most = counts.groupBy((F.col("pair") % SIDE).alias("b")).agg(F.max("count").alias("most"))  # a row for each id of B
    scored = settle(counts.join(F.broadcast(most), F.col("pair") % SIDE == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")
    forget(counts)
    return scored


def align(docs: DataFrame, a_path: str, b_path: str, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row for each row of docs."""
    rows = settle(aligned(docs, a_path, b_path).withColumn("nr", F.monotonically_increasing_id()), "aligned")
    scored = pair_counts(rows)
    total = scored.agg(F.sum("count")).first()[0] or 0
    common = F.col("count") * hot >= total
    each = rows.select("nr", F.explode(F.arrays_zip("pairs", "many")).alias("x")).select("nr", F.col("x.pairs").alias("own"), F.col("x.many").alias("many"))
    first = each.join(F.broadcast(scored.where(common)), F.col("own") == F.col("pair"), "left")  # hot rows at most
    rest = first.where("pair IS NULL").select("nr", "own", "many").join(scored.where(~common).hint("shuffle_merge"), F.col("own") == F.col("pair"))
    both = first.where("pair IS NOT NULL").select("nr", "many", "count", "best").union(rest.select("nr", "many", "count", "best"))
    sums = both.groupBy("nr").agg(F.sum(F.col("many") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("many")).otherwise(0)).alias("n_best")).withColumnRenamed("nr", "of")
    whole = rows.select("nr", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, F.col("nr") == F.col("of"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
