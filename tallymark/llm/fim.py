"""Fill-in-middle: texts cut into prefix, middle and suffix, at code points that a Split pre-tokenizer counts.

The tokenizers library's Split pre-tokenizer takes every code point as an isolated match
and gives its offsets; nothing is trained. As matches never reach over a code point, a
text may be matched in chunks: runs of word bytes and runs of others, at most ``CHUNK``
bytes long. Arrow numbers the chunks of 4 MB of text, the library matches each distinct
chunk once, and a bounded table keeps the lengths of the offset arrays. Their running
sums are the text's offset array: its length is n, and a rank picks the chunk and, in
the chunk's own array, the offset at which the text is cut.

A null text is empty. A null doc_id draws from the digits of no number (``1:``). Repeated
rows give repeated results. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, slices, strings
from .tokens import SLICE

#: The sentinels of prefix, suffix and middle, and the shares (in hundredths) of texts that change and of those in suffix-first form.
PREFIX, SUFFIX, MIDDLE, CHANGED, SUFFIX_FIRST = "<P>", "<S>", "<M>", 90, 20
CHUNK = 64

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def chunk_cuts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the chunks of the texts data[texts[i]:texts[i + 1]] begin, and the end; never inside a character."""
    kind = WORD[data]
    cuts = np.union1d(np.flatnonzero(kind[1:] != kind[:-1]) + 1, texts)
    wide = np.flatnonzero(np.diff(cuts) > CHUNK)
    if not len(wide):
        return cuts
    many = (cuts[wide + 1] - cuts[wide] - 1) // CHUNK
    at = np.repeat(cuts[wide], many) + CHUNK * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + 1)
    for _ in range(3):  # on to the first byte of a character; the end of a chunk is one
        at += (at < len(data)) & (data[np.minimum(at, len(data) - 1)] & 0xC0 == 0x80)
    return np.union1d(cuts, at)


class CodePoints:
    """Offset arrays of chunks by the Split pre-tokenizer; their lengths are remembered."""

    def __init__(self, most: int = 1 << 19) -> None:
        from tokenizers import Regex, pre_tokenizers

        self.split, self.most, self.known = pre_tokenizers.Split(Regex(r"[\s\S]"), "isolated"), most, {}

    def offsets(self, chunk: str) -> list[int]:
        """The code-point offset at which each match begins, and the end of the last."""
        found = [span for _, span in self.split.pre_tokenize_str(chunk)]
        return [a for a, _ in found] + [found[-1][1] if found else 0]

    def lengths(self, chunks: list[str]) -> np.ndarray:
        """How many matches each of the (distinct) chunks has."""
        out = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = {chunks[i]: len(self.split.pre_tokenize_str(chunks[i])) for i in np.flatnonzero(out < 0).tolist()}
        out[out < 0] = list(new.values())
        if len(self.known) + len(new) > self.most:
            self.known = {}
        if len(new) <= self.most:
            self.known.update(new)
        return out

    def cut(self, data: np.ndarray, texts: np.ndarray, ranks) -> tuple[np.ndarray, list[np.ndarray]]:
        """n of each text, and for each array that ranks(n) returns the byte before which a text's first so many units end."""
        cuts = chunk_cuts(data, texts)
        chunks, which = numbered(data, cuts)
        ends = np.concatenate(([0], np.cumsum(self.lengths(chunks)[which])))
        first = ends[np.searchsorted(cuts, texts)]
        n = np.diff(first)
        places = []
        for rank in ranks(n):
            unit = first[:-1] + rank
            at = np.minimum(np.searchsorted(ends, unit, "right") - 1, len(which))
            place = cuts[at].copy()
            for i in np.flatnonzero(unit > ends[at]).tolist():  # inside a chunk: its own offset array
                chunk = chunks[which[at[i]]]
                place[i] += len(chunk[: self.offsets(chunk)[unit[i] - ends[at[i]]]].encode())
            places.append(place)
        return n, places


@lru_cache(maxsize=1)
def code_points() -> CodePoints:
    """One for each Python worker; it outlives a task."""
    return CodePoints()


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, h1, h2, form -> doc_id, n, form, prefix_chars, middle_chars, output."""
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    for batch in batches:
        for a, z in slices(strings(batch.column(1))[1], SLICE):
            part = batch.slice(a, z - a)
            data, texts = strings(part.column(1))
            data, texts = data[texts[0] : texts[-1]], texts - texts[0]
            h1, h2 = (part.column(k).to_numpy() for k in (2, 3))
            ranks = lambda n: [f(h1 % (n + 1), h2 % (n + 1)) for f in (np.minimum, np.maximum)]  # noqa: E731, B023
            n, (lo, hi) = code_points().cut(data, texts, ranks)
            before, upto = ranks(n)
            plain, out, view = [], [], memoryview(data)
            for form, t0, t1, c0, c1 in zip(part.column(4).to_pylist(), texts[:-1].tolist(), texts[1:].tolist(), lo.tolist(), hi.tolist()):
                plain.append(form == "plain")
                if form == "plain":
                    out.append(bytes(view[t0:t1]))
                elif form == "psm":
                    out.append(b"".join((p, view[t0:c0], s, view[c1:t1], m, view[c0:c1])))
                else:
                    out.append(b"".join((s, view[c1:t1], p, view[t0:c0], m, view[c0:c1])))
            plain = np.array(plain, bool)
            cols = [part.column(0), pa.array(n), part.column(4), pa.array(before, mask=plain), pa.array(upto - before, mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (the text to train on), a row for each row of docs."""
    drawn = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), drawn.alias("drawn"))
    h = lambda k: F.conv(F.substring("drawn", 8 * k - 7, 8), 16, 10).cast("long")
    held = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | held | (h(3) % 100 >= CHANGED), "plain").when(h(4) % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    x = x.select("doc_id", "text", h(1).alias("h1"), h(2).alias("h2"), form.alias("form"))
    return x.mapInArrow(_transform, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text again. A changed text holds no sentinel of its own, and no cut can make one with what stands beside it."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
