"""Token ids of whole texts, with the pieces' ids remembered.

A slice of texts is composed (NFC), lowered, split into the tokenizer's pieces
(one regular expression) and numbered by Arrow, so that Python sees each distinct
piece of a slice once. Ids of pieces are kept in one bounded table; only pieces
that are not in it go through the tokenizer's model. Texts with characters on
which Arrow and the tokenizer disagree, or with an added token written out, are
encoded whole by the tokenizer.
tests/llm compares the ids with the library's, character by character.
"""

from __future__ import annotations

import gc
import re
import unicodedata
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import slices, strings

#: Bytes of text that are split and numbered at a time.
SLICE = 4 << 20
#: What the vocabulary's split pattern takes as a piece besides runs of letters (RE2's \s is ASCII only).
MARKS = r"('s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\s\x0b\x{85}\p{Z}\p{L}\p{N}]+)"
#: Characters that Arrow and the tokenizer lower or split in different ways, and those that Arrow's Unicode tables lack.
ODD = r"[\x1c-\x1f\x{85}\x{130}\x{3a3}\x{180e}\x{feff}]|[^\pL\pM\pN\pP\pS\pZ\p{Cc}\p{Cf}\p{Co}]"


def _byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes
    stand for themselves, the others in order for the characters from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


BYTE_CHARS = _byte_chars()


def composed(texts: pa.Array) -> pa.Array:
    """The texts in NFC; Arrow's own NFC strips and decomposes."""
    wide = np.flatnonzero(~pc.fill_null(pc.string_is_ascii(texts), True).to_numpy(zero_copy_only=False))
    own = texts.take(pa.array(wide)).to_pylist()
    new = {int(i): unicodedata.normalize("NFC", t) for i, t in zip(wide, own) if not unicodedata.is_normalized("NFC", t)}
    if not new:
        return texts
    return pa.array([new.get(i, t) for i, t in enumerate(texts.to_pylist())], texts.type)


class PieceEncoder:
    """ids of texts by the tokenizer file `path`, whose pieces are those of MARKS and runs of letters."""

    def __init__(self, path: str, most: int = 1 << 19) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.most = most
        own = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.odd = "|".join([ODD, *(f"(?i:{t})" for t in own)])  # an added token written out in a text is that token
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.begin, self.used = np.zeros(1 << 16, np.uint32), np.zeros(self.most + 2, np.int64), 0

    def _whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _learn(self, pieces: list[str]) -> None:
        """Give each piece a number and keep its ids."""
        ids, ends, tokenize = [], [], self.tok.model.tokenize
        for p in pieces:
            if p:
                ids += [t.id for t in tokenize(p if p.isascii() and p.isprintable() else "".join([BYTE_CHARS[x] for x in p.encode()]))]
            ends.append(len(ids))
        first = len(self.index)
        self.index.update(zip(pieces, range(first, first + len(pieces))))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[first + 1 : first + len(pieces) + 1] = self.used + np.array(ends)
        self.used += len(ids)

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text. Null: none.

        Without the cycle collector, which would walk the table again and again; nothing here makes cycles."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        _, offsets = strings(column)
        on = gc.isenabled()
        gc.disable()
        try:
            got = [self._encode(column.slice(a, b - a).cast(pa.large_string())) for a, b in slices(offsets, SLICE)]
        finally:
            if on:
                gc.enable()
        if not got:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([ids for ids, _ in got]), np.concatenate([many for _, many in got])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """One slice: Arrow splits it and numbers its distinct pieces, so that Python sees each of them once."""
        odd = pc.fill_null(pc.match_substring_regex(texts, self.odd), False)
        plain = pc.if_else(odd, pa.scalar("", pa.large_string()), texts)
        lists = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(composed(plain)), MARKS, r" \1 "))
        pieces = lists.flatten().dictionary_encode()
        own = pieces.dictionary.to_pylist()
        k = np.fromiter(map(self.index.get, own, repeat(-1)), np.int64, len(own))
        miss = np.flatnonzero(k < 0)
        if len(self.index) + len(miss) > self.most:
            self.clear()
            miss = np.arange(len(own))
        if len(miss) > self.most:
            self.begin = np.zeros(len(miss) + 2, np.int64)
        if len(miss):
            k[miss] = len(self.index) + np.arange(len(miss))
            self._learn([own[i] for i in miss.tolist()])
        # the ids of the distinct pieces one after the other: a small table, the frequent pieces in front
        b, n = self.begin[k], self.begin[k + 1] - self.begin[k]
        first = np.cumsum(n) - n
        local = self.ids[np.repeat(b - first, n) + np.arange(n.sum())]
        at = pieces.indices.to_numpy()
        n = n[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        kind = np.int32 if ends[-1] < 1 << 31 else np.int64
        ids = local[np.repeat(first[at].astype(kind) - ends[:-1].astype(kind), n) + np.arange(ends[-1], dtype=kind)]
        at = ends[np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())))]
        many = np.diff(at)
        parts, since = [], 0
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            whole = np.array(self._whole(texts[i].as_py()), np.uint32)
            many[i] = len(whole)
            parts += [ids[at[since] : at[i]], whole]
            since = i
        if parts:
            ids = np.concatenate([*parts, ids[at[since] :]])
        return ids, many


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One for each Python worker; it outlives a task."""
    return PieceEncoder(path)
