"""Vectorised words of byte buffers and XXH64 of many slices at once."""

from __future__ import annotations

import numpy as np

# The five primes of the public XXH64 specification.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The same, with ASCII punctuation as space.
LETTERS = LOWER.copy()
LETTERS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def _rotl(x, r: int):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(buf: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of buf[start:start+length] for each pair; buf needs 8 spare bytes at its end."""
    n, seed = len(start), np.uint64(seed)
    u64 = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    u32 = np.ndarray((len(buf) - 3,), "<u4", buf, 0, (1,))
    pos, rem = start.astype(np.int64), length.astype(np.int64)
    with np.errstate(over="ignore"):
        h = np.full(n, seed + P5, np.uint64)
        if len(long := np.flatnonzero(rem >= 32)):
            v = [np.full(len(long), s, np.uint64) for s in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            stripes, at, step, live = rem[long] // 32, pos[long], 0, np.arange(len(long))
            while len(live):
                p = at[live] + 32 * step
                for k in range(4):
                    v[k][live] = _round(v[k][live], u64[p + 8 * k])
                step += 1
                live = live[stripes[live] > step]
            x = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for k in range(4):
                x = (x ^ _round(np.uint64(0), v[k])) * P1 + P4
            h[long] = x
            pos[long] += 32 * stripes
            rem[long] -= 32 * stripes
        h += length.astype(np.uint64)
        live = np.flatnonzero(rem >= 8)
        while len(live):
            x = h[live] ^ _round(np.uint64(0), u64[pos[live]])
            h[live] = _rotl(x, 27) * P1 + P4
            pos[live] += 8
            rem[live] -= 8
            live = live[rem[live] >= 8]
        if len(live := np.flatnonzero(rem >= 4)):
            x = h[live] ^ (u32[pos[live]].astype(np.uint64) * P1)
            h[live] = _rotl(x, 23) * P2 + P3
            pos[live] += 4
            rem[live] -= 4
        live = np.flatnonzero(rem >= 1)
        while len(live):
            x = h[live] ^ (buf[pos[live]].astype(np.uint64) * P5)
            h[live] = _rotl(x, 11) * P1
            pos[live] += 1
            rem[live] -= 1
            live = live[rem[live] >= 1]
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts data[offsets[i]:offsets[i+1]], put one after the other with single spaces.

    Returns (buffer with 8 spare bytes, start of each word in it, length of each
    word, first word of each text and, last, the number of words). A word is a
    run of bytes other than space and \\x09-\\x0D; the table maps bytes first.
    """
    view = memoryview(data)
    raw = np.frombuffer(b" ".join([view[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]) + b" ", np.uint8)
    raw = table[raw]
    solid = ~SPACE[raw]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(~solid & before)
    lens = ends - starts
    place = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens + 1, out=place[1:])
    buf = np.zeros(place[-1] + 8, np.uint8)
    buf[: place[-1]] = raw[solid | before]
    buf[place[1:] - 1] = 32
    texts = offsets[:-1] - offsets[0] + np.arange(len(offsets) - 1)
    return buf, place[:-1], lens, np.append(np.searchsorted(starts, texts), len(starts))
