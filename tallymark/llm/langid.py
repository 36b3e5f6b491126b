"""Language ID: a bidirectional gated recurrent network over bytes.

Texts are cut into windows of ``WINDOW`` bytes. Two GRUs (left to right, right to
left) read each window, every byte gets a probability for each language, and a
document's probabilities are the means over all its bytes. The network is
trained in numpy by backpropagation through time (Adam, cross entropy at every
position) on the driver, from at most ``sample_rows`` windows of 64 characters
drawn at hashed places of hashed rows: the bound is a parameter. Prediction
reads every byte of every text, one Arrow batch at a time.

Text null or without a letter: ``und``, score 0. No labelled row to learn from:
everything is ``und``. Repeated rows each get a row; null languages are not
learned; a null doc_id counts as the empty string for the split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import slices, strings

WINDOW, PAD, SLICE = 64, 256, 1 << 18
UND = "und"


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ids (windows x WINDOW, PAD behind a text's end) and the text of each window."""
    size = np.diff(offsets)
    many = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    at = (offsets[:-1][doc] + WINDOW * nth)[:, None] + np.arange(WINDOW)
    inside = at < offsets[1:][doc][:, None]
    ids = np.full(at.shape, PAD, np.int32)
    ids[inside] = data[at[inside]]
    return ids, doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= np.float32(-1)
    np.exp(x, out=x)
    x += np.float32(1)
    return np.reciprocal(x, out=x)


class Direction:
    """A GRU: reset and update gates, candidate; the byte table holds the input weights."""

    def __init__(self, hidden: int, rng: np.random.Generator) -> None:
        self.hidden = hidden
        self.table = rng.normal(0, 0.3, (PAD + 1, 3 * hidden)).astype(np.float32)
        self.u = rng.normal(0, 0.3, (hidden, 3 * hidden)).astype(np.float32)

    def closed(self) -> np.ndarray:
        """The table with a shut update gate at PAD, so that padding keeps the state."""
        t, h = self.table.copy(), self.hidden
        t[PAD] = 0
        t[PAD, h : 2 * h] = -60
        return t

    def run(self, ids: np.ndarray, keep: list | None = None) -> Iterator[np.ndarray]:
        """State after each column of ids (windows x time)."""
        t, h = self.closed(), self.hidden
        s = np.zeros((len(ids), h), np.float32)
        for k in range(ids.shape[1]):
            x = np.take(t, ids[:, k], axis=0)
            g = s @ self.u
            gate = _sigmoid(x[:, : 2 * h] + g[:, : 2 * h])
            n = np.tanh(x[:, 2 * h :] + gate[:, :h] * g[:, 2 * h :])
            if keep is not None:
                keep.append((s, gate, n, g[:, 2 * h :]))
            s = s + gate[:, h:] * (n - s)
            yield s

    def back(self, ids: np.ndarray, kept: list, out: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and u; out: the loss's gradient at each state."""
        h, ds, gu = self.hidden, np.zeros_like(out[0]), np.zeros_like(self.u)
        dx = np.zeros((ids.shape[1], len(ids), 3 * h), np.float32)
        for k in range(ids.shape[1] - 1, -1, -1):
            s, gate, n, a = kept[k]
            ds = ds + out[k]
            z, r = gate[:, h:], gate[:, :h]
            dn = ds * z * (1 - n * n)
            dx[k, :, :h] = dn * a * r * (1 - r)
            dx[k, :, h : 2 * h] = ds * (n - s) * z * (1 - z)
            dx[k, :, 2 * h :] = dn
            dg = dx[k].copy()
            dg[:, 2 * h :] *= r
            gu += s.T @ dg
            ds = ds * (1 - z) + dg @ self.u.T
        flat, grad = ids.T.ravel(), np.zeros_like(self.table)
        order = np.argsort(flat, kind="stable")
        seen, lead = np.unique(flat[order], return_index=True)
        grad[seen] = np.add.reduceat(dx.reshape(-1, 3 * h)[order], lead, axis=0)
        grad[PAD] = 0
        return grad, gu


class Network:
    def __init__(self, langs: list[str], hidden: int = 8, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.langs, self.rng = langs, rng
        self.ways = (Direction(hidden, rng), Direction(hidden, rng))
        self.w = [rng.normal(0, 0.3, (hidden, len(langs))).astype(np.float32) for _ in range(2)]
        self.b = np.zeros(len(langs), np.float32)

    def positions(self, ids: np.ndarray) -> np.ndarray:
        """Probabilities of every position (time x windows x languages)."""
        p = np.empty((ids.shape[1], len(ids), len(self.langs)), np.float32)
        for k, s in enumerate(self.ways[0].run(ids)):
            np.matmul(s, self.w[0], out=p[k])
        for k, s in enumerate(self.ways[1].run(ids[:, ::-1])):
            p[-1 - k] += s @ self.w[1]
        p += self.b
        np.exp(np.minimum(p, 60, out=p), out=p)
        p /= p.sum(-1, keepdims=True)
        return p

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities of each text; zeros for an empty one."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        ids, doc = windows(data, offsets)
        for a in range(0, len(ids), 4096):
            part = ids[a : a + 4096]
            p = self.positions(part)
            p *= (part.T != PAD)[:, :, None]
            np.add.at(out, doc[a : a + 4096], p.sum(0))
        return out / np.maximum(np.diff(offsets), 1)[:, None]

    def fit(self, ids: np.ndarray, label: np.ndarray, steps: int = 400, batch: int = 256, rate: float = 0.02) -> Network:
        params = [self.ways[0].table, self.ways[0].u, self.ways[1].table, self.ways[1].u, *self.w, self.b]
        m, v = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
        for step in range(1, steps + 1):
            pick = self.rng.integers(0, len(ids), batch)
            x, y = ids[pick], label[pick]
            kept: tuple[list, list] = ([], [])
            f = list(self.ways[0].run(x, kept[0]))
            b = list(self.ways[1].run(x[:, ::-1], kept[1]))[::-1]
            sf, sb = np.stack(f), np.stack(b)
            p = sf @ self.w[0] + sb @ self.w[1] + self.b
            p = np.exp(p - p.max(-1, keepdims=True))
            p /= p.sum(-1, keepdims=True)
            d = (p - np.eye(len(self.langs), dtype=np.float32)[y]) * (x.T != PAD)[:, :, None] / max(1, (x != PAD).sum())
            d = d.astype(np.float32)
            tf, uf = self.ways[0].back(x, kept[0], list(d @ self.w[0].T))
            tb, ub = self.ways[1].back(x[:, ::-1], kept[1], list((d @ self.w[1].T)[::-1]))
            flat = d.reshape(-1, d.shape[-1])
            grads = [tf, uf, tb, ub, sf.reshape(len(flat), -1).T @ flat, sb.reshape(len(flat), -1).T @ flat, flat.sum(0)]
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            for q, g, mm, vv in zip(params, grads, m, v):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                mm += 0.1 * (g - mm)
                vv += 0.01 * (g * g - vv)
                q -= (rate * min(1.0, 2 - 2 * step / (steps + 1)) * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, sample_rows: int = 6000, steps: int = 300) -> Network | None:
    """Learn from text and non-null lang of the rows that are not held out."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(~held_out() & F.expr("lang IS NOT NULL AND text RLIKE '\\\\p{L}'"))
    place = F.expr(f"1 + pmod(xxhash64(doc_id, 11), greatest(length(text) - {WINDOW}, 1))")
    rows = rows.select(F.xxhash64("doc_id", F.lit(5)).alias("o"), "doc_id", "lang", F.col("text").substr(place.cast("int"), F.lit(WINDOW)).alias("w"))
    got = rows.orderBy("o", "doc_id", "lang", "w").limit(sample_rows).select("lang", "w").toArrow()
    if not len(got):
        return None
    langs = sorted(set(got["lang"].to_pylist()))
    data, offsets = strings(got["w"])
    ids, doc = windows(data, offsets)
    label = np.array([langs.index(x) for x in got["lang"].to_pylist()])[doc]
    return Network(langs).fit(ids, label, steps)


def label(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs with lang_pred and score (0 to 1); columns of these names are replaced."""
    own = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    names = [f.name for f in own]
    at, safe = names.index("text"), [f"c{k}" for k in range(len(own))]  # mapInArrow takes no names with dots
    schema = StructType([*[StructField(n, f.dataType) for n, f in zip(safe, own)], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            text = b.column(at)
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False)
            if net is None:
                lang, score = pa.nulls(b.num_rows, pa.string()), np.zeros(b.num_rows)
            else:
                data, offsets = strings(text)
                p = np.concatenate([net.documents(data, offsets[x : y + 1]) for x, y in slices(offsets, SLICE)])
                lang, score = pa.array(net.langs).take(pa.array(p.argmax(1))), np.clip(p.max(1), 0, 1)
            lang = pc.fill_null(pc.if_else(letters, lang, UND), UND)
            yield pa.RecordBatch.from_arrays([*b.columns, lang, pc.if_else(letters, pa.array(score), 0.0)], [*safe, "lang_pred", "score"])

    return docs.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, safe)]).mapInArrow(run, schema).toDF(*names, "lang_pred", "score")


def identify(docs: DataFrame, sample_rows: int = 6000, steps: int = 300) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs."""
    net = train(docs, sample_rows, steps)
    return label(docs.select("doc_id", F.col("text").cast("string").alias("text")), net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
