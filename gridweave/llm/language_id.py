"""Language identification with a bidirectional gated recurrent network over bytes (operator 3).

The network is trained in numpy by backpropagation through time on windows of bytes from a
bounded sample of documents.  It labels each byte position of a text, forward and backward
states joined; a document's probabilities are the means over all its positions.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cuts, mix, slices, texts
from .toxicity import fold

HIDDEN = 8
WINDOW = 64
PAD = 256
#: Documents of which windows are learned at most, and windows in all.
TRAIN_ROWS = 4_000
TRAIN_WINDOWS = 8_000
STEPS = 400
UNKNOWN = "und"


@dataclass
class Network:
    """``inputs`` [2, 257, 3H] (update, reset, candidate), ``state`` [2, H, 3H], ``out`` [2H, K], ``bias`` [K]."""

    langs: list[str]
    inputs: np.ndarray
    state: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def init(langs: list[str], hidden: int = HIDDEN, seed: int = 3) -> Network:
    rng = np.random.default_rng(seed)
    f = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    net = Network(langs, f(2, 257, 3 * hidden), f(2, hidden, 3 * hidden), f(2 * hidden, len(langs)), np.zeros(len(langs), np.float32))
    net.inputs[:, PAD] = 0
    net.inputs[:, PAD, :hidden] = 40  # the update gate is 1, so padding leaves the state as it is
    return net


def states(net: Network, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States [T, 2, B, H] of windows x [B, T]; those of the second direction run from the end."""
    h_n = net.state.shape[1]
    b, t_n = x.shape
    h = np.zeros((2, b, h_n), np.float32)
    all_h, tape = np.empty((t_n, 2, b, h_n), np.float32), []
    back = np.ascontiguousarray(x.T)
    a = np.empty((2, b, 3 * h_n), np.float32)
    for t in range(t_n):
        np.take(net.inputs[0], back[t], axis=0, out=a[0])
        np.take(net.inputs[1], back[t_n - 1 - t], axis=0, out=a[1])
        u = h @ net.state
        g = a[..., : 2 * h_n] + u[..., : 2 * h_n]
        g *= 0.5
        np.tanh(g, out=g)
        g += 1
        g *= 0.5  # the logistic function
        z, r = g[..., :h_n], g[..., h_n:]
        n = u[..., 2 * h_n :] * r
        n += a[..., 2 * h_n :]
        np.tanh(n, out=n)
        new = n + z * (h - n)
        if keep:
            tape.append((h, z.copy(), r.copy(), n, u[..., 2 * h_n :].copy()))
        all_h[t] = h = new
    return all_h, tape


def logits(net: Network, all_h: np.ndarray) -> np.ndarray:
    """[T, B, K] by position."""
    h_n = net.state.shape[1]
    return all_h[:, 0] @ net.out[:h_n] + all_h[::-1, 1] @ net.out[h_n:] + net.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the positions and its gradients (inputs, state, out, bias)."""
    h_n = net.state.shape[1]
    all_h, tape = states(net, x, keep=True)
    real = (x.T != PAD).astype(np.float32)
    p = softmax(logits(net, all_h))
    total = max(1.0, float(real.sum()))
    hot = np.arange(x.shape[0])
    loss = -float((np.log(p[:, hot, y] + 1e-12) * real).sum()) / total
    p[:, hot, y] -= 1
    p *= (real / total)[..., None]
    flat = p.reshape(-1, p.shape[-1])
    g_out = np.concatenate([all_h[:, 0].reshape(-1, h_n).T @ flat, all_h[::-1, 1].reshape(-1, h_n).T @ flat])
    into = np.stack([p @ net.out[:h_n].T, (p @ net.out[h_n:].T)[::-1]], axis=1)
    g_in, g_state = np.zeros_like(net.inputs), np.zeros_like(net.state)
    dh = np.zeros_like(into[0])
    for t in range(x.shape[1] - 1, -1, -1):
        h, z, r, n, un = tape[t]
        dh = dh + into[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        da = np.concatenate([dz, dr, dn], axis=-1)
        du = np.concatenate([dz, dr, dn * r], axis=-1)
        g_state += h.transpose(0, 2, 1) @ du
        np.add.at(g_in[0], x[:, t], da[0])
        np.add.at(g_in[1], x[:, x.shape[1] - 1 - t], da[1])
        dh = dh * z + du @ net.state.transpose(0, 2, 1)
    g_in[:, PAD] = 0
    return loss, [g_in, g_state, g_out, flat.sum(0)]


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], steps: int = STEPS, batch: int = 128, rate: float = 0.02, seed: int = 5) -> Network:
    """Adam over random batches of windows."""
    net, rng = init(langs), np.random.default_rng(seed)
    params = [net.inputs, net.state, net.out, net.bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, steps + 1):
        i = rng.integers(0, len(x), min(batch, len(x)))
        _, grads = gradients(net, x[i], y[i])
        now = rate * (1 - 0.9 * k / steps)
        for p, g, a, b in zip(params, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= now * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
    return net


def windows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts cut into windows of bytes [n, WINDOW], padded, and the document of each."""
    size = np.diff(offs)
    count = -(-size // WINDOW)
    doc = np.repeat(np.arange(size.size), count)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    at = offs[:-1][doc] + (np.arange(doc.size) - first[doc]) * WINDOW
    pos = at[:, None] + np.arange(WINDOW)
    out = np.full(pos.shape, PAD, np.int16)
    ok = pos < offs[1:][doc][:, None]
    out[ok] = data[pos[ok]]
    return out, doc


def predict(net: Network, data: np.ndarray, offs: np.ndarray, batch: int = 1024) -> np.ndarray:
    """Document probabilities [n, K]: means over the positions; zeros for an empty text."""
    x, doc = windows(data, offs)
    total = np.zeros((len(x), len(net.langs)), np.float32)
    for i in range(0, len(x), batch):
        w = x[i : i + batch].astype(np.int64)
        p = softmax(logits(net, states(net, w)[0]))
        if (w[:, -1] == PAD).any():
            p *= (w.T != PAD)[..., None]
        total[i : i + batch] = p.sum(0)
    out = np.zeros((offs.size - 1, len(net.langs)))
    for k in range(len(net.langs)):
        out[:, k] = np.bincount(doc, weights=total[:, k], minlength=offs.size - 1)
    return out / np.maximum(1, np.diff(offs))[:, None]


def train(docs: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_WINDOWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held: tuple[int, int] | None = (3, 1)) -> Network | None:
    """A network from at most ``most`` windows of at most ``rows`` documents with a language.

    Documents whose ``fold`` by held[0] is held[1] are left out.  The windows stand at places
    anywhere in a text that depend on its id.  Of rows that repeat an id one is learned from.  None
    if no document can be learned from.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id is not null and lang is not null and length(text) > 0")
    if held:
        base = base.where(fold("id", held[0]) != held[1])
    ids = base.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(rows)
    n = ids.count()
    each = max(1, min(16, most // max(1, n)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, offs = texts(b.column("text"))
            out = []
            for k in range(b.num_rows):
                span = int(offs[k + 1] - offs[k])
                seed = mix(np.arange(each).astype(np.uint64) + np.uint64((b.column("id")[k].as_py() or 0) & 0xFFFFFFFF) * np.uint64(31))
                at = offs[k] + (seed % np.uint64(max(1, span - WINDOW + 1))).astype(np.int64)
                out.append([data[a : min(a + WINDOW, offs[k + 1])].tobytes() for a in at])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), pa.array(out, pa.list_(pa.binary()))], ["id", "lang", "parts"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((i, x["lang"], x["parts"]) for b in batches for i, x in zip(b.column("id").to_pylist(), b.column("one").to_pylist(), strict=True))
        if got:
            langs = sorted({lang for _, lang, _ in got})
            x = np.full((sum(len(parts) for *_, parts in got), WINDOW), PAD, np.int64)
            y = np.array([langs.index(lang) for _, lang, parts in got for _ in parts])
            for k, part in enumerate(p for *_, parts in got for p in parts):
                x[k, : len(part)] = np.frombuffer(part, np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(x, y, langs))], pa.binary())], ["network"])

    # one task learns from the bounded sample, so the driver sees the network only
    windows_of = base.join(F.broadcast(ids), "id").select("id", "lang", "text").mapInArrow(cut, "id long, lang string, parts array<binary>")
    sample = windows_of.groupBy("id").agg(F.min(F.struct("lang", "parts")).alias("one"))  # at most ``rows`` rows
    got = sample.coalesce(1).mapInArrow(learn, "network binary").collect()
    return pickle.loads(got[0].network) if got else None


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def language_column(net: Network | None) -> Callable[[Column | str], Column]:
    """Text column -> struct (lang, score); ``und`` with score 0 for a text without a letter, and without a network."""

    def label(col: pa.Array) -> pa.Array:
        data, offs = texts(col)
        letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
        some = letters[offs[1:]] > letters[offs[:-1]]
        for k in np.flatnonzero(~some):
            some[k] = any(c.isalpha() for c in col[int(k)].as_py() or "")
        best, top = np.full(len(col), UNKNOWN, object), np.zeros(len(col))
        if net and len(col):
            p = predict(net, data, offs)
            best, top = np.where(some, np.array(net.langs, object)[p.argmax(1)], UNKNOWN), np.where(some, np.clip(p.max(1), 0, 1), 0.0)
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(top)], ["lang", "score"])

    @F.arrow_udf("lang string, score double")
    def labels(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in columns:
            _, offs = texts(col)
            parts = [label(col.slice(a, b - a)) for a, b in cuts(offs)]
            yield pa.concat_arrays(parts) if parts else label(col)

    return labels


def language_ids(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, held_out, lang_pred, score).

    ``und`` with score 0 for a text that is null or has no letter, and without a network.
    ``held_out`` is false for a null id.  Repeated rows pass through, other columns are ignored.
    An empty table gives an empty result.
    """
    held = F.coalesce(fold(id_col, 3) == 1, F.lit(False)).alias("held_out")
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), held, language_column(net)(F.col(text_col)).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
