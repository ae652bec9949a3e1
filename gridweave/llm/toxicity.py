"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams (operator 9).

Features of a document are the hashed words, pairs of neighbours and pairs with one or two words
between them (skip-grams), each once.  Training runs over a bounded sample of labelled
documents with a learning rate for each coordinate and L1 sparsity, so that few weights are
not zero; those go to the executors, which score whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cuts, mix, slices, texts, word_hashes

BITS = 20
#: Labelled documents that training takes at most, those with the least hashes of their ids.
TRAIN_ROWS = 8_000
THRESHOLD = 0.3


def fold(id_col: str, of: int) -> Column:
    """crc32 of the id's decimal text modulo ``of``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


def features(data: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Document indices and hashed features, with repetitions."""
    h, d = word_hashes(data, offs, "letter")
    docs, found = [d], [mix(h)]
    for gap in (1, 2, 3):
        same = np.flatnonzero(d[gap:] == d[:-gap]) if d.size > gap else np.zeros(0, np.int64)
        docs.append(d[same])
        found.append(mix(h[same] * np.uint64(0xD6E8FEB86659FD93) + (h[same + gap] ^ np.uint64(gap)) * np.uint64(0xA0761D6478BD642F)))
    return np.concatenate(docs), (np.concatenate(found) & np.uint64((1 << bits) - 1)).astype(np.int64)


@dataclass
class Ftrl:
    """FTRL-proximal state; the last coordinate is the bias, which has no L1 term."""

    bits: int = BITS
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.0
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros((1 << self.bits) + 1), np.zeros((1 << self.bits) + 1)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        l1 = np.where(i == 1 << self.bits, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2))

    def step(self, i: np.ndarray, y: int) -> None:
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        self.z[i] += g - (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha * w
        self.n[i] += g * g

    def fit(self, rows: list[tuple[np.ndarray, int]], epochs: int = 4, seed: int = 7) -> Ftrl:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                i, y = rows[k]
                self.step(np.append(i, 1 << self.bits), y)
        return self

    def compact(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Coordinates and values of the weights that aren't zero, and the bias."""
        step = 1 << 16
        w = np.concatenate([self.weights(np.arange(a, min(a + step, self.z.size))).astype(np.float32) for a in range(0, self.z.size, step)])
        keep = np.flatnonzero(w[:-1])
        return keep.astype(np.int32), w[keep], float(w[-1])


def score_texts(data: np.ndarray, offs: np.ndarray, dense: np.ndarray, bias: float) -> np.ndarray:
    d, i = features(data, offs)
    hit = np.flatnonzero(dense[i])
    pairs = np.unique((d[hit] << BITS) | i[hit])
    total = np.bincount(pairs >> BITS, weights=dense[pairs & ((1 << BITS) - 1)], minlength=offs.size - 1)
    return 1 / (1 + np.exp(-np.clip(total + bias, -35, 35)))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", held: tuple[int, int] | None = (4, 2)) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Compact weights learned from at most ``rows`` labelled documents; None without any.

    Documents whose ``fold`` by held[0] is held[1] are left out.  Of rows that repeat an id one is
    learned from; a document with labels of both kinds counts as 1.
    """
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    if held:
        lab = lab.where(fold("id", held[0]) != held[1])
    lab = lab.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(lab), "id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            d, i = features(*texts(b.column("text")))
            pairs = np.unique((d << BITS) | i)
            ends = np.searchsorted(pairs >> BITS, np.arange(b.num_rows + 1))
            low = (pairs & ((1 << BITS) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array([low[s:e].tobytes() for s, e in zip(ends, ends[1:], strict=False)], pa.binary())], ["id", "y", "features"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # features stay where Arrow has them; an id has one row
        got = sorted(((i, y, np.frombuffer(f.as_buffer(), np.int32)) for b in batches for i, y, f in zip(b.column("id").to_pylist(), b.column("y").to_pylist(), b.column("features"), strict=True)), key=lambda r: r[0])
        if got:
            keep, values, bias = Ftrl().fit([(f, y) for _, y, f in got]).compact()
            yield pa.RecordBatch.from_arrays([pa.array([keep.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary()), pa.array([bias])], ["keep", "values", "bias"])

    # one task learns from the bounded sample, so the driver sees the compact weights only
    each = text.select("id", "y", "text").mapInArrow(extract, "id long, y int, features binary")
    sample = each.groupBy("id", "y").agg(F.min("features").alias("features"))  # at most ``rows`` rows
    got = sample.coalesce(1).mapInArrow(learn, "keep binary, values binary, bias double").collect()
    return (np.frombuffer(got[0].keep, np.int32), np.frombuffer(got[0]["values"], np.float32), got[0].bias) if got else None


def score_column(model: tuple[np.ndarray, np.ndarray, float] | None) -> Callable[[Column | str], Column]:
    """Text column -> score (0 to 1); null counts as empty.  Without a model every score is 0."""

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dense = np.zeros(1 << BITS, np.float32)
        if model:
            dense[model[0]] = model[1]
        for col in columns:
            _, offs = texts(col)
            p = [score_texts(*texts(col.slice(a, b - a)), dense, model[2]) if model else np.zeros(b - a) for a, b in cuts(offs)]
            yield pa.array(np.concatenate([np.zeros(0), *p]))

    return score


def toxicity_scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: (doc_id, held_out, score, predicted).

    Null text counts as empty, whose score is that of the bias.  ``held_out`` is false for a
    null id.  Without a model every score is 0.  Repeated rows pass through, other columns are
    ignored.  An empty table gives an empty result.
    """
    held = F.coalesce(fold(id_col, 4) == 2, F.lit(False)).alias("held_out")
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), held, score_column(model)(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
