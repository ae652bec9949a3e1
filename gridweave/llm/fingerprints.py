"""Document fingerprints by locally consistent parsing (operator 6).

The bytes of a text are parsed into phrases whose borders depend on their surroundings only.
Repeats of one name in a row become one name; then neighbours differ, and deterministic coin
tossing (the lowest bit in which a name differs from the one before) makes small labels in which
neighbours differ still.  A phrase begins at each local maximum of the labels.  A phrase is
named by its contents, and the names are parsed again, level by level.  Equal substrings get
equal names but for a few at their borders, wherever they stand.  A fingerprint is the set of
the least hashes of the names of the upper levels; likeness is the estimate of their Jaccard
similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, texts

LEVELS = 5
#: Names of levels below are too short to tell documents apart; they count only for texts that have none above.
FIRST_LEVEL = 2
SKETCH = 48
#: Documents in a range of neighbouring ids, about, and ranges at most (rows of a range are streamed).
RANGE_ROWS = 1_024
MOST_RANGES = 100_000
#: Characters of text that are parsed at once, about.
CHUNK_CHARS = 500_000


def _low_bit(x: np.ndarray) -> np.ndarray:
    """Index of the lowest set bit (of 64-bit words that aren't 0)."""
    return np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.uint64)


def _toss(names: np.ndarray, start: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Small labels; neighbours differ as those of ``names`` do.  ``start``: first of a document."""
    x = names
    for _ in range(rounds):
        before = np.empty_like(x)
        before[1:] = x[:-1]
        before[start] = ~x[start]
        bit = _low_bit(x ^ before)
        x = bit * np.uint64(2) + ((x >> bit) & np.uint64(1))
    return x.astype(np.uint8)


def parse(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: the names and documents of the phrases."""
    new = np.ones(names.size, bool)
    new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, names.size)).astype(np.uint64)
    names, doc = names[first], doc[first]
    many = run > 1
    names[many] = mix(names[many] + run[many] * np.uint64(0x9E3779B97F4A7C15))
    start = np.ones(names.size, bool)
    start[1:] = doc[1:] != doc[:-1]
    label = _toss(names, start)
    cut = start.copy()
    cut[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:]) & ~start[2:]
    head = np.flatnonzero(cut)
    after = np.arange(names.size) - np.repeat(head, np.diff(np.append(head, names.size)))
    weight = mix(after.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    return mix(np.add.reduceat(mix(names) * weight, head)) if names.size else names, doc[head]


def sketches(data: np.ndarray, offs: np.ndarray, size: int = SKETCH) -> list[np.ndarray]:
    """The sorted least distinct 32-bit hashes of each text's phrase names; empty for an empty text."""
    doc = np.repeat(np.arange(offs.size - 1), np.diff(offs))
    names = mix(data.astype(np.uint64) + np.uint64(1))
    kept: list[np.ndarray] = []
    has = np.zeros(offs.size - 1, bool)
    levels = []
    for _ in range(LEVELS):
        names, doc = parse(names, doc)
        levels.append((names, doc))
    for names, doc in levels[FIRST_LEVEL - 1 :]:
        count = np.bincount(doc, minlength=offs.size - 1)
        good = count[doc] > 1  # a single name is the whole text's
        kept.append((doc[good].astype(np.uint64) << np.uint64(32)) | (mix(names[good]) >> np.uint64(32)))
        has[doc[good]] = True
    for names, doc in levels:  # short texts
        rest = ~has[doc]
        kept.append((doc[rest].astype(np.uint64) << np.uint64(32)) | (mix(names[rest]) >> np.uint64(32)))
    all_names = np.unique(np.concatenate(kept))
    ends = np.searchsorted(all_names >> np.uint64(32), np.arange(offs.size).astype(np.uint64))
    low = all_names.astype(np.uint32)
    return [low[a : min(a + size, b)] for a, b in zip(ends, ends[1:], strict=False)]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Jaccard similarity as the least hashes of the union show it; 1 for two empty texts."""
    if not a.size or not b.size:
        return float(a.size == b.size)
    union = np.union1d(a, b)[:size]
    return float(np.isin(union, np.intersect1d(a, b)).sum() / union.size)


def _hex(x: np.ndarray) -> str:
    return x.astype(">u4").tobytes().hex()


def _pack(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each row; null text counts as empty, whose fingerprint is ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "text", CHUNK_CHARS):
            got = sketches(*texts(s.column("text")))
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array([_hex(x) for x in got])], ["doc_id", "fingerprint"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return base.mapInArrow(run, "doc_id long, fingerprint string")


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one
    row per input row.  The edited text has the last half of the code points replaced by the
    first as many of the next document, by ascending id; the last is followed by the first.
    Rows with one id follow each other by the hash of their texts; null ids come first; null
    text is empty; other columns are ignored.

    Rows are dealt once, by ranges of ids; the first row of a range goes to the range before as
    well, so that each task finds the next text beside it.  Range borders are quantiles
    of all ids (MOST_RANGES integers at most); how exact they are changes the balance only.
    """
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    base = base.withColumn("sha", F.xxhash64("text"))
    parts = max(1, min(MOST_RANGES, -(-base.count() // range_rows)))
    cuts = np.array(sorted({int(x) for x in base.approxQuantile("key", [k / parts for k in range(1, parts)], 0.25 / parts)}) if parts > 1 else [], np.int64)

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), "right").astype(np.int32))

    base = base.withColumn("part", place("key"))
    heads = sorted(tuple(r) for r in base.groupBy("part").agg(F.min(F.struct("key", "sha")).alias("head")).select("part", "head.key", "head.sha").collect())
    # the first row of each range, and the range before it: MOST_RANGES rows at most
    first = docs.sparkSession.createDataFrame([(key, sha, heads[i - 1][0]) for i, (_, key, sha) in enumerate(heads)], "key long, sha long, before int")
    marked = base.join(F.broadcast(first), ["key", "sha"], "left")
    to = F.when(F.col("before").isNull(), F.array("part")).otherwise(F.array("part", -1 - F.col("before")))
    dealt = marked.select("key", "sha", "text", F.explode(to).alias("to"))
    to = F.col("to")
    dealt = dealt.select(F.when(to < 0, -1 - to).otherwise(to).alias("part"), (to < 0).cast("int").alias("extra"), "key", "sha", "text")
    dealt = dealt.repartition(max(1, len(heads)), "part").sortWithinPartitions("part", "extra", "key", "sha")

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def emit(chunk: list[tuple[int, str]], after: str) -> pa.RecordBatch:
        texts = [t for _, t in chunk] + [after]
        edited = [_edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        own, changed = sketches(*_pack(texts)), sketches(*_pack(edited))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None if k == -(2**63) else k for k, _ in chunk], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array([_hex(x) for x in own[:-1]]),
                pa.array([_hex(x) for x in changed]),
                pa.array([likeness(a, b) for a, b in zip(own, changed, strict=False)]),
                pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)]),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: list[tuple[int, str]] = []
        held, part = 0, None
        for b in batches:
            for p, extra, key, text in zip(*(b.column(c).to_pylist() for c in ("part", "extra", "key", "text")), strict=True):
                if extra:  # the head of the next range: it ends this one
                    if chunk:
                        yield emit(chunk, text)
                    chunk, held = [], 0
                    continue
                if chunk and held > CHUNK_CHARS:
                    yield emit(chunk, text)
                    chunk, held = [], 0
                chunk.append((key, text))
                held += len(text)
                part = p
        assert not chunk, f"range {part} has no end"

    return dealt.select("part", "extra", "key", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
