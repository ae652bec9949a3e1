"""Line dedup by winnowing over line hashes (operator 5).

The window at a line is the shortest run of lines from it on that has ``min_words`` words in all.

* Winnow: from every window the line of least hash is selected.  Equal windows select the same
  line, so a run of ``min_words`` words that stands at two places has a selected line at both.
* Join positions: selected positions are joined on their line's hash; those whose line is
  selected at one place only are dropped.
* Extend: from each position that is left, its document's lines are followed both ways, for as
  long as a window can hold the position: windows that begin before and windows that end after.
  A window stands at a later place if an earlier place (by id, then line) has the same lines, in
  the same two 64-bit hashes of each.  All its lines go; overlapping windows join to runs.

With ``extend`` a match reaches both ends of the repeated run, with any earlier copy, not the first
only: the shortest run of ``min_words`` words that ends at a line is a window, too.  A line of a run
R that is repeated and has ``min_words`` words either has that many from R's start to itself, then
the window that ends at it is in R, or the window from R's start holds it and is in R; parts of R
are repeated as R is.  So exactly the lines of maximal repeated runs go, except for their first
copy.  Without ``extend`` the last lines of a run that have fewer words stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, line_hashes, mix, settle, slices, texts

MIN_WORDS = 8


def line_windows(words: np.ndarray, doc: np.ndarray, min_words: int = MIN_WORDS, extend: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of each window over the lines of many documents."""
    n = words.size
    total = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(total, total[:-1] + min_words, "left")  # first line after the window
    last = np.searchsorted(doc, doc, "right")
    first = np.flatnonzero((end <= last) & (end <= n))
    if extend:
        start = np.searchsorted(total, total[1:] - min_words, "right") - 1  # of the window that ends at a line
        at = np.flatnonzero(start >= np.searchsorted(doc, doc, "left"))
        at = at[end[start[at]] != at + 1]  # the others are there already
        first, end = np.concatenate([first, start[at]]), np.concatenate([end[first], at + 1])
    else:
        end = end[first]
    return first, end - first


def fold_lines(first: np.ndarray, size: np.ndarray, hashes: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: the line of least hash, and two names made from the lines' two hashes."""
    least = first.copy()
    names = [np.full(first.size, 0x51ED270B27B4F3CF, np.uint64) for _ in range(2)]
    for k in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        at = first[on] + k
        for name, h in zip(names, (hashes, check), strict=True):
            name[on] = mix(name[on] * np.uint64(0x9E3779B97F4A7C15) + h[at])
        less = hashes[at] < hashes[least[on]]
        least[on[less]] = at[less]
    return least, *names


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _lines(docs: DataFrame) -> DataFrame:
    """(key, hashes, checks, words): the lines of each document; ``docs`` has key and text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            hashes, checks, words, doc = line_hashes(*texts(b.column("text")))
            offs = pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32))
            each = [pa.ListArray.from_arrays(offs, x) for x in (_long(hashes), _long(checks), pa.array(words.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([b.column("key"), *each], ["key", "hashes", "checks", "words"])

    return docs.mapInArrow(cut, "key struct<id:long,sha:long>, hashes array<long>, checks array<long>, words array<int>")


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, checks, words and document of the lines of a batch of ``_lines``."""
    size = b.column("hashes").value_lengths().to_numpy(zero_copy_only=False)
    flat = lambda c: b.column(c).flatten().to_numpy()
    return flat("hashes").view(np.uint64), flat("checks").view(np.uint64), flat("words"), np.repeat(np.arange(b.num_rows), size)


def _rows(batches: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` lines (one document at least)."""
    for b in batches:
        total = np.concatenate([[0], np.cumsum(b.column("hashes").value_lengths().to_numpy(zero_copy_only=False))])
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
            yield b.slice(at, end - at)
            at = end


def _selected(lines: DataFrame, min_words: int, extend: bool) -> DataFrame:
    """(key, line, print): the positions that windows select, each once."""

    def winnow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _rows(batches):
            hashes, checks, words, doc = _flat(b)
            at = np.unique(fold_lines(*line_windows(words, doc, min_words, extend), hashes, checks)[0])
            line = at - np.searchsorted(doc, doc[at])
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(doc[at])), pa.array(line.astype(np.int32)), _long(hashes[at])], ["key", "line", "print"])

    return lines.mapInArrow(winnow, "key struct<id:long,sha:long>, line int, print long")


def _extended(lines: DataFrame, min_words: int, extend: bool) -> DataFrame:
    """(key, at, lines, name, proof): the windows that hold a position of ``at_lines``."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _rows(batches):
            hashes, checks, words, doc = _flat(b)
            first, size = line_windows(words, doc, min_words, extend)
            least, name, proof = fold_lines(first, size, hashes, checks)
            own = np.searchsorted(doc, np.arange(b.num_rows))
            spots = np.repeat(own, b.column("at_lines").value_lengths().to_numpy(zero_copy_only=False)) + b.column("at_lines").flatten().to_numpy()
            held = np.zeros(hashes.size + 1, bool)
            held[spots] = True
            on = np.flatnonzero(held[least])  # the windows whose selected line is such a position
            at = first[on] - own[doc[first[on]]]
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(doc[first[on]])), pa.array(at.astype(np.int32)), pa.array(size[on].astype(np.int32)), _long(name[on]), _long(proof[on])], ["key", "at", "lines", "name", "proof"])

    return lines.mapInArrow(grow, "key struct<id:long,sha:long>, at int, lines int, name long, proof long")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, extend: bool = False) -> DataFrame:
    """(key, gone): the sorted lines that go, of each document that loses some; ``docs`` has key and text."""
    lines = settle(_lines(docs))
    spots = settle(_selected(lines, min_words, extend))
    place = F.struct("key", "line")
    prints = spots.groupBy("print").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count(F.lit(1)).alias("n"))
    prints = settle(prints.where("a != b").select("print", "n"))
    total = spots.count()
    again = join_counted(spots, prints, ["print"], "n", total, "left_semi")
    at_lines = again.groupBy("key").agg(F.collect_set("line").alias("at_lines"))
    windows = settle(_extended(lines.join(at_lines, "key"), min_words, extend))
    names = ["name", "proof", "lines"]
    firsts = windows.groupBy(*names).agg(F.min(F.struct("key", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = settle(firsts.where("n > 1"))
    later = join_counted(windows, firsts, names, "n", total).where(F.struct("key", "at") > F.col("first"))
    gone = later.select("key", F.explode(F.sequence("at", F.col("at") + F.col("lines") - 1)).alias("line"))
    return gone.groupBy("key").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def _key(id_col: str, text: Column) -> Column:
    return F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(text).alias("sha"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, extend: bool = False, deleted_col: str = "_deleted_lines") -> DataFrame:
    """The rows and columns of ``docs`` with the repeated lines deleted from ``text_col``, and their number as ``deleted_col``.

    The first copy of a run, by id and line, stays; null ids come first.  ``extend`` deletes
    repeated runs to both their ends, else only the windows at each line go.  A null or empty text
    stays as it is.  Rows that repeat both id and text are one document.  Other columns may have any name; one
    named like ``deleted_col`` gives way to it.  An empty table gives an empty result.
    """
    every = [c for c in docs.columns if c != deleted_col]
    key = _key(id_col, F.col(text_col))
    gone = repeated_lines(docs.select(key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), min_words, extend)
    # the input's columns are one struct meanwhile, so that no name of theirs can clash
    base = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in every]).alias("row"))
    out = base.join(gone, "key", "left").withColumn("lines", F.when(F.col("gone").isNotNull(), F.split(F.col("row").getField(text_col), "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row").getField(text_col)).otherwise(kept)
    columns = [(text if c == text_col else F.col("row").getField(c)).alias(c) for c in every]
    return out.select(*columns, F.coalesce(F.size("gone"), F.lit(0)).cast("int").alias(deleted_col))
