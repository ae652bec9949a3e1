"""Small helpers that the text operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of ids or pairs of ids (some tens of bytes each) that are broadcast at most; beyond it a
#: shuffle join is used.
BROADCAST_ROWS = 500_000
#: A key is hot if it holds more than this part of all rows, so fewer than HOT_PARTS keys are.
HOT_PARTS = 10_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set and all is local (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridweave-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the shared folder.

    Spark removes a checkpoint that is no longer referenced if the cluster sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``; else the folder is the cluster's to clear.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table of its own in the shared folder.

    Other than a checkpoint, which takes the plan's estimate along, it is planned by its true size;
    so take this where many joins follow each other.  The folder is the cluster's to clear.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """A-Z only, as SQL's translate()."""
    return F.translate(c, UPPER, LOWER)


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side of ``rows`` narrow rows if that is a bounded size; else leave it to a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``groups``, which has one row a key and the key's number of rows.

    The groups that hold more than 1 / HOT_PARTS of ``total`` rows, fewer than HOT_PARTS, are
    broadcast, and their rows stay where they are; only the rows of the other groups are dealt
    out by key.  Key columns must not be null.  ``groups`` is read twice.
    """
    hot = groups.where(F.col(count) > total // HOT_PARTS + 1)
    few = F.broadcast(hot)
    rest = rows.join(few.select(*keys), keys, "left_anti").join(groups.where(F.col(count) <= total // HOT_PARTS + 1), keys, how)
    return rest.unionByName(rows.join(few, keys, "left_semi" if how == "left_semi" else "inner"))


def texts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    n = len(col)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


#: Bytes of text that are worked on at once; arrays of 8 bytes for each of them are made.
SLICE = 512_000


def cuts(offs: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of rows that have about ``most`` bytes of text (one row at least)."""
    at, n = 0, offs.size - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, end
        at = end


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a piece has about ``most`` bytes of text (one row at least)."""
    for b in batches:
        _, offs = texts(b.column(column))
        for at, end in cuts(offs, most):
            yield b.slice(at, end - at)


_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that hashes of similar keys differ in all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _chunks(words: np.ndarray, at: np.ndarray, left: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    """A random number for each (place, 8 bytes) of a token, of which ``left`` bytes are its own."""
    x = words[at]
    x &= _LEFT[np.minimum(left, 8)]
    key = place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x ^= mix(key + np.uint64(seed))
    return mix(x)


def token_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 0x51ED270B27B4F3CF) -> np.ndarray:
    """64-bit hashes of the byte strings data[start : start + size].

    A hash is the sum, over a token's chunks of 8 bytes, of a random number of place and chunk;
    so texts that repeat a pattern don't collide as they do under powers of one base.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((data.size + 1,), "<u8", padded, strides=(1,))  # the 8 bytes from each byte on
    h = _chunks(words, start, size, np.zeros(1, np.int64), seed)
    long = np.flatnonzero(size > 8)
    more = -(-size[long] // 8) - 1  # chunks after the first
    total = np.concatenate([[0], np.cumsum(more)])
    for a, b in cuts(total, SLICE // 8):
        some = long[a:b]
        first = total[a:b] - total[a]
        if b == a + 1 and more[a] > SLICE:  # a very long token
            for c in range(1, int(more[a]) + 1, SLICE):
                place = np.arange(c, min(c + SLICE, int(more[a]) + 1))
                h[some] += _chunks(words, start[some] + 8 * place, size[some] - 8 * place, place, seed).sum(dtype=np.uint64)
            continue
        place = np.arange(1, int(total[b] - total[a]) + 1) - np.repeat(first, more[a:b])
        far = 8 * place
        h[some] += np.add.reduceat(_chunks(words, np.repeat(start[some], more[a:b]) + far, np.repeat(size[some], more[a:b]) - far, place, seed), first)
    return mix(h + size.astype(np.uint64) * _MUL)


def word_hashes(data: np.ndarray, offs: np.ndarray, kind: str = "blank") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of many texts and the document index of each word.

    ``kind`` "blank": words are what stands between ASCII white space; "letter": runs of
    letters, digits and non-ASCII bytes.  A-Z are lowered.
    """
    if data.size == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = _FOLD[data]
    inside = (_LETTER if kind == "letter" else _WORD)[data]
    cut = np.zeros(data.size + 1, bool)
    cut[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    s = np.flatnonzero(start)
    inside[:-1] &= ~inside[1:] | cut[1:-1]  # the last bytes of words
    e = np.flatnonzero(inside) + 1
    return token_hashes(data, s, e - s), np.searchsorted(offs, s, "right") - 1


def line_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes, number of words and document index of each line of many texts, ends apart.

    A text has a line more than it has line ends; words stand between blanks, tabs and returns.
    The two hashes are independent: lines that agree in both are taken as equal.
    """
    n = offs.size - 1
    ends = np.flatnonzero(data == 10)
    # a line starts at each text and after each line end; a text's own start comes first
    start = np.concatenate([offs[:-1], ends + 1])
    doc = np.concatenate([np.arange(n), np.searchsorted(offs, ends, "right") - 1])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    last = np.concatenate([doc[1:] != doc[:-1], [True]]) if doc.size else np.zeros(0, bool)
    end = np.where(last, offs[doc + 1], np.append(start[1:], 0) - 1)
    word = ~((data == 32) | (data == 9) | (data == 13) | (data == 10))
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = offs[:-1][(offs[:-1] < data.size) & (np.diff(offs) > 0)]
    first[cut] = word[cut]
    count = np.concatenate([[0], np.cumsum(first)])
    size = end - start
    return token_hashes(data, start, size), token_hashes(data, start, size, 0x632BE59BD9B4E019), count[end] - count[start], doc
