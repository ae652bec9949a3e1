"""Variable-capacity best-fit packing (operator 7).

Several sequence lengths are permitted.  Documents longer than the largest are cut into pieces;
pieces are dealt into shards of a bounded number of pieces, and each shard is packed by itself, so
the work grows with the input and no task with it.  In a shard, pieces go, longest first, to the
fullest open bin that has room.  Where none has, a bin is opened: for every permitted length the
pieces that are still to come are laid into a trial bin, and the length whose trial costs least
for each token it holds, downsized, is opened.  So all lengths compete at each opening.  Last, each
bin is downsized to the least length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Permitted sequence lengths (in tokens of a byte-level model: UTF-8 bytes and an end mark).
LENGTHS = (4_096, 8_192, 16_384, 32_768)
#: Cost of a sequence besides its length, in tokens.
OVERHEAD = 64
#: Pieces in a shard, about.
SHARD_PIECES = 8_192
#: Rows that are alike and are numbered by one task at a time.
CHUNK = 4_096


def _trial(sizes: list[int], at: int, length: int) -> int:
    """Tokens in a bin of ``length`` that takes, from piece ``at`` on, each next piece that has room."""
    left = length
    while at < len(sizes) and left >= sizes[-1]:
        if sizes[at] > left:
            at = bisect_left(sizes, -left, at + 1, key=lambda x: -x)
        left -= sizes[at]
        at += 1
    return length - left


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int]]:
    """Bin of each piece (``sizes`` falling) and the length of each bin."""
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    fill: list[int] = []
    at = []
    fit = lambda x: lengths[bisect_left(lengths, x)]
    for i, size in enumerate(sizes):
        k = bisect_left(room, (size, -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            trials = [(_trial(sizes, i, n), n) for n in lengths if n >= size]
            left, b = min(trials, key=lambda t: ((fit(t[0]) + overhead) / t[0], t[1]))[1], len(fill)
            fill.append(0)
        fill[b] += size
        at.append(b)
        if left > size:
            insort(room, (left - size, b))
    return at, [fit(x) for x in fill]


def byte_tokens(text_col: str = "text") -> Column:
    """UTF-8 bytes and the end mark of a document; null counts as empty."""
    return F.coalesce(F.octet_length(text_col), F.lit(0)) + 1


def pack(docs: DataFrame, size: Column | None = None, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, shard_pieces: int = SHARD_PIECES, id_col: str = "doc_id") -> DataFrame:
    """One row per piece: (doc_id, piece, start, size, shard, bin, at, capacity, used).

    ``piece`` counts the pieces of a document, ``start`` is its first token in the document,
    ``at`` its first token in the bin; (shard, bin) names the bin, whose length is ``capacity``
    and whose contents have ``used`` tokens.  ``size`` (default: byte tokens of ``text``) below 1
    or null counts as 1.  Repeated rows are packed each by itself; ties go by id and piece, and
    null ids come first, before negative ones, too; the result
    does not depend on how the rows are dealt over partitions.  Other columns are ignored.  An empty table gives an empty result.
    The number of shards follows from a count of all pieces.
    """
    lengths = tuple(sorted(lengths))
    most = lengths[-1]
    size = byte_tokens() if size is None else size
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(size.cast("long"), F.lit(1)), F.lit(1)).alias("total"))
    n = F.ceil(F.col("total") / F.lit(float(most))).cast("int")
    count = base.agg(F.sum(n)).first()[0] or 0
    shards = max(1, -(-count // shard_pieces))
    # Rows that are alike are counted and numbered anew, a chunk at a time, so that the deal spreads them and yet
    # depends on the rows alone: not on their order, nor on which task is run again.
    alike = base.groupBy("doc_id", "total").agg(F.count(F.lit(1)).alias("rows"))
    chunks = alike.select("doc_id", "total", "rows", F.explode(F.expr(f"sequence(0L, (rows - 1) div {CHUNK})")).alias("chunk")).repartition("doc_id", "total", "chunk")
    each = chunks.select("doc_id", "total", F.explode(F.expr(f"sequence(chunk*{CHUNK}L, least(rows, (chunk + 1)*{CHUNK}L) - 1)")).alias("place"))
    pieces = each.select("doc_id", "total", "place", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece").cast("long") * most).alias("start"), F.least(F.lit(most).cast("long"), F.col("total") - F.col("piece").cast("long") * most).alias("size"), F.pmod(F.xxhash64("doc_id", "total", "piece", "place"), F.lit(shards)).cast("int").alias("shard"))

    def shard(t: pa.Table) -> pa.Table:
        order = [("size", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]
        t = t.take(pc.sort_indices(t, order, null_placement="at_start"))
        at, final = best_fit(t["size"].to_pylist(), lengths, overhead)
        at, size = np.array(at, np.int64), t["size"].to_numpy()
        used = np.bincount(at, weights=size).astype(np.int64)
        by_bin = np.argsort(at, kind="stable")
        begin = np.empty(at.size, np.int64)
        begin[by_bin] = np.cumsum(size[by_bin]) - size[by_bin]
        first = np.full(used.size, np.iinfo(np.int64).max)
        np.minimum.at(first, at, begin)
        new = {"bin": at.astype(np.int32), "at": begin - first[at], "capacity": np.array(final, np.int64)[at], "used": used[at]}
        for name, x in new.items():
            t = t.append_column(name, pa.array(x))
        return t

    schema = "doc_id long, piece int, start long, size long, shard int, bin int, at long, capacity long, used long"
    return pieces.groupBy("shard").applyInArrow(shard, schema)
