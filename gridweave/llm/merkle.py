"""A Merkle manifest of a table (operator 12): a digest of each row, each language and the whole, with proofs.

A row's leaf is a digest of its columns.  The leaves of a language, in order of id, are nodes 0 to
n-1 of its tree; ``fanout`` consecutive nodes of a level have their digest as parent, and the last run may
be shorter, even a single node.  The roots of the languages are the leaves of the top tree.

Trees are built in aligned blocks of ``fanout ** depth`` nodes.  Digests are written in hex, so a block
is a contiguous numpy matrix of 64 bytes a row; a level is made by reshaping it to ``fanout`` digests a row
and hashing the rows, and siblings are found by index arithmetic.  The roots of blocks are the nodes of the next tier,
which goes the same way; a tier is ``fanout ** depth`` times smaller than the one before.  Then paths
come down: a block's path to the root meets the nodes of the block in a cogroup, so each task
holds one block and one path, whatever the size of a language.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, settle

#: Levels in a block: 2 ** 12 leaves of 64 bytes.
DEPTH = 12
#: Rows whose id's crc32 is divisible by it are checked as if tampered with.
TAMPER = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "sibs string, shape binary, subroot string, root string"


def field(c: Column) -> Column:
    """A value with its length in UTF-8 bytes; null is told from all values."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns.values()]), 256)


def _hash(rows: np.ndarray) -> np.ndarray:
    """The hex digest of each row of bytes, as a matrix of 64 bytes a row."""
    made = b"".join([hashlib.sha256(r).hexdigest().encode() for r in rows])
    return np.frombuffer(made, np.uint8).reshape(-1, 64)


def _matrix(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer("".join(digests.to_pylist()).encode(), np.uint8).reshape(-1, 64)


def levels(nodes: np.ndarray, fanout: int, depth: int | None) -> list[np.ndarray]:
    """A block's levels from its nodes up: ``depth`` levels above them, or up to a single node."""
    out = [np.ascontiguousarray(nodes)]
    while len(out[-1]) > 1 if depth is None else len(out) <= depth:
        now = out[-1]
        whole = len(now) // fanout * fanout
        parts = [_hash(now[:whole].reshape(-1, fanout * 64))]
        if whole < len(now):
            parts.append(_hash(now[whole:].reshape(1, -1)))
        out.append(np.concatenate(parts))
    return out


def runs(level: np.ndarray, node: np.ndarray, fanout: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The run of each node of a level: (digests [node, place, 64], the node's own place, size of the run)."""
    start = node // fanout * fanout
    run = level[np.minimum(start[:, None] + np.arange(fanout), len(level) - 1)]
    return run, node - start, np.minimum(fanout, len(level) - start)


def _fold(digest: bytes, sibs: bytes, shape: bytes) -> bytes:
    """A digest carried up a path of siblings."""
    at = 0
    for place, size in zip(shape[::2], shape[1::2], strict=True):
        left, right = at + 64 * place, at + 64 * (size - 1)
        digest = hashlib.sha256(sibs[at:left] + digest + sibs[left:right]).hexdigest().encode()
        at = right
    return digest


def _ranked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, their place from 0 on among the rows of ``key`` in ``order``, and ``total``, how many there are.

    Rows are dealt by ranges and sorted there; the runs of a key in the ranges are counted and summed up,
    so that no key is in one task.  ``order`` must tell all rows apart.
    """
    rows = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_m", F.monotonically_increasing_id())
    rows = settle(rows.withColumns({"_pid": F.shiftright("_m", 33), "_low": F.col("_m").bitwiseAND((1 << 33) - 1)}).drop("_m"))
    found = rows.groupBy(key, "_pid").agg(F.count(F.lit(1)).alias("_c"), F.min("_low").alias("_first"))  # a row for each range and key in it
    own = Window.partitionBy(key)
    before = F.coalesce(F.sum("_c").over(own.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = settle(found.select(key, "_pid", (before - F.col("_first")).alias("_shift"), F.sum("_c").over(own).alias("total")))
    return rows.join(bounded_broadcast(found, found.count()), [key, "_pid"]).withColumn("at", F.col("_low") + F.col("_shift")).drop("_pid", "_low", "_shift")


def _tiers(nodes: DataFrame, fanout: int, depth: int) -> list[DataFrame]:
    """(key, at, total, digest) of the tiers of block roots, from ``nodes`` up to one node a key."""
    size = fanout**depth

    def root(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        total = t["total"][0].as_py()
        top = levels(_matrix(t["digest"]), fanout, depth if total > size else None)[-1]
        cols = [t["key"][:1], pa.array([t["at"][0].as_py() // size], pa.int64()), pa.array([-(-total // size)], pa.int64()), pa.array([top.tobytes().decode()])]
        return pa.Table.from_arrays(cols, ["key", "at", "total", "digest"])

    out = [nodes]
    while (out[-1].agg(F.max("total")).first()[0] or 1) > 1:
        blocks = out[-1].select("key", "at", "total", "digest", F.expr(f"at div {size}").alias("block")).groupBy("key", "block")
        out.append(settle(blocks.applyInArrow(root, "key string, at long, total long, digest string")))
    return out


def _down(nodes: DataFrame, paths: DataFrame, fanout: int, depth: int) -> DataFrame:
    """The path to the root of each node, from the paths of the block roots above."""
    size = fanout**depth

    def walk(t: pa.Table, above: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        up = {c: above[c][0].as_py() for c in above.column_names}
        made = levels(_matrix(t["digest"]), fanout, depth if t["total"][0].as_py() > size else None)
        sibs, shape = [b""] * t.num_rows, [b""] * t.num_rows
        node = np.arange(t.num_rows)
        for level in made[:-1]:
            run, place, count = runs(level, node, fanout)
            for i in range(t.num_rows):
                sibs[i] += run[i, : place[i]].tobytes() + run[i, place[i] + 1 : count[i]].tobytes()
                shape[i] += bytes((place[i], count[i]))
            node = node // fanout
        same = [pa.array([up[c]] * t.num_rows) for c in ("subroot", "root")]
        return pa.Table.from_arrays([t["key"], t["at"], pa.array([s.decode() + up["sibs"] for s in sibs]), pa.array([s + up["shape"] for s in shape], pa.binary()), *same], ["key", "at", "sibs", "shape", "subroot", "root"])

    return settle(_met(nodes, paths, size).applyInArrow(walk, f"key string, at long, {PATH}"))


def _met(nodes: DataFrame, paths: DataFrame, size: int):
    blocks = nodes.withColumn("block", F.expr(f"at div {size}")).groupBy("key", "block")
    return blocks.cogroup(paths.withColumnRenamed("at", "block").groupBy("key", "block"))


def manifest(docs: DataFrame, fanout: int = 2, depth: int = DEPTH, tamper: int = TAMPER) -> DataFrame:
    """One row per input row: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified).

    Leaves are in order of doc_id, null first, then of their digest; rows that are alike are leaves each.  ``proof_sha256``
    is the digest of all siblings from the leaf to the root.  ``folded_root`` is recomputed along them from the leaf,
    or, where ``tamper`` divides the crc32 of the decimal doc_id, from the leaf of the row with 1 added to n_chars; a
    null n_chars stays, and a row without an id is as it is.  ``verified`` tells whether it is the root.  Other columns are ignored;
    an empty table gives an empty result.
    """
    if not 2 <= fanout <= 255:
        raise ValueError("the fanout must be from 2 to 255")
    size = fanout**depth
    have = {c: F.col(c) for c in FIELDS}
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % tamper == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    other = F.when(changed, leaf(have | {"n_chars": F.col("n_chars") + 1}))
    # a null language comes before all others
    key = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col("lang").cast("string")))
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf(have).alias("digest"), other.alias("other"))
    rows = settle(rows.withColumn("_row", F.monotonically_increasing_id()))
    leaves = settle(_ranked(rows, "key", ["doc_id", "digest", "_row"]).drop("_row"))
    tiers = _tiers(leaves.select("key", "at", "total", "digest"), fanout, depth)
    subroots = tiers[-1].select("key", F.col("digest").alias("subroot"))
    ranked = _ranked(subroots.withColumnsRenamed({"key": "lang_key", "subroot": "digest"}).withColumn("key", F.lit("")), "key", ["lang_key"])
    tops = _tiers(settle(ranked), fanout, depth)
    end = tops[-1].select("key", "at", F.lit("").alias("sibs"), F.lit(b"").alias("shape"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for tier in tops[-2::-1]:
        end = _down(tier, end, fanout, depth)
    # a language's path begins at its subroot, the only node of its last tier
    paths = end.join(tops[0].select("at", "lang_key", F.col("digest").alias("own")), "at").select(F.col("lang_key").alias("key"), F.lit(0).cast("long").alias("at"), "sibs", "shape", F.col("own").alias("subroot"), "root")
    for tier in tiers[-2:0:-1]:
        paths = _down(tier, paths, fanout, depth)

    def check(t: pa.Table, above: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        up, n = {c: above[c][0].as_py() for c in above.column_names}, t.num_rows
        nodes = _matrix(t["digest"])
        made = levels(nodes, fanout, depth if t["total"][0].as_py() > size else None)
        other = t["other"].to_pylist()
        now = nodes.copy()
        for i, x in enumerate(other):
            if x is not None:
                now[i] = np.frombuffer(x.encode(), np.uint8)
        proofs = [hashlib.sha256() for _ in range(n)]
        node, each = np.arange(n), np.arange(n)
        for level in made[:-1]:
            run, place, count = runs(level, node, fanout)
            for i in range(n):
                proofs[i].update(run[i, : place[i]])
                proofs[i].update(run[i, place[i] + 1 : count[i]])
            run[each, place] = now
            for c in np.unique(count):  # all runs but the last are whole
                now[count == c] = _hash(run[count == c, :c].reshape(-1, c * 64))
            node = node // fanout
        sibs, memo = up["sibs"].encode(), {}
        folded = []
        for i in range(n):
            proofs[i].update(sibs)
            d = now[i].tobytes()
            if d not in memo:
                memo[d] = _fold(d, sibs, up["shape"]).decode()
            folded.append(memo[d])
        same = [pa.array([up[c]] * n) for c in ("subroot", "root")]
        cols = [t["doc_id"], t["digest"], *same, pa.array([p.hexdigest() for p in proofs]), pa.array(folded), pa.array([x == up["root"] for x in folded])]
        return pa.Table.from_arrays(cols, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _met(leaves, paths, size).applyInArrow(check, schema)


def oracle_sql(fanout: int = 2, tamper: int = TAMPER) -> str:
    """The manifest as SQL for DuckDB: trees, then proofs and folds, by recursion level by level."""
    cell = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    digest = lambda cells: f"sha256({' || '.join(cells)})"
    have = [cell(c) for c in FIELDS]
    # the unsigned crc32 of the decimal id, bit by bit
    bits = "list_reduce(list_concat([xor(c, x)], [1::BIGINT, 1, 1, 1, 1, 1, 1, 1]), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda y: ascii(y)::BIGINT)), lambda c, x: {bits}), 4294967295)"
    tree = lambda start: f"""{start} UNION ALL
    SELECT k, lvl + 1, pos // {fanout}, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + {fanout - 1}) // {fanout} FROM %s WHERE n > 1 GROUP BY k, lvl, pos // {fanout}"""  # noqa: E731
    return f"""
WITH RECURSIVE d AS (SELECT coalesce('+' || lang, '') AS k, doc_id, {digest(have)} AS leaf, coalesce({crc} % {tamper} = 0, false) AND n_chars IS NOT NULL AS changed,
  {digest([cell('(n_chars + 1)') if c == "n_chars" else x for c, x in zip(FIELDS, have, strict=True)])} AS other FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM d),
t AS ({tree('SELECT k, 0 AS lvl, pos, leaf AS h, n FROM leaves') % 't'}),
s AS (SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS ({tree("SELECT '' AS k, 0 AS lvl, pos, h, n FROM s") % 'u'}),
r AS (SELECT h AS root FROM u WHERE n = 1),
low AS (SELECT k, max(lvl) AS high FROM t GROUP BY 1),
nodes AS (SELECT k, lvl, pos, h, n FROM t WHERE n > 1 UNION ALL SELECT s.k, high + u.lvl, u.pos, u.h, u.n FROM s JOIN low USING (k), u WHERE u.n > 1),
f AS (SELECT l.k, l.pos AS row, 0 AS lvl, l.pos, CASE WHEN changed THEN other ELSE leaf END AS h, '' AS sibs FROM leaves l UNION ALL
  SELECT f.k, f.row, f.lvl + 1, any_value(f.pos) // {fanout}, sha256(string_agg(CASE WHEN x.pos = f.pos THEN f.h ELSE x.h END, '' ORDER BY x.pos)),
  any_value(f.sibs) || coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos <> f.pos), '')
  FROM (SELECT f.k, f.row, f.lvl, CASE WHEN f.lvl = low.high THEN s.pos ELSE f.pos END AS pos, f.h, f.sibs FROM f JOIN low USING (k) JOIN s USING (k)) f
  JOIN nodes x ON x.k = f.k AND x.lvl = f.lvl AND x.pos // {fanout} = f.pos // {fanout} GROUP BY f.k, f.row, f.lvl),
g AS (SELECT k, row, arg_max(h, lvl) AS folded_root, sha256(arg_max(sibs, lvl)) AS proof_sha256 FROM f GROUP BY 1, 2)
SELECT doc_id, leaf, s.h AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN s ON s.k = l.k JOIN g ON g.k = l.k AND g.row = l.pos, r"""
