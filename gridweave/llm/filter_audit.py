"""Interaction audit of quality filters (operator 11).

Every document gets a mask of the filters that it fails; how often each mask occurs then tells, for
every order of the filters, what each step removes.

Filters A to D look at one text.  E, that a smaller id has the same text, is found by partition
refinement over narrow rows: documents are split by their number of code points, then by the hash
of one block of text after the other, the last block being the rest, and a class of one document is
dropped as soon as it stands alone.  The whole texts of the classes that survive are compared: a
class all of whose texts agree needs its least id only; a class of different texts, which no hash
has told apart, is split by the texts.  Ids other than the least of their text fail E.

The masks are counted where the rows are; from there on a part has 32 counts at most.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, join_counted, settle

FILTERS = "ABCDE"
#: Ends of the blocks that are hashed, in code points; what follows the last one is a block as well.
BLOCK_ENDS = (64, 1_024, 16_384)
#: Rows without an id are dealt out over so many values in the join with the labels.
SALTS = 4_096
BLANKS = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> Column:
    """Bits 1, 2, 4 and 8 for the filters A to D that a text, not null, fails.

    A: under 200 words; B: fewer than half of the words are distinct; C: over 2 % of the code points are
    A-Z; D: holds one of #$%&*|.  Without words, A alone is failed.
    """
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * upper.cast("long") > 2 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))


def block_hash(text: Column, start: int, end: int | None) -> Column:
    """A hash of the code points [start, end) of a text."""
    return F.xxhash64(F.substring(text, start + 1, (1 << 31) - 1 - start if end is None else end - start))


def _blocks(text: Column) -> dict[str, Column]:
    ends = [0, *BLOCK_ENDS, None]
    return {f"_h{k}": block_hash(text, a, b) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False))}


def later_copies(rows: DataFrame, texts: DataFrame, labelled: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``rows`` whose text a smaller id has.

    ``rows`` is settled and narrow: ``_id``, ``_n`` (code points), the block hashes, and others.  ``texts``
    makes the same rows, with ``_text`` and before ``labelled``; only classes that survive are compared.
    """
    columns, total, classes = rows.columns, rows.count(), ["_n"]
    hashes = [c for c in columns if c.startswith("_h")]
    for k in range(len(hashes) + 1):
        classes = ["_n", *hashes[:k]]
        sizes = settle(rows.groupBy(*classes).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1"))
        rows = settle(join_counted(rows, sizes, classes, "_rows", total, "left_semi").select(*columns))
    few = bounded_broadcast(sizes.select(*classes), sizes.count())
    same = texts.join(few, classes, "left_semi").groupBy(*classes, "_text").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    same = settle(same)
    found = same.groupBy(*classes).agg(F.count(F.lit(1)).alias("_texts"), F.min("_first").alias("_first"), F.sum("_rows").alias("_rows"))
    found = settle(found)
    out = join_counted(rows, found.where("_texts = 1"), classes, "_rows", total).select(*columns, "_first")
    mixed = found.where("_texts > 1").select(*classes)
    if not mixed.isEmpty():  # no hash has told these texts apart
        mixed = bounded_broadcast(mixed, mixed.count())
        split = texts.join(mixed, classes, "left_semi").join(same.join(mixed, classes, "left_semi").drop("_rows"), [*classes, "_text"])
        out = out.unionByName(labelled(split).select(*columns, "_first"))
    return out.where("_id > _first").select(*columns)


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the set of filters that they fail.

    Null text is empty, a null part the empty string.  A row without an id has no label, never fails E and
    makes no other row fail it; rows of one id don't make each other fail it.  An id is good (toxic) if any of
    its labels says quality = 1 (toxic = 1).  Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    texts = base.withColumns({"mask": text_failures(F.col("_text")), "_n": F.length("_text"), **_blocks(F.col("_text"))})
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(f"_{c}")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_key")).agg(one("quality"), one("toxic")).withColumn("_salt", F.lit(0))

    def labelled(df: DataFrame) -> DataFrame:
        # rows without an id meet no label, and are dealt out all the same
        salt = F.when(F.col("_id").isNull(), 1 + F.pmod(F.col("_h0"), F.lit(SALTS))).otherwise(0).cast("int")
        both = df.withColumns({"_key": F.coalesce("_id", F.lit(0)), "_salt": salt}).join(known, ["_key", "_salt"], "left")
        return both.drop("_key", "_salt").fillna(0, ["_quality", "_toxic"])

    rows = settle(labelled(texts.drop("_text")))
    keys = ["part", "mask", "_quality", "_toxic"]
    count = lambda df: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    later = settle(count(later_copies(rows, texts, labelled)))
    moved = later.withColumn("mask", F.col("mask") + 16).unionByName(later.withColumn("n", -F.col("n")))
    every = count(rows).unionByName(moved).groupBy("part", "mask")
    got = every.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("_quality")).alias("good"), F.sum(F.col("n") * F.col("_toxic")).alias("toxic"))
    return got.where("n > 0")


def _steps() -> str:
    """All orders of the filters, step by step: the filter's bit and the bits of those before it."""
    out = []
    for order in permutations(range(len(FILTERS))):
        for k, f in enumerate(order):
            out.append({"filter_order": "".join(FILTERS[i] for i in order), "step": k + 1, "bit": 1 << f, "before": sum(1 << i for i in order[:k])})
    return json.dumps(out)


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley); nulls
    and repeated ids as in ``masks``.  ``shapley`` is what the step's filter removes, at whatever step, summed
    over all orders: a document that fails m filters is removed by each of them in 120 / m orders.  Parts
    without a removal have their rows, too; an empty table has none.
    """
    orders = len(list(permutations(FILTERS)))
    sets = masks(docs, labels, id_col, text_col, part_col).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sets"))  # 32 at most
    kind = "array<struct<filter_order:string,step:int,bit:int,before:int>>"
    each = sets.select("part", "sets", F.inline(F.from_json(F.lit(_steps()), kind)))

    def total(value: str, test: str) -> Column:
        return F.expr(f"aggregate(filter(sets, s -> {test}), 0L, (t, s) -> t + {value})")

    here, gone = "(s.mask & bit) != 0 AND (s.mask & before) = 0", "(s.mask & bit) != 0 AND (s.mask & before) != 0"
    return each.select(
        "part", "filter_order", "step",
        total("s.n", "(s.mask & (before | bit)) = 0").alias("kept"), total("s.n", here).alias("removed"), total("s.n", gone).alias("redundant"),
        total("s.n", "s.mask = bit").alias("unique_fails"), total("s.good", here).alias("good_lost"), total("s.toxic", here).alias("toxic_lost"),
        total(f"s.n * ({orders} div bit_count(s.mask))", "(s.mask & bit) != 0").alias("shapley"),
    )


def oracle_sql() -> str:
    """The audit as SQL for DuckDB, with each order walked through and the copies found by a window."""
    word, fails = r"[^\x20\x09-\x0D]+", [f"f{k}" for k in FILTERS]
    bits = " + ".join(f"CASE WHEN {f} THEN {1 << k} ELSE 0 END" for k, f in enumerate(fails))
    return f"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents),
f AS (SELECT doc_id, part, len(ws) < 200 AS fA, 100*len(list_distinct(ws)) < 50*len(ws) AS fB, 100*len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2*len(t) AS fC,
  regexp_matches(t, '[#$%&*|]') AS fD, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS fE FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, {bits} AS mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
k AS (SELECT i, substr('{FILTERS}', i + 1, 1) AS name FROM range(0, {len(FILTERS)}) r(i)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order FROM k a JOIN k b ON b.i <> a.i JOIN k c ON c.i NOT IN (a.i, b.i) JOIN k d ON d.i NOT IN (a.i, b.i, c.i) JOIN k e ON e.i NOT IN (a.i, b.i, c.i, d.i)),
s AS (SELECT filter_order, step, 1 << (instr('{FILTERS}', substr(filter_order, step, 1)) - 1) AS bit,
  coalesce((SELECT sum(1 << (instr('{FILTERS}', substr(filter_order, j, 1)) - 1)) FROM range(1, 5) q(j) WHERE j < step), 0)::INT AS before FROM o, (SELECT generate_series::INT AS step FROM generate_series(1, 5)) x),
r AS (SELECT part, filter_order, step, bit,
  sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & bit <> 0 AND mask & before = 0) AS removed, sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0) AS redundant,
  sum(n) FILTER (mask = bit) AS unique_fails, sum(good) FILTER (mask & bit <> 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0) AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM r"""
