"""Balanced label propagation over documents that are linked (operator 13), in DataFrame operations only.

Documents that belong together, here those of equal text, are to stand in one shard, and shards are to be
even.  Each document begins in a shard by its hash.  A round joins the cells (group, shard, weight)
to the shard in which their group has most, which their documents ask to go to.  Quotas keep shards within
capacity: between two shards as much may go one way as comes the other way, and what room a shard has left is
shared out among the others that ask for it.  Asks of the heaviest neighbours are met first; a cell
may move in part.  Quotas are worked out on a table of shards, shards and gains, which the input
does not make larger, so rounds move no rows but cells, of which a group has one a shard at most.

After the rounds a group that a shard can hold goes as a whole where it has most, documents without links, which no
edge holds back, go where room is left, and a last step makes the shards exactly even: documents in order of
shard and group are cut into runs of equal weight.  So one group at a cut is split at most, besides those
that are larger than a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, settle

SHARDS = 24
#: Rounds at most; it ends when nothing moves.
ROUNDS = 6
#: Bytes that a document has besides its text.
ROW_BYTES = 8


def _fraction(*cols: Column) -> Column:
    """A number in [0, 1) for each value."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _quotas(asks: DataFrame, room: DataFrame) -> DataFrame:
    """(from, to, gain, part): the part of the asks of a pair of shards and a gain that is granted.

    ``asks`` has (from, to, gain, want), a row for each; ``room`` (to, room).  Both are as small as the number of shards.
    """
    pairs = asks.groupBy("from", "to").agg(F.sum("want").alias("want"))
    back = pairs.select(F.col("from").alias("to"), F.col("to").alias("from"), F.col("want").alias("back"))
    pairs = pairs.join(back, ["from", "to"], "left").withColumn("swap", F.least("want", F.coalesce("back", F.lit(0))))
    pairs = pairs.join(room, "to").withColumn("more", F.col("want") - F.col("swap"))
    share = F.col("room") * F.col("more") / F.greatest(F.sum("more").over(Window.partitionBy("to")), F.lit(1))
    pairs = pairs.select("from", "to", (F.col("swap") + F.least(F.floor(share), F.col("more"))).alias("quota"))
    before = F.coalesce(F.sum("want").over(Window.partitionBy("from", "to").orderBy(F.desc("gain")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("quota") - before) / F.col("want")))
    return asks.join(pairs, ["from", "to"]).select("from", "to", "gain", part.alias("part")).where("part > 0")


def propagate(cells: DataFrame, capacity: int, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """(group, shard, w) after label propagation; ``cells`` has the same columns, each group and shard once."""
    cells = settle(cells)
    every = cells.sparkSession.range(shards).select(F.col("id").cast("int").alias("to"))
    for turn in range(rounds):
        best = cells.groupBy("group").agg(F.max(F.struct("w", F.xxhash64("group", "shard").alias("tie"), "shard")).alias("best"))
        asks = cells.join(best, "group").where(F.col("shard") != F.col("best.shard"))
        asks = settle(asks.select("group", F.col("shard").alias("from"), F.col("best.shard").alias("to"), "w", F.floor(F.log2(F.col("best.w"))).cast("int").alias("gain")))
        held = cells.groupBy(F.col("shard").alias("to")).agg(F.sum("w").alias("held"))
        room = every.join(held, "to", "left").select("to", F.greatest(F.lit(0), F.lit(capacity) - F.coalesce("held", F.lit(0))).alias("room"))
        quotas = F.broadcast(settle(_quotas(asks.groupBy("from", "to", "gain").agg(F.sum("w").alias("want")), room)))  # shards * shards * 64 rows at most
        met = asks.join(quotas, ["from", "to", "gain"])
        some = F.col("w") * F.col("part")
        # a large cell moves in part, a small one as a whole or not at all
        moved = F.when(some >= 64, F.floor(some)).when(_fraction("group", "from", F.lit(turn)) < F.col("part"), F.col("w")).otherwise(0)
        moved = settle(met.select("group", "from", "to", moved.cast("long").alias("w")).where("w > 0"))
        if moved.isEmpty():
            break
        gone = moved.select("group", F.col("from").alias("shard"), (-F.col("w")).alias("w"))
        come = moved.select("group", F.col("to").alias("shard"), "w")
        cells = settle(cells.unionByName(gone).unionByName(come).groupBy("group", "shard").agg(F.sum("w").alias("w")).where("w > 0"))
    return cells


def _by_weight(u: Column, parts: Column) -> Column:
    """The shard of the part (shard, w) of an array in which the fraction ``u`` of its weight lies."""
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda t, p: t + p["w"])
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("int").alias("shard"))
    step = lambda t, p: F.struct((t["sum"] + p["w"]).alias("sum"), F.when(t["shard"].isNull() & (u * total < t["sum"] + p["w"]), p["shard"]).otherwise(t["shard"]).alias("shard"))
    return F.coalesce(F.aggregate(parts, start, step)["shard"], F.element_at(parts, -1)["shard"])


def _cut(rows: DataFrame, order: list[str], shards: int, law: str) -> DataFrame:
    """``rows`` with shard and slot: in ``order``, cut into runs of equal weight.

    Rows are dealt by ranges, sorted and counted there, so that a row's place among all is known without one
    task having them all.
    """
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    rows = settle(rows.withColumns({"_pid": F.shiftright("_m", 33), "_low": F.col("_m").bitwiseAND((1 << 33) - 1)}))
    found = rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"), F.sum("size").alias("_b"))  # a row for each range
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    found = F.broadcast(settle(found.select("_pid", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c0"), F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"))))
    placed = rows.join(found, "_pid").withColumn("_at", F.col("_low") + F.col("_c0"))
    n, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    if law == "rows":
        shard = F.expr(f"((_at + 1) * {shards} - 1) div {max(1, n)}")
        return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_at") - F.expr(f"(shard * {n}L) div {shards}"))
    through = F.sum("size").over(Window.partitionBy("_pid").orderBy("_low")) + F.col("_b0")
    middle = 2 * through - F.col("size")  # twice the weight up to the middle of the row
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(2.0 * (total or 1)))).cast("int"))
    first = placed.groupBy("shard").agg(F.min("_at").alias("_start"))
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("_at") - F.col("_start"))


def shard(docs: DataFrame, shards: int = SHARDS, law: str = "rows", rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    ``law`` "rows": shards have the same number of rows, or one more; "bytes": the same size, but for half a row at
    either end.  Documents of equal text, which belong together, are in one shard unless they are more than it
    holds or a cut falls among them.  Size counts the UTF-8 bytes of the text and 8; null text is empty and equals
    the empty text.  Rows that repeat an id, or have none, are rows each.  ``slot`` counts a shard's rows
    from 0.  ``grown_shard`` is null under either law.  Other columns are ignored; an empty table gives
    an empty result, and fewer rows than shards leave shards empty.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"law {law!r} is not known")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group"))
    base = settle(base.withColumn("_row", F.monotonically_increasing_id()))
    weight = F.lit(1).cast("long") if law == "rows" else F.col("size")
    total = base.agg(F.sum(weight)).first()[0] or 0
    start = F.pmod(F.xxhash64("doc_id", "group", "_row"), F.lit(shards)).cast("int").alias("shard")
    cells = settle(base.groupBy("group", start).agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("_n")))
    linked = settle(cells.groupBy("group").agg(F.sum("_n").alias("_n")).where("_n > 1"))
    capacity = -(-total // shards)
    cells = propagate(cells.join(linked.select("group"), "group", "left_semi").select("group", "shard", "w"), capacity, shards, rounds)
    held = {r["shard"]: r["w"] for r in cells.groupBy("shard").agg(F.sum("w").alias("w")).collect()}  # a row for each shard
    room = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(max(0, total // shards - held.get(s, 0)) + 1).cast("long").alias("w")) for s in range(shards)])
    parts = cells.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("w", "shard")), asc=False).alias("parts"), F.sum("w").alias("w"))  # as many as shards at most
    whole = F.when(F.col("w") <= capacity, F.slice("parts", 1, 1)).otherwise(F.col("parts"))
    places = settle(linked.join(parts.select("group", whole.alias("parts")), "group"))
    u = _fraction(F.col("doc_id"), F.col("_row"), F.lit("place"))
    count = base.count()
    together = join_counted(base, places, ["group"], "_n", count).withColumn("label", _by_weight(u, F.col("parts"))).withColumn("kind", F.lit(1))
    free = base.join(linked.select("group"), "group", "left_anti").withColumn("label", _by_weight(u, room))
    # documents without links stand at both ends of a shard, where cuts fall
    free = free.withColumn("kind", F.when(_fraction(F.col("group"), F.lit("end")) < 0.5, 0).otherwise(2))
    cols = ["doc_id", "size", "text_crc32", "group", "_row", "label", "kind"]
    done = _cut(together.select(*cols).unionByName(free.select(*cols)), ["label", "kind", "group", "doc_id", "_row"], shards, law)
    return done.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
