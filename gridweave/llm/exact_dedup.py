"""Exact dedup by deterministic block naming (operator 8), in DataFrame operations only.

Each lower-cased text is cut into blocks of a fixed number of characters.  Equal blocks get
equal integer names and different blocks different ones: a block whose hash no other row has
differs from all others, and the hash is its name; of the others the distinct ones are dealt
into buckets and sorted inside a bucket, and the name is ``rank * buckets + bucket``.  No name
depends on a hash being free of collisions: where different blocks have the same hash, rows
are named by their texts.  Neighbouring names are then paired, the distinct pairs are named in
the same way, and so on until a document has one name.  Documents that needed the same number
of blocks and have the same name are equal, and only they.

One scan lowers, cuts and hashes all texts into narrow rows.  Texts are read again only of
documents that may have a repeated block, and move once, as distinct blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, join_counted, store

BLOCK_CHARS = 4096
NAME_BUCKETS = 4096
#: 64-bit words of the bit set that rows are sifted by: at most so many rows are broadcast.
SIFT_WORDS = 1 << 18
_NO_ID = -(2**63)


def block_hash(*cols: Column | str) -> Column:
    """The hash that finds equal blocks; any function of the columns gives right results."""
    return F.xxhash64(*cols)


def _name(kind: int, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def _ranked(distinct: DataFrame, cols: list[str], buckets: int) -> DataFrame:
    """``distinct`` (_hash, cols) with the integer name of each row and the number of rows of its hash."""
    dealt = distinct.withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", *cols)).cast("long")
    dealt = dealt.withColumn("name", _name(1, rank * buckets + F.col("_bucket")))
    return dealt.withColumn("_like", F.count(F.lit(1)).over(Window.partitionBy("_bucket", "_hash"))).drop("_bucket")


def _sift(rows: DataFrame, by: Column, wanted: DataFrame) -> DataFrame:
    """``rows`` but those whose ``by``, a long, is surely not among ``wanted`` (one column, _x).

    A bit set of SIFT_WORDS words of 64 bits is broadcast, whatever the number of wanted values;
    the more there are, the more other rows stay.
    """
    place = lambda c: (F.pmod(F.xxhash64(c), F.lit(SIFT_WORDS)).cast("int").alias("_word"), F.pmod(F.hash(c), F.lit(64)).alias("_bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))
    words = wanted.select(*place(F.col("_x"))).groupBy("_word").agg(F.bit_or(one).alias("_bits"))
    kept = rows.select("*", *place(by)).join(F.broadcast(words), "_word")
    return kept.where(F.getbit("_bits", F.col("_bit")) == 1).drop("_word", "_bit", "_bits")


def _named(rows: DataFrame, cols: list[str], buckets: int, total: int) -> DataFrame:
    """``rows`` with an integer name, (kind, value), for the value of the narrow columns ``cols``, which go."""
    rows = store(rows.withColumn("_hash", block_hash(*cols)))
    again = store(rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    tagged = join_counted(rows, again, ["_hash"], "_n", total, "left")
    rest = [c for c in rows.columns if c not in (*cols, "_hash")]
    single = tagged.where("_n IS NULL").select(*rest, _name(0, F.col("_hash")).alias("name"))
    many = tagged.where("_n > 1").drop("_n")
    each = many.groupBy("_hash", *cols).agg(F.count(F.lit(1)).alias("_n"))
    named = join_counted(many, store(_ranked(each, cols, buckets).drop("_like")), ["_hash", *cols], "_n", total)
    return store(single.unionByName(named.select(*rest, "name")))


def _block_names(docs: DataFrame, block_chars: int, buckets: int) -> tuple[DataFrame, int]:
    """(doc_id, key, sha, n_blocks, pos, name) of every block of ``docs`` (doc_id, text), and their number."""
    base = docs.select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("key"), ascii_lower(F.coalesce("text", F.lit(""))).alias("low"))
    # one pass over the text cuts it; a substring for each block would begin at the first character each time
    cut = F.when(F.col("low") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("low", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))
    hashed = base.select("doc_id", "key", F.sha2("low", 256).alias("sha"), cut.alias("all"))
    hashed = hashed.select("doc_id", "key", "sha", F.size("all").alias("n_blocks"), F.transform("all", lambda b: block_hash(b)).alias("hashes"))
    blocks = store(hashed.select("doc_id", "key", "sha", "n_blocks", F.posexplode("hashes").alias("pos", "_hash")))
    total = blocks.count()
    again = store(blocks.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))

    def texts(hashes: DataFrame) -> DataFrame:
        """(doc_id, key, sha, n_blocks, pos, block, _hash), in which no block with one of ``hashes`` lacks."""
        which = join_counted(blocks, hashes, ["_hash"], "_n", total, "left_semi").select(F.col("key").alias("_x"))
        # sifted by id before the texts are lowered and cut, and by block after it
        some = _sift(docs, F.coalesce("doc_id", F.lit(_NO_ID)), which)
        some = some.select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("key"), ascii_lower(F.coalesce("text", F.lit(""))).alias("low"))
        some = some.select("doc_id", "key", F.sha2("low", 256).alias("sha"), cut.alias("all")).withColumn("n_blocks", F.size("all"))
        some = some.select("doc_id", "key", "sha", "n_blocks", F.posexplode("all").alias("pos", "block")).withColumn("_hash", block_hash("block"))
        return _sift(some, F.col("_hash"), hashes.select(F.col("_hash").alias("_x")))

    each = texts(again).select("_hash", "block").groupBy("_hash", "block").agg(F.lit(1).alias("_one"))
    each = _ranked(each, ["block"], buckets)
    each = store(each.select("_hash", "name", "_like", F.when(F.col("_like") > 1, F.col("block")).alias("block")))
    # a repeated hash of one block names it; the rows of a hash that blocks share are named by their texts
    names = store(again.join(each.groupBy("_hash").agg(F.max("_like").alias("_like"), F.max("name").alias("name")), "_hash"))
    tagged = join_counted(blocks, names, ["_hash"], "_n", total, "left")
    out = ["doc_id", "key", "sha", "n_blocks", "pos", "name"]
    named = tagged.where("_like IS NULL OR _like = 1").withColumn("name", F.coalesce("name", _name(0, F.col("_hash"))))
    named = named.select(*out)
    shared = names.where("_like > 1").select("_hash", "_n")
    if not shared.isEmpty():
        named = named.unionByName(texts(shared).join(each.where("_like > 1"), ["_hash", "block"]).select(*out))
    return store(named), total


def block_identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, buckets: int = NAME_BUCKETS) -> DataFrame:
    """(doc_id, sha, n_blocks, name) of every row: with ``n_blocks`` the text's collision-free identity.

    ``sha`` is the digest of the lowered text.  Null text counts as empty.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named, total = _block_names(docs, block_chars, buckets)
    whole = named.where("n_blocks = 1").select("doc_id", "sha", "n_blocks", "name")
    # longer texts by id and text; rows that repeat both are counted and meet their name at the end
    rows = named.where("n_blocks > 1 AND pos = 0").select("doc_id", "key", "sha")
    left = named.where("n_blocks > 1").withColumn("n", F.col("n_blocks")).drop("doc_id")
    most = left.agg(F.max("n_blocks")).first()[0] or 1
    if most == 1:
        return whole
    done = None
    while most > 1:
        pair = F.struct("pos", "name")
        halves = left.groupBy("key", "sha", "n_blocks", "n", F.floor(F.col("pos") / 2).cast("int").alias("half"))
        two = halves.agg(F.min(pair).alias("a"), F.max(pair).alias("b"))
        two = two.select("key", "sha", "n_blocks", ((F.col("n") + 1) / 2).cast("int").alias("n"), F.col("half").alias("pos"), F.col("a.name").alias("a"), F.when(F.col("b.pos") > F.col("a.pos"), F.col("b.name")).otherwise(_name(-1, F.lit(0).cast("long"))).alias("b"))
        left = _named(two, ["a", "b"], buckets, total)
        ended = left.where("n = 1").select("key", "sha", "n_blocks", "name")
        done = done.unionByName(ended) if done else ended
        left, most = left.where("n > 1"), (most + 1) // 2
    found = done.join(rows.groupBy("key", "sha").agg(F.count(F.lit(1)).alias("_n")), ["key", "sha"])
    longer = join_counted(rows, store(found), ["key", "sha"], "_n", total)
    return whole.unionByName(longer.select("doc_id", "sha", "n_blocks", "name"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, buckets: int = NAME_BUCKETS) -> DataFrame:
    """One row per input row: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after lower-casing A-Z; null text equals the empty text.
    Of a group the row with the largest id stays; a null id is less than any other, and rows
    that repeat the staying id stay with it.  Other columns of the input are ignored.  An
    empty input gives an empty result.
    """
    rows = store(block_identities(docs, id_col, text_col, block_chars, buckets).withColumnRenamed("sha", "text_sha256"))
    groups = rows.groupBy("n_blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    out = join_counted(rows, store(groups), ["n_blocks", "name"], "group_size", rows.count())
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
