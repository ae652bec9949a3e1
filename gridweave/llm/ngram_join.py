"""Exact Jaccard join of documents on word n-grams (operator 4), by set relations.

Documents with equal sets form a class, and the join runs over one representative of each.  Sets
that are too small to link with a different one take no further part.

Index.  A range of sizes cuts the hashes of shingles into parts, and a set into as many tokens: what
it has in a part, as one hash.  A shingle that only one of two sets has changes one token, so two sets
that link, of which at most d shingles are in one set only, differ in d tokens at most; so they share
one of the first d + 1 in any order of tokens.  There are more parts than that, and first come tokens
that a sample of the documents doesn't show to be frequent, those of most shingles first: a token is
several shingles and has no other ones beside them, so next to nothing but near copies shares it.
Tokens of empty parts come last.  The sample decides on the order only: any order finds all links.
A pair meets in the range of its larger set; a set that may be the smaller one of a pair in the next range
is in both.  Tokens that one set only has are left out.

* A long list has a pivot, and all its sets are compared with it only.  It is the one whose
  lists are longest, by a vote of the list's sets, so that the lists of a group of near copies have the same one,
  from its middle, whether or not it is in the list.
  What a set lacks (R) and adds (A) against the pivot gives its answers from the pivot's: with
  cost c = den*|R| + num*|A| and s = |R∩R'| + |A∩A'|, two sets link exactly if
  (den+num)*s >= c + c' - (den-num)*|pivot|.  Sets with c <= (den-num)*|pivot| link to the pivot;
  any other link has s > 0, so it is found by a join on the elements of R and A, again on
  prefixes only: the costlier set looks for the other one, whose prefix is the shorter for it.
  A group of near copies thus needs a number of comparisons in proportion to
  its size, and only pairs of which one is not linked to the pivot are ever made.
* Sets far from their pivot get another one, PIVOTS in all and LEVELS more in lists that are longer than
  a block.  What is left gets a last one, and the join on elements of R and A finds its links, however far the
  sets are from it: the elements are counted, so those that only a few have come first.

Parity bitmaps give a bound on the overlap that drops most pairs before their sets are
compared; then the exact overlap decides.  Sets are of 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_PARTS, bounded_broadcast, mix, settle, slices, texts, word_hashes

#: Lists up to this length are paired directly.
SHORT_LIST = 4
#: Pivots that a long list gets.
PIVOTS = 2
#: Pivots that a list gets beyond those if it is still longer than a block.
LEVELS = 2
#: Parts, as a multiple of the tokens that a range's largest sets need.
SPARE = 1.6
#: Ranges that begin up to this size have twice as many parts: chance leaves more of theirs empty.
SMALL_SET = 64
#: Lists up to this length get no more pivots than PIVOTS and the last one.
BLOCK = 256
#: Documents, about, that show which tokens are frequent; as many of them as make a token so; such tokens at most.
SAMPLE, FREQUENT, MOST = 20_000, 4, 50_000
_PART = np.uint64(0x5851F42D4C957F2D)
Frequent = tuple[np.ndarray, np.ndarray]


def shingle_hashes(data: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of many texts, with repetitions, and the n+1 offsets of the documents."""
    h, d = word_hashes(data, offs, "blank")
    first = np.searchsorted(d, np.arange(offs.size))
    n = np.diff(first)
    short = (n > 0) & (n < words)
    out = np.zeros(h.size, np.uint64)
    for k in range(words):
        end = max(0, h.size - k)  # fewer words than k: not a slice from the back
        out[:end] = mix(out[:end] * np.uint64(0x9E3779B97F4A7C15) + h[k:])
    left = first[1:][d] - np.arange(h.size)
    keep = left >= words
    if short.any():  # the whole sequence is the one shingle
        for k in np.flatnonzero(short):
            x = np.uint64(n[k])
            for w in h[first[k] : first[k + 1]]:
                x = mix(np.array([x]) * np.uint64(0xD6E8FEB86659FD93) + w)[0]
            out[first[k]] = x
            keep[first[k]] = True
    return out[keep], np.searchsorted(d[keep], np.arange(offs.size))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.astype(np.uint64).view(np.int64)))


def _bitmap(s: np.ndarray) -> np.ndarray:
    bits = 1 << min(16, max(8, int(4 * s.size - 1).bit_length()))
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def part_tokens(s: np.ndarray, size: np.ndarray, num: int, den: int, frequent: Frequent, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(set, token) of the tokens by which sets are found; ``s`` has the sorted sets one after another, of
    ``size`` shingles each, ``frequent`` the tokens that come late, ascending, and how often each was seen.  ``every``: the tokens of all parts, in any order."""
    n = size.astype(np.int64)
    up = den * n // num  # the largest set that it may link with
    able = (den - num) * n >= num
    low, high = np.frexp(n)[1] - 1, np.frexp(up)[1] - 1
    owner = np.repeat(np.arange(n.size), n)
    mixed = mix(s ^ _PART)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for step in range(int((high - low)[able].max(initial=-1)) + 1):
        use = able & (low + step <= high)
        g = low + step  # the range of the larger set's size: 2^g up to 2^(g+1) - 1
        parts = np.ceil(SPARE * (den - num) / num * np.exp2(g + 1) * np.where(np.exp2(g) <= SMALL_SET, 2, 1)).astype(np.int64) + 1
        differ = (den - num) * (n + np.minimum(up, (np.int64(2) << g) - 1)) // (den + num)
        own = use[owner]
        o, x, v = owner[own], s[own], mixed[own]
        part = ((x >> np.uint64(32)) * parts[o].astype(np.uint64)) >> np.uint64(32)
        new = np.ones(o.size, bool)
        new[1:] = (o[1:] != o[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(new)
        if not at.size:
            continue
        d, part, held = o[at], part[at], np.diff(np.append(at, o.size))
        name = lambda k, g: mix((k << np.uint64(6)) + g.astype(np.uint64) + np.uint64(1 << 60))
        token = mix(np.add.reduceat(v, at) + name(part, g[d]))
        if every:
            out.append((d, token))
            continue
        lacks = [(k, np.setdiff1d(np.arange(parts[k]).astype(np.uint64), part[d == k])) for k in np.flatnonzero(use & (np.bincount(d, minlength=n.size) <= differ))]
        for k, empty in lacks:
            token = np.append(token, mix(name(empty, g[k])))
            d, held = np.append(d, np.full(empty.size, k)), np.append(held, np.zeros(empty.size, np.int64))
        often = np.zeros(token.size, np.int64)
        if frequent[0].size:
            place = np.minimum(np.searchsorted(frequent[0], token), frequent[0].size - 1)
            often = np.where(frequent[0][place] == token, frequent[1][place], 0)
        order = np.lexsort((token, -held, often, held == 0, d))
        d, token = d[order], token[order]
        keep = np.arange(d.size) - np.searchsorted(d, d) <= differ[d]
        out.append((d[keep], token[keep]))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _frequent(docs: DataFrame, words: int, num: int, den: int) -> Frequent:
    """Tokens that several documents of a sample have, ascending, and their counts there.

    Those of all parts count: which of them come first is known only afterwards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in slices(batches, "text"):
            h, offs = shingle_hashes(*texts(b.column("text")), words)
            sets = [np.unique(h[a:e]) for a, e in zip(offs, offs[1:], strict=False)]
            token = part_tokens(np.concatenate(sets), np.array([s.size for s in sets]), num, den, none, every=True)[1]
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64))], ["token"])

    some = docs.sample(min(1.0, SAMPLE / max(1, docs.count())), seed=1).select("text").mapInArrow(run, "token long")
    seen = some.groupBy("token").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= FREQUENT).orderBy(F.desc("times"), "token").limit(MOST).collect()
    token, times = np.array([r.token for r in seen], np.int64).view(np.uint64), np.array([r.times for r in seen], np.int64)
    order = np.argsort(token)
    return token[order], times[order]


def _described(docs: DataFrame, words: int, num: int, den: int, frequent: Frequent) -> DataFrame:
    """(id, n, sig1, sig2, tokens, bitmap) of each document; ``docs`` has id and text.

    A set that cannot link with a different one has no tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            h, offs = shingle_hashes(*texts(b.column("text")), words)
            sets = [np.unique(h[a:e]) for a, e in zip(offs, offs[1:], strict=False)]
            size = np.array([s.size for s in sets], np.int64)
            sums = [(int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ _PART).sum(dtype=np.uint64))) for s in sets]
            sig = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
            doc, token = part_tokens(np.concatenate(sets), size, num, den, frequent)
            order = np.argsort(doc, kind="stable")
            tokens = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[order], np.arange(size.size + 1)).astype(np.int32)), pa.array(token[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(size), pa.array(sig[:, 0]), pa.array(sig[:, 1]), tokens, _lists([_bitmap(s) if s.size else s for s in sets])],
                ["id", "n", "sig1", "sig2", "tokens", "bitmap"],
            )

    return docs.select("id", "text").mapInArrow(run, "id long, n long, sig1 long, sig2 long, tokens array<long>, bitmap array<long>")


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, set) of the documents in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            h, offs = shingle_hashes(*texts(b.column("text")), words)
            yield pa.RecordBatch.from_arrays([b.column("id"), _lists([np.unique(h[a:e]) for a, e in zip(offs, offs[1:], strict=False)])], ["id", "set"])

    ids = settle(ids.distinct())
    few = docs.select("id", "text").join(bounded_broadcast(ids, ids.count()), "id", "left_semi")
    return few.mapInArrow(run, "id long, set array<long>")


def _half(c: Column) -> Column:
    m = (F.size(c) / 2).cast("int")
    return F.zip_with(F.slice(c, F.lit(1), m), F.slice(c, m + 1, m), lambda x, y: x.bitwiseXOR(y))


def _distance(a: Column, b: Column) -> Column:
    """Hamming distance of parity bitmaps, the longer one folded: at most the sets' difference."""
    bits = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), bits(a, b)).when(F.size(a) == 2 * F.size(b), bits(_half(a), b)).when(F.size(b) == 2 * F.size(a), bits(a, _half(b))).otherwise(F.lit(0))


def _linked(inter: Column, n: Column, m: Column, num: int, den: int) -> Column:
    return den * inter >= num * (n + m - inter)


def _shared(reps: DataFrame, frequent: Frequent) -> DataFrame:
    """(token, id, n, cnt): the tokens that ``cnt`` sets have, two at least."""
    every = reps.select(F.explode("tokens").alias("token"), "id", "n")
    # The most frequent ones are counted before they move, and stay where they are; a window counts the others.
    top = np.sort(frequent[0][np.argsort(-frequent[1], kind="stable")[: HOT_PARTS - 1]].view(np.int64))
    often = F.broadcast(reps.sparkSession.createDataFrame([(int(x),) for x in top], "token long"))
    hot = every.join(often, "token", "left_semi")
    hot = hot.join(F.broadcast(hot.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))), "token")
    cold = every.join(often, "token", "left_anti").withColumn("cnt", F.count(F.lit(1)).over(Window.partitionBy("token")))
    return hot.unionByName(cold).where("cnt > 1")


def _short_pairs(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, na, b, nb) of short lists; ``all`` has (n, id) by size."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("all").value_lengths().to_numpy(zero_copy_only=False)
            flat = b.column("all").flatten()
            n, ids = (flat.field(k).to_numpy() for k in ("n", "id"))
            left = np.repeat(np.cumsum(size), size) - np.arange(n.size)  # entries of the list from here on
            out = []
            for gap in range(1, int(size.max(initial=0))):
                i = np.flatnonzero(left > gap)
                j = i + gap
                ok = num * n[j] <= den * n[i]
                out.append((i[ok], j[ok]))
            i, j = (np.concatenate([np.zeros(0, np.int64), *(o[k] for o in out)]) for k in range(2))
            yield _pairs(ids, n, i, ids, n, j)

    return lists.mapInArrow(pair, "a long, na long, b long, nb long")


def _pairs(ids: np.ndarray, n: np.ndarray, i: np.ndarray, ids2: np.ndarray, n2: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Pairs (a, na, b, nb), the lesser id first."""
    x, y, nx, ny = ids[i], ids2[j], n[i], n2[j]
    swap = x > y
    cols = [np.where(swap, y, x), np.where(swap, ny, nx), np.where(swap, x, y), np.where(swap, nx, ny)]
    keep = x != y
    return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], ["a", "na", "b", "nb"])


def _with(pairs: DataFrame, side: DataFrame, value: str) -> DataFrame:
    """``pairs``, which are settled, with the value of a and of b, as a_value and b_value.

    Few pairs are broadcast to the values, so that only the values of paired documents move: those
    of a once for each pair, those of b once for each b.
    """
    n = pairs.count()

    def of(end: str) -> DataFrame:
        ids = bounded_broadcast(pairs.select(F.col(end).alias("id")).distinct(), n)
        return side.select("id", value).join(ids, "id", "left_semi").select(F.col("id").alias(end), F.col(value).alias(f"{end}_{value}"))

    return bounded_broadcast(pairs, n).join(of("a"), "a").join(of("b"), "b")


def _pivots(long: DataFrame) -> DataFrame:
    """(token, pivot, pivot_n) of each list.

    A set prefers, of those whose lists are longest in its lists, the one whose are longest of all, and a list takes what
    most of its sets prefer, in the list or not: so the middle of a group of near copies is the pivot of all its lists,
    also of those that its own prefix doesn't reach.
    """
    weight = long.groupBy("id").agg(F.sum("cnt").alias("weight"))
    best = settle(long.join(weight, "id").groupBy("token").agg(F.max(F.struct("weight", -F.col("id"), "id", "n")).alias("p")))
    liked = long.join(bounded_broadcast(best, best.count()), "token").groupBy("id", "n").agg(F.max("p").alias("p"))
    votes = long.join(liked, ["id", "n"]).groupBy("token", "p").agg(F.count(F.lit(1)).alias("votes"))
    most = votes.groupBy("token").agg(F.max(F.struct("votes", "p")).alias("v"))
    return most.select("token", F.col("v.p.id").alias("pivot"), F.col("v.p.n").alias("pivot_n"))


def _star(long: DataFrame) -> DataFrame:
    """(a, na, b, nb): each set with the pivots of its lists."""
    return long.where("id != pivot or n != pivot_n").select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("pivot").alias("b"), F.col("pivot_n").alias("nb")).distinct()


def _differences(docs: DataFrame, star: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(a, na, b, nb, like, cost, diff) of sets and their pivots in ``star``, which is settled."""
    found = _with(star, settle(_sets(docs, star.select(F.explode(F.array("a", "b")).alias("id")), words)), "set")
    found = found.where((F.size("a_set") == F.col("na")) & (F.size("b_set") == F.col("nb")))  # an id may have several sets
    found = found.select("a", "na", "b", "nb", F.array_except("b_set", "a_set").alias("less"), F.array_except("a_set", "b_set").alias("more"))
    inter = F.col("nb") - F.size("less")
    like = inter / (F.col("na") + F.col("nb") - inter)
    found = found.withColumn("like", like).withColumn("cost", den * F.size("less") + num * F.size("more"))
    return found.select("a", "na", "b", "nb", "like", "cost", F.concat("less", "more").alias("diff"))


def links(docs: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Members (id, n, rep) and enough links (a, b) between representatives to connect every
    two that are connected by links; each is a link.  ``docs`` has id and text, no nulls."""
    frequent = _frequent(docs, words, num, den)
    base = settle(_described(docs, words, num, den, frequent))
    sig = ["sig1", "sig2", "n"]
    classes = base.where("n > 0").groupBy(*sig).agg(F.min("id").alias("rep"))
    members = base.select("id", *sig).join(classes, sig, "left").select("id", *sig, F.coalesce("rep", "id").alias("rep"))
    members = settle(members)
    copies = members.where("id != rep").select("id", *sig)
    copies = bounded_broadcast(copies, copies.count())
    reps = base.where(f"n > 0 and {den - num} * n >= {num}").join(copies, ["id", *sig], "left_anti")
    bitmaps = reps.select("id", "bitmap")
    hits = settle(_shared(reps, frequent))

    near = max(1 - 3 * (1 - num / den), 0.5)
    zone = near - (1 - num / den)
    short: list[DataFrame] = []
    left: list[DataFrame] = []
    stars: list[DataFrame] = []
    around: list[DataFrame] = []
    for turn in range(PIVOTS + LEVELS + 1):
        if turn:
            counts = entries.groupBy("token").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")
            hits = settle(entries.join(counts, "token"))
        short.append(hits.where(F.col("cnt") <= SHORT_LIST).select("token", "n", "id"))
        long = hits.where(F.col("cnt") > SHORT_LIST)
        if turn >= PIVOTS:
            done_with = (F.col("cnt") <= BLOCK) | F.lit(turn == PIVOTS + LEVELS)
            left.append(long.where(done_with).select("token", "n", "id", "cnt"))
            long = long.where(~done_with)
        if long.isEmpty():
            break
        stats = settle(_pivots(long))
        long = settle(long.join(bounded_broadcast(stats, stats.count()), "token"))
        star = _star(long)
        for s in stars:  # compared before
            star = star.join(s, ["a", "na", "b", "nb"], "left_anti")
        star = settle(star)
        stars.append(star)
        # what is surely far from its pivot needs no sets
        close = _with(star, bitmaps, "bitmap")
        bound = (F.col("na") + F.col("nb") - _distance(F.col("a_bitmap"), F.col("b_bitmap"))) / 2
        close = settle(close.where(bound >= zone * (F.col("na") + F.col("nb") - bound)).select("a", "na", "b", "nb"))
        found = settle(_differences(docs, close, words, num, den).where(F.col("like") >= zone))
        around.append(found)
        done = reduce(DataFrame.unionByName, around).where(F.col("like") >= near).select(F.col("a").alias("id"), F.col("na").alias("n"), F.col("b").alias("pivot"), F.col("nb").alias("pivot_n"))
        far = long.where("id != pivot or n != pivot_n").join(done, ["id", "n", "pivot", "pivot_n"], "left_anti")
        entries = settle(far.select("token", "id", "n"))
        if entries.isEmpty():
            break

    lists = reduce(DataFrame.unionByName, short).groupBy("token").agg(F.sort_array(F.collect_list(F.struct("n", "id"))).alias("all"))
    every = _short_pairs(lists.select("all"), num, den)
    if left:
        rest = settle(reduce(DataFrame.unionByName, left))
        if not rest.isEmpty():
            # whatever is not like its pivot is found by differences, too
            stats = settle(_pivots(rest))
            star = _star(rest.join(bounded_broadcast(stats, stats.count()), "token"))
            for s in around:
                star = star.join(s, ["a", "na", "b", "nb"], "left_anti")
            around.append(settle(_differences(docs, settle(star), words, num, den)))
    if around:
        found = reduce(DataFrame.unionByName, around)
        every = every.unionByName(_by_differences(found, num, den))
    bound = (F.col("na") + F.col("nb") - _distance(F.col("a_bitmap"), F.col("b_bitmap"))) / 2
    likely = _with(settle(every.distinct()), bitmaps, "bitmap").where(_linked(bound, F.col("na"), F.col("nb"), num, den))
    likely = settle(likely.select("a", "na", "b", "nb"))
    exact = _with(likely, settle(_sets(docs, likely.select(F.explode(F.array("a", "b")).alias("id")), words)), "set")
    edges = exact.where(_linked(F.size(F.array_intersect("a_set", "b_set")), F.size("a_set"), F.size("b_set"), num, den)).select("a", "b")
    if around:
        edges = edges.unionByName(found.where(F.col("cost") <= (den - num) * F.col("nb")).select("a", "b"))
    return members, edges.distinct()


def _by_differences(found: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs around one pivot of which at least one isn't linked to it and that may link.

    The costlier set of a pair isn't linked to the pivot.  It looks for the other one by all elements that may be the first
    that they share; the other one, since its partner costs as much at least, is found by fewer.
    """
    cost, free = F.col("cost"), (den - num) * F.col("nb")
    out = cost > free
    prefix_for = lambda least: F.size("diff") - F.ceil(least / F.lit(float(den + num))).cast("int") + 1
    rows = found.select("a", "na", "b", "nb", "cost", "diff", out.alias("out"), prefix_for(F.greatest(cost, free + 1) + cost - free).alias("keep"), F.when(out, prefix_for(cost - free)).otherwise(0).alias("look"))
    rows = rows.where("keep > 0 or look > 0")
    each = rows.select("a", "na", "b", "nb", F.greatest("keep", "look").alias("most"), "out", F.explode("diff").alias("element"))
    counts = each.groupBy("b", "nb", "element").agg(F.count(F.lit(1)).alias("cnt"), F.max("out").alias("any_out"))
    ordered = each.join(counts, ["b", "nb", "element"]).groupBy("a", "na", "b", "nb", "most").agg(F.sort_array(F.collect_set(F.struct("cnt", "element", "any_out"))).alias("all"))
    prefix = ordered.select("a", "na", "b", "nb", F.posexplode(F.slice("all", F.lit(1), F.col("most"))).alias("at", "e")).where("e.cnt > 1 and e.any_out")
    prefix = prefix.join(rows.select("a", "na", "b", "nb", "cost", "keep", "look", F.size("diff").alias("size")), ["a", "na", "b", "nb"]).withColumn("element", F.col("e.element")).withColumn("rest", F.col("size") - F.col("at"))
    one = prefix.where("at < look").select("b", "element", "nb", *[F.col(c).alias(f"x_{c}") for c in ("a", "na", "cost", "rest")])
    two = prefix.where("at < keep").select("b", "nb", "element", *[F.col(c).alias(f"y_{c}") for c in ("a", "na", "cost", "rest")])
    room = (den + num) * F.least("x_rest", "y_rest") >= F.col("x_cost") + F.col("y_cost") - (den - num) * F.col("nb")
    turn = (F.col("x_cost") > F.col("y_cost")) | ((F.col("x_cost") == F.col("y_cost")) & (F.col("x_a") < F.col("y_a")))
    pairs = one.join(two, ["b", "nb", "element"]).where(room & turn)
    first = F.col("x_a") < F.col("y_a")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return pairs.select(pick("x_a", "y_a").alias("a"), pick("x_na", "y_na").alias("na"), pick("y_a", "x_a").alias("b"), pick("y_na", "x_na").alias("nb"))


def connected(edges: DataFrame) -> DataFrame:
    """(id, root): the least id that links reach, for every id of an edge; by stars of minima."""
    now = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    seen = None
    while True:
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        seen = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = settle(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        now = settle(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())


def components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, n_shingles, component_id).

    A document's set are the distinct runs of ``words`` words (between ASCII white space, A-Z
    lowered); a shorter text is one shingle; without words the set is empty and links with
    nothing.  Two documents link when den * |A∩B| >= num * |A∪B|.  ``component_id`` is the least
    id that links reach.  Rows that repeat an id are one document, whose links are those of all
    its texts; a null id has a null component and links with nothing.  Other columns are
    ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    members, edges = links(base.where("id is not null"), words, num, den)
    roots = connected(edges)
    # a class is one node, named by its least id, so its root is the least id of all its classes
    out = members.join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))
    nulls = _described_nulls(base.where("id is null"), words)
    return out.unionByName(nulls)


def _described_nulls(rows: DataFrame, words: int) -> DataFrame:
    """Set sizes of rows without an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            h, offs = shingle_hashes(*texts(b.column("text")), words)
            n = [np.unique(h[a:e]).size for a, e in zip(offs, offs[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), b.column("id")], ["doc_id", "n_shingles", "component_id"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, component_id long")
