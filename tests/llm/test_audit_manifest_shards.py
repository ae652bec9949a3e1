"""Filter audit, Merkle manifest and sharding against plain Python, with odd rows and hot groups."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridweave.llm import common, exact_dedup, filter_audit, merkle, packing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mask int, key string, shard int, _row int, total long"


def table(spark, rows, parts=None):
    """Rows (doc_id, text, lang, source, n_chars), with more columns of names that operators use."""
    df = spark.createDataFrame([(*r, 7, "k", 3, 5, 9) for r in rows], SCHEMA)
    return df.repartition(parts) if parts else df


def some(n=160, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["ABC", "x|y", "café", "日本"]
    base = [" ".join(rng.choices(words, k=rng.choice([0, 3, 150, 210, 260]))) + rng.choice(["", " SHOUT" * 40, " a" * 300, "\x0b\x1f#"]) for _ in range(n // 3)]
    out = [(i * 3, rng.choice(base) + rng.choice(["", "", f" {i}"]), rng.choice(["en", "de", "fr", None]), rng.choice(["a", "b", "", None]), rng.choice([None, i])) for i in range(n)]
    return out + [(None, base[0], "en", "a", 4), (None, base[0], None, "b", None), (3, base[1], "en", "a", 1), (3, base[1], "en", "a", 1), (900, None, "de", "a", 0), (901, "", "es", "lone", 0), (902, "w " * 90_000, "zz", "b", 1)]


LABELS = [(0, 1, 0), (3, 1, 1), (3, 0, 0), (6, None, 1), (9, 1, None), (None, 1, 1), (902, 1, 1), (900, 1, 0)] + [(i * 3, i % 2, i % 5 == 0) for i in range(20, 90)]


def audit(rows, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q if k == 0 else t) == 1} for k in range(2))
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, _, source, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t]]
        fails.append((source or "", i, {f for f, bad in zip("ABCDE", tests, strict=True) if bad}))
    removed_at, out = defaultdict(int), {}
    for part in {p for p, *_ in fails}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [(i, f) for p, i, f in fails if p == part]
            gone = []
            for step, f in enumerate(order, 1):
                here = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in gone)
                left, gone = [x for x in left if f not in x[1]], gone + here
                removed_at[part, f] += len(here)
                out[part, order, step] = (len(left), len(here), redundant, sum(x[1] == {f} for x in left + gone), sum(x[0] in good for x in here), sum(x[0] in toxic for x in here))
    return {(*k, *v, removed_at[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("hashes", ["apart", "same"])
def test_audit(spark, monkeypatch, hashes):
    """Also where no hash tells texts apart, and with shuffles in place of broadcasts."""
    if hashes == "same":
        monkeypatch.setattr(filter_audit, "block_hash", lambda text, a, b: F.lit(1).cast("long"))
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = some() + [(1000 + i, "seven " * 3, "en", "a", 1) for i in range(300)] + [(2000 + i, "eight " * 3, "en", "c", 1) for i in range(5)]
    got = filter_audit.filter_audit(table(spark, rows), spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in LABELS], "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) == 600 * len({r[0] for r in got})
    assert set(got) == audit(rows, LABELS)


def h(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def leaf(row, more=0):
    i, text, lang, source, n = row
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n if n is None else n + more, text)))


def tree(nodes, f):
    """(root, path of each node: (siblings before, siblings after) for each level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            s = k // f * f
            paths[i].append((nodes[s:k], nodes[k + 1 : s + f]))
        nodes, at = [h(*nodes[s : s + f]) for s in range(0, len(nodes), f)], [k // f for k in at]
    return nodes[0], paths


def manifest(rows, f):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *tree([leaf(r) for r in own], f)))
    root, tops = tree([t[1] for t in trees], f)
    out = []
    for (own, sub, paths), top in zip(trees, tops, strict=True):
        for r, path in zip(own, paths, strict=True):
            d = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for before, after in path + top:
                d = h(*before, d, *after)
            out.append((r[0], leaf(r), sub, root, h(*(x for b, a in path + top for x in b + a)), d, d == root))
    return Counter(out)


@pytest.mark.parametrize(("fanout", "depth", "parts"), [(2, 12, 1), (2, 1, 5), (2, 3, 3), (3, 2, 2), (5, 1, 4)])
def test_manifest(spark, fanout, depth, parts):
    rows = some()
    got = merkle.manifest(table(spark, rows, parts), fanout, depth)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = manifest(rows, fanout)
    assert Counter(map(tuple, got.collect())) == want
    assert {v[-1] for v in want} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 9])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, f"t{i}", "en" if n < 9 or i < 8 else None, "a", 1) for i in range(n)]
    assert Counter(map(tuple, merkle.manifest(table(spark, rows), 2, 2).collect())) == (manifest(rows, 2) if n else Counter())


def shards_of(rows, law="rows", shards=8):
    """Checks what holds for any input; the groups of equal texts by their shards."""
    per = Counter(r.shard for r in rows)
    for s, n in per.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert all(0 <= r.shard < shards and r.law == law and r.grown_shard is None for r in rows)
    return per


@pytest.mark.parametrize("parts", [1, 4])
def test_shards_have_the_same_number_of_rows(spark, parts):
    rows = some()
    got = sharding.shard(table(spark, rows, parts), 8).collect()
    per = shards_of(got)
    assert max(per.values()) - min(per.values()) <= 1 and len(per) == 8
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_rows_than_shards(spark, n):
    for law in ("rows", "bytes"):
        per = shards_of(sharding.shard(table(spark, [(i, "t", "en", "a", 1) for i in range(n)]), 8, law).collect(), law)
        assert sum(per.values()) == n and (law == "bytes" or set(per.values()) <= {1})


def test_linked_documents_meet_and_a_hot_group_is_spread(spark):
    """A third of the rows are one text; others are groups of 2 to 9, or alone."""
    rng = random.Random(5)
    rows = [(i, "the same", "en", "a", 1) for i in range(2000)]
    i = 2000
    while i < 6000:
        k = rng.choice([1, 1, 1, 2, 3, 9])
        rows += [(i + j, f"text {i}", "en", "a", 1) for j in range(k)]
        i += k
    for links in (rows, [r for r in rows if r[1] == "the same" or r[0] % 9 == 0], [(i, f"t{i // 4}", "en", "a", 1) for i in range(4000)]):
        got = sharding.shard(table(spark, links), 8).collect()
        per = shards_of(got)
        assert max(per.values()) - min(per.values()) <= 1
        groups = defaultdict(Counter)
        for r in got:
            groups[r.text_crc32][r.shard] += 1
        apart = [g for g in groups.values() if len(g) > 1 and sum(g.values()) <= len(links) // 8]
        assert len(apart) <= 7  # what a cut falls on
        hot = groups[zlib.crc32(b"the same")]
        assert len([n for n in hot.values() if n < len(links) // 8]) <= 8


def test_shards_of_the_same_size(spark):
    rng = random.Random(6)
    rows = [(i, "x" * rng.choice([0, 10, 300, 2000]) + f"{i // 3}", "en", "a", 1) for i in range(2400)]
    got = sharding.shard(table(spark, rows), 8, "bytes").collect()
    shards_of(got, "bytes")
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    assert len(size) == 8 and max(size.values()) - min(size.values()) <= 2 * 2020
    with pytest.raises(ValueError):
        sharding.shard(table(spark, rows), 8, "key")


def test_propagation_keeps_within_capacity_and_gathers(spark):
    """Where all rows are linked, shards are full from the start, so moves must be exchanges."""
    rng = random.Random(7)
    cells = Counter((str(g).encode(), rng.randrange(6)) for g in range(500) for _ in range(4))
    df = spark.createDataFrame([(g, s, n) for (g, s), n in cells.items()], "group binary, shard int, w long")
    out = sharding.propagate(df, 340, 6).collect()
    assert Counter(r.group for r in df.collect()).keys() == {r.group for r in out}
    weight, held, parts = Counter(), Counter(), Counter()
    for r in out:
        weight[bytes(r.group)] += r.w
        held[r.shard] += r.w
        parts[bytes(r.group)] += 1
    assert set(weight.values()) == {4} and max(held.values()) <= 340 * 1.15
    assert sum(parts.values()) < 0.65 * len(cells)


def test_exact_dedup_is_the_same_by_shuffles(spark, monkeypatch):
    rows = some(60)
    want = Counter(map(tuple, exact_dedup.exact_dedup(table(spark, rows), block_chars=32).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert Counter(map(tuple, exact_dedup.exact_dedup(table(spark, rows), block_chars=32).collect())) == want


def test_packing_depends_on_the_rows_alone(spark, monkeypatch):
    """The same rows over 1, 3 and 7 partitions, in another order; thousands of them alike, by chunks."""
    monkeypatch.setattr(packing, "CHUNK", 100)
    rng = random.Random(9)
    rows = [(i, "x" * rng.randrange(300), "en", "a", 1) for i in range(1500)] + [(None, "same", "en", "a", 1)] * 1200 + [(7, "y" * 90, "en", "a", 1)] * 300
    packs = []
    for parts in (1, 3, 7):
        rng.shuffle(rows)
        got = packing.pack(table(spark, rows, parts), lengths=(64, 128), shard_pieces=200)
        packs.append(Counter(map(tuple, got.collect())))
    assert packs[0] == packs[1] == packs[2]
    assert Counter((r[0], r[3]) for r in packs[0].elements())[None, 5] == 1200
    per = Counter(r[4] for r in packs[0].elements() if r[0] is None)
    assert max(per.values()) < 400  # rows that are alike are dealt out


def test_columns_of_any_name_go_through_the_stages(spark):
    """Names that operators use inside stay what they are in the input."""
    import corpus_pipeline
    from gridweave.llm import line_dedup

    names = ["_key", "_gone", "_lines", "_id", "_deleted_lines", "key", "gone", "lines", "row", "id", "n", "sha"]
    line = " ".join(f"w{k}" for k in range(12))
    long = " ".join(f"v{k}" for k in range(60))
    texts = [(1, f"{line}\nmy own words"), (2, f"{line}\nother words of mine"), (3, long), (4, f"{long} x"), (None, "no id"), (None, "no id"), (5, "one"), (5, "two"), (6, None)]
    df = spark.createDataFrame([(i, t, len(t or ""), *range(len(names))) for i, t in texts], ", ".join(["doc_id long, text string, n_chars long", *(f"`{n}` int" for n in names)]))
    lines = line_dedup.line_dedup(df)
    assert lines.columns == [c for c in df.columns if c != "_deleted_lines"] + ["_deleted_lines"]
    kept = corpus_pipeline.drop_repeated_lines(spark, df, "")
    assert kept.columns == df.columns
    assert {(r.doc_id, r.text, r.n_chars) for r in kept.collect()} >= {(1, f"{line}\nmy own words", len(line) + 13), (2, "other words of mine", 19), (6, None, 0)}
    near = corpus_pipeline.drop_near_copies(spark, df, "")
    got = sorted(map(str, ((r.doc_id, r.text) for r in near.collect())))
    assert near.columns == df.columns
    assert got == sorted(map(str, [(i, t) for i, t in dict.fromkeys(texts) if i != 4]))
    for df2 in (kept, near):
        assert {tuple(r[n] for n in names) for r in df2.collect()} == {tuple(range(len(names)))}
