"""Byte-level BPE encoding and decoding (operator 1) by tree concatenation.

A text of more than ``segment_chars`` characters is cut into segments without regard to words
or tokens.  The segments are encoded in parallel, as rows of their own; then neighbours are
joined in a tree.  A join encodes a window around the cut anew and lets it grow until it agrees
with what is left on either side:

* at a place where the word pattern always starts a new word (a letter, digit or mark before
  white space, and changes between letters, digits and marks except from a mark to a letter),
  the encodings of both sides are independent; or
* inside a run of one class, a pair of neighbouring tokens must be the encoding of its own
  bytes.  A sequence of BPE tokens is the encoding of a word exactly if that holds for each
  pair of neighbours.

Shorter texts are one segment and need no join.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT_CHARS = 32_768
FIRST_WINDOW = 8

# Fixed value: the word pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The vocabulary writes printable bytes as themselves and the others as letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    return letters | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}


class TreeCodec:
    """Encodes, joins and decodes for one vocabulary file (the JSON of a byte-level BPE)."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in letters for c in token)}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for text in special:
            ranks.pop(text.encode(), None)
        self.special = tuple(special)
        self.table: list[bytes] = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.table[i] = token
        self.digits = [str(i) for i in range(len(self.table))]
        self.codec = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> list[int]:
        return self.codec.encode(text, allowed_special="all")

    def bytes_of(self, ids: list[int]) -> bytes:
        table = self.table
        return b"".join([table[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.bytes_of(ids).decode("utf-8", "replace")

    def _independent(self, left: str, right: str) -> bool:
        """Whether encode(left + right) is encode(left) + encode(right), seen from the cut alone."""
        a, b = _kind(left[-1]), _kind(right[0])
        if a == "space" or a == b or (a, b) == ("mark", "letter"):
            return False
        return not any(0 <= (left + right).find(s, max(0, len(left) - len(s) + 1)) < len(left) for s in self.special)

    def _pair(self, a: int, b: int) -> bool:
        """Whether two tokens of one run may be neighbours."""
        x, y = self.table[a], self.table[b]
        try:
            kinds = {_kind(c) for c in (x + y).decode()}
        except UnicodeDecodeError:
            return False
        return len(kinds) == 1 and kinds != {"mark"} and self.codec._encode_single_piece(x + y) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of a text from the encodings of its halves."""
        if not left or not right:
            return left + right
        width = FIRST_WINDOW
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            while a > 0 and self.table[left[a]][0] & 0xC0 == 0x80:  # inside a character
                a -= 1
            while b < len(right) and self.table[right[b]][0] & 0xC0 == 0x80:
                b += 1
            window = self.bytes_of(left[a:] + right[:b]).decode()
            new = self.encode(window)
            if (a == 0 or self._agree(left[max(0, a - 32) : a], new[:32])) and (b == len(right) or self._agree(new[-32:], right[b : b + 32])):
                return left[:a] + new + right[b:]
            width *= 2

    def _agree(self, left: list[int], right: list[int]) -> bool:
        a, b = self.bytes_of(left).decode("utf-8", "ignore"), self.bytes_of(right).decode("utf-8", "ignore")
        return bool(a and b) and (self._independent(a, b) or self._pair(left[-1], right[0]))

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """Join neighbours level by level."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []


@lru_cache(maxsize=100_000)
def _kind(c: str) -> str:
    if regex.match(r"\s", c):
        return "space"
    return "letter" if regex.match(r"\p{L}", c) else "digit" if regex.match(r"\p{N}", c) else "mark"


@lru_cache(maxsize=2)
def codec(path: str) -> TreeCodec:
    return TreeCodec(path)


def _result(c: TreeCodec, ids: list[int], digests: bool) -> tuple:
    if not digests:
        return (ids,)
    text = c.decode(ids)
    digit = c.digits
    return len(ids), hashlib.sha256(",".join([digit[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


_IDS = ("ids array<int>", ["ids"])
_DIGESTS = ("n_tokens long, ids_sha256 string, decoded_sha256 string", ["n_tokens", "ids_sha256", "decoded_sha256"])


def bpe_encode(docs: DataFrame, path: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text", segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """One row per input row: (doc_id, ids), or with ``digests`` (doc_id, n_tokens, ids_sha256,
    decoded_sha256), where the decoded text is made from the ids.

    Null text counts as empty (no ids).  Strings of special tokens in a text become their ids.
    Null ids and repeated rows pass through; other columns are ignored; an empty table gives
    an empty result.
    """
    schema, names = _DIGESTS if digests else _IDS
    # ids pass pandas as text, since a null would turn a column of longs into doubles
    base = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = F.length("text")

    def short(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for f in frames:
            out = pd.DataFrame([_result(c, c.encode(t), digests) for t in f["text"]], columns=names)
            out.insert(0, "doc_id", f["doc_id"].to_numpy())
            yield out

    def segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "sha": f["sha"], "at": f["at"], "ids": [c.encode(t) for t in f["part"]]})

    def joined(f: pd.DataFrame) -> pd.DataFrame:
        c = codec(path)
        rows = int((f["at"] == 0).sum())  # repeated rows
        parts = f.drop_duplicates("at").sort_values("at")["ids"]
        out = _result(c, c.join_all([[int(i) for i in x] for x in parts]), digests)
        return pd.DataFrame([(f["doc_id"].iloc[0], *out)] * rows, columns=["doc_id", *names])

    plain = base.where(size <= segment_chars).mapInPandas(short, f"doc_id string, {schema}")
    # one pass over the text cuts it; a substring for each segment would begin at the first character each time
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{segment_chars}}}"), F.lit(0))
    cut = base.where(size > segment_chars).select("doc_id", F.sha2("text", 256).alias("sha"), F.posexplode(parts).alias("at", "part"))
    cut = cut.repartition("doc_id", "sha", "at").mapInPandas(segments, "doc_id string, sha string, at int, ids array<int>")
    both = plain.unionByName(cut.groupBy("doc_id", "sha").applyInPandas(joined, f"doc_id string, {schema}"))
    return both.withColumn("doc_id", F.col("doc_id").cast("long"))


def bpe_decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with a column ``text`` decoded from ``ids_col``; null ids give null."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        c = codec(path)
        return ids.map(lambda x: None if x is None else c.decode(list(x)))

    return rows.withColumn("text", text(ids_col))
