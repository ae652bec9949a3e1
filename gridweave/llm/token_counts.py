"""Token counts through a digest cache (operator 10).

Counts are kept under (digest of the normalised text, digest of tokenizer and rules).  A run
joins the digests of its texts to the cache, encodes one text of each digest that misses, and
appends those counts; texts move only where a digest misses.  The cache is a Parquet folder; an
append is one Spark write, whose commit protocol leaves no part of a failed job, and a row that
two runs append is read as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, join_counted, settle, shared_dir

#: Words of a part in which a long text is encoded.
PART_WORDS = 16
_MARK = "▁"
#: Changes with the rules by which texts are normalised or counted, so that older counts miss.
RULES = b"1"


@lru_cache(maxsize=2)
def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + RULES).hexdigest()


@lru_cache(maxsize=2)
def _library_counter(path: str) -> Callable[[list[str]], list[int]]:
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import tokenizers

    t = tokenizers.Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


@lru_cache(maxsize=2)
def splits_at_blanks(path: str) -> bool:
    """Whether no piece of the model joins what stands before a blank to the blank.

    Then a text's pieces are those of its parts between single blanks, each of which gets the
    same leading mark alone as in its place.
    """
    if not path.endswith(".model"):
        return False
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    inner = any(_MARK in m.id_to_piece(i).lstrip(_MARK) for i in range(m.get_piece_size()))
    return not inner and m.decode(m.encode("  a   b ")) == "  a   b "  # nor are blanks trimmed or merged


def count_tokens(path: str, texts: list[str]) -> list[int]:
    """The library's counts of whole texts, which are cut at single blanks where that is exact.

    The time a library takes for a text grows faster than its length, so parts are faster.
    """
    count = _library_counter(path)
    if not splits_at_blanks(path):
        return count(texts)
    parts, ends = [], [0]
    for text in texts:
        words = text.split(" ")
        if len(words) <= PART_WORDS or "" in words or _MARK in text:  # blanks in a run or at an end
            parts.append(text)
        else:
            parts += [" ".join(words[i : i + PART_WORDS]) for i in range(0, len(words), PART_WORDS)]
        ends.append(len(parts))
    n = count(parts)
    return [sum(n[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


@lru_cache(maxsize=2)
def keeps_characters(path: str) -> bool:
    """Whether the model's normaliser changes no character but blanks, which become its mark."""
    if not path.endswith(".model"):
        return False
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = " A  ﬁ ½ Å e\u0301 \u00a0\t\r\n\u200b\ufeff ＡＢ \x00x İ "
    return m.normalize(odd).lstrip(_MARK) == odd.replace(" ", _MARK).lstrip(_MARK)


def normalised(text: Column, path: str) -> Column:
    """The text as the tokenizer sees it, as far as an expression can say; texts that are equal then have equal counts.

    A model that only marks blanks sees its mark in a text as a blank.  For others the text itself is taken.
    """
    return F.replace(text, F.lit(" "), F.lit(_MARK)) if keeps_characters(path) else text


def token_counts(docs: DataFrame, tokenizer_path: str, cache_dir: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, n_bytes, n_tokens, over_limit).

    Null text counts as empty (0 tokens).  Null ids, repeated rows and an empty table pass
    through; other columns are ignored.  ``cache_dir`` is a folder that all executors share; if none
    is given it is ``token-counts`` below the shared folder, which later runs find again.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    cache_dir = cache_dir or f"{shared_dir(spark)}/token-counts"
    schema = "text_digest binary, tokenizer_digest string, n_tokens long"
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(normalised(text, tokenizer_path), 256)).alias("text_digest")
    rows = settle(docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), digest))

    def cached() -> DataFrame:
        spark.createDataFrame([], schema).write.mode("append").parquet(cache_dir)  # so that the folder exists
        found = spark.read.schema(schema).parquet(cache_dir).where(F.col("tokenizer_digest") == version)
        return found.groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens"))

    groups = settle(rows.groupBy("text_digest").agg(F.count(F.lit(1)).alias("n_rows")))
    misses = settle(groups.join(cached(), "text_digest", "left_anti").select("text_digest"))
    n = misses.count()
    if n:
        # copies in a task are one row before texts move
        one = docs.select(digest, text.alias("text")).join(bounded_broadcast(misses, n), "text_digest", "left_semi") if n < groups.count() else docs.select(digest, text.alias("text"))

        def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"text_digest": f["text_digest"], "tokenizer_digest": version, "n_tokens": count_tokens(tokenizer_path, f["text"].tolist())})

        one.groupBy("text_digest").agg(F.min("text").alias("text")).mapInPandas(encode, schema).write.mode("append").parquet(cache_dir)
    known = settle(groups.join(cached(), "text_digest", "left"))
    out = join_counted(rows, known, ["text_digest"], "n_rows", rows.count())
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
