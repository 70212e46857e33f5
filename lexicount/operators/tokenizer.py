"""Byte-level BPE vocabulary learned and applied with Spark.

* T02: pre-tokens come from the byte-level pattern (``regexp_extract_all``)
  and are counted with a two-phase ``groupBy`` - the learner then works on
  the (much smaller) distinct pre-token table, never on the raw text.
* T03, T05: see ``bpe``; encoding takes any object with ``encode``, shipped once
  per executor, with a per-task cache of encoded pre-tokens.
* T04: see ``unigram``.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BYTE_LEVEL_PATTERN, SPECIAL_TOKENS
from .bpe import N_BYTES, BpeEncoder, learn_bpe
from .unigram import UnigramEncoder, learn_unigram, nfkc, unigram_words

__all__ = ["learn_bpe", "BpeEncoder", "encode", "pretokens", "pretoken_counts", "vocab_table", "check_specials",
           "require_specials", "token_fertility", "learn_unigram", "UnigramEncoder", "unigram_words", "nfkc"]


def pretokens(df: DataFrame, text: str = "text", pattern: str = BYTE_LEVEL_PATTERN) -> DataFrame:
    """Byte-level pre-tokens of every non-empty text (one row per pre-token)."""
    d = df.filter(F.coalesce(F.col(text), F.lit("")) != "")
    return d.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), 0)).alias("pretoken"))


def pretoken_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Frequency of each pre-token (partial aggregation before the shuffle)."""
    return pretokens(df, text).groupBy("pretoken").agg(F.count(F.lit(1)).alias("count"))


def vocab_table(spark, merges: Sequence[tuple[int, int, int, int]], specials: Sequence[str] = SPECIAL_TOKENS
                ) -> tuple[DataFrame, DataFrame]:
    """K07 tables: vocabulary (id, token as hex bytes or special) and merges."""
    off = len(specials)
    toks: dict[int, bytes | str] = {i: s for i, s in enumerate(specials)}
    for b in range(N_BYTES):
        toks[off + b] = bytes([b])
    for rank, a, b, _ in merges:
        toks[off + N_BYTES + rank] = toks[a] + toks[b]  # type: ignore[operator]
    rows = [(i, t if isinstance(t, str) else t.hex(), isinstance(t, str)) for i, t in sorted(toks.items())]
    vocab = spark.createDataFrame(rows, "id int, token string, special boolean")
    mtab = spark.createDataFrame([(r, a, b, c) for r, a, b, c in merges], "rank int, left int, right int, count long")
    return vocab, mtab


def check_specials(vocab: DataFrame, specials: Sequence[str] = SPECIAL_TOKENS) -> DataFrame:
    """Specials missing from the vocabulary (empty when all survived)."""
    spark = vocab.sparkSession
    want = spark.createDataFrame([(s,) for s in specials], "token string")
    return want.join(vocab.filter("special").select("token"), "token", "left_anti")


def require_specials(vocab: DataFrame, specials: Sequence[str] = SPECIAL_TOKENS) -> DataFrame:
    """T06 as a gate: the vocabulary itself, or an error that names the specials that did not survive training."""
    missing = sorted(r.token for r in check_specials(vocab, specials).collect())  # at most the specials
    if missing:
        raise ValueError(f"special tokens missing from the vocabulary: {missing}")
    return vocab


class Encoder(Protocol):
    """Anything that turns a text piece into ids."""

    def encode(self, text: str) -> Any: ...


def _ids(encoded: Any) -> list[int]:
    """Ids from a list or from an object that carries them as ``ids``."""
    return list(getattr(encoded, "ids", encoded))


def encode(df: DataFrame, encoder: Encoder | Sequence[tuple[int, int, int, int]], text: str = "text",
           specials: Sequence[str] = SPECIAL_TOKENS, out: str = "ids", pattern: str | None = BYTE_LEVEL_PATTERN) -> DataFrame:
    """Ids of each text by any encoder; a merge list stands for its BPE encoder.

    With ``pattern`` the encoder is given pre-tokens, each distinct one once
    per task and while it stays among the recent ones; without, whole texts
    (encoders that cut texts themselves). Null texts have no ids.
    """
    enc = encoder if hasattr(encoder, "encode") else BpeEncoder(encoder, specials)
    shared = df.sparkSession.sparkContext.broadcast(enc)  # bounded by the vocabulary

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def _encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import regex
        one = lru_cache(maxsize=200_000)(lambda piece: _ids(shared.value.encode(piece)))
        rx = regex.compile(pattern) if pattern else None

        def ids(t: str | None) -> list[int]:
            if not t:
                return []
            if rx is None:
                return _ids(shared.value.encode(t))
            return [i for m in rx.finditer(t) for i in one(m.group(0))]

        for texts in batches:  # one cache for the whole task
            yield texts.map(ids)

    return df.withColumn(out, _encode(F.col(text)))


def token_fertility(encoded: DataFrame, by: Sequence[str] = ("lang",), ids: str = "ids",
                    ref: str = "ref_tokens") -> DataFrame:
    """Tokenizer tokens per reference token."""
    return encoded.groupBy(*by).agg(
        F.sum(F.size(ids)).cast("long").alias("tokenizer_tokens"), F.sum(ref).cast("long").alias("reference_tokens")
    ).withColumn("fertility", F.col("tokenizer_tokens") / F.col("reference_tokens"))
