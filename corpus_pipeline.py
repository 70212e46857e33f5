"""Corpus pipeline: each stage reads what its predecessor wrote and works on all of it.

``run`` writes every stage's result as Parquet into the shared checkpoint
folder and rereads it for the next. All stages but the last return the columns
of documents; the last returns the id sequences of what is left.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexicount.llm import exact, minhash, mixing, pieces, quality
from lexicount.llm.common import cut, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality.quality_stage),
    ("exact dedup", exact.exact_stage),
    ("minhash near-dedup", minhash.minhash_stage),
    ("mixing to target weights", mixing.mixing_stage),
    ("sentencepiece encoding", pieces.encode_stage),
]

#: Learned and hashed stages have no SQL form; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
