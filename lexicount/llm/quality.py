"""Quality classifier (operator 3): ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w.x - t_k): one weight vector over hashed character
n-grams of the whole text, shared by all grades, and ordered thresholds
t_1 < t_2 < ... . Expected grade and tail probabilities follow directly and
drive the selection.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_words, fold_of, table
from .features import ngrams, text_codes
from .labelled import HELD_OUT, labelled_sample

LOW, HIGH, BITS = 1, 3, 13
DIM = (1 << BITS) + 1
GRADES = 3
#: Bound of the training sample, per grade.
TRAIN_PER_GRADE = 1000
#: A document is selected when P(grade >= 1) reaches this.
SELECT_TAIL = 0.5


def graded(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Grades from the label table: 0 poor, 1 good but toxic, 2 good (a null toxic mark counts as not toxic)."""
    return F.when(F.col(quality) == 0, 0).when(F.col(quality) == 1, 2 - F.coalesce(F.col(toxic), F.lit(0)))


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray  # DIM
    thresholds: np.ndarray  # increasing, GRADES - 1

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES - 1, one row per score."""
        return 1.0 / (1.0 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -500, 500)))


def text_features(text: str | None) -> np.ndarray:
    """Square roots of shares of 2^BITS hashed n-grams, and of words equal to the word before (no words: zeros)."""
    x = np.zeros(DIM)
    bucket, _ = ngrams(text_codes(text, lower=False), LOW, HIGH, BITS)
    if len(bucket):
        x[:1 << BITS] = np.sqrt(np.bincount(bucket, minlength=1 << BITS) / len(bucket))
        words = byte_words(text)
        x[1 << BITS] = np.sqrt(sum(map(eq, words, words[1:])) / max(1, len(words) - 1))
    return x


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, grades: int = GRADES, rounds: int = 300,
          rate: float = 0.05, decay: float = 1e-5) -> OrdinalModel:
    """Maximum likelihood by full-batch Adam; thresholds are a start and positive gaps, so they stay ordered."""
    x = x.astype(np.float32, copy=False)
    w = np.zeros(x.shape[1], dtype=np.float32)
    gaps = np.zeros(grades - 1)  # t_1, then log of the gaps
    gaps[0] = -1.0
    if not len(y) or len(set(y.tolist())) < 2:
        gaps[0] = -2.0  # nothing to learn from: every document is selected
        return OrdinalModel(w, np.concatenate([gaps[:1], gaps[0] + np.cumsum(np.exp(gaps[1:]))]))
    weight = weight / weight.sum()
    y = y.astype(np.int64)
    rows = np.arange(len(y))
    m, v = np.zeros(len(w) + len(gaps)), np.zeros(len(w) + len(gaps))
    for it in range(1, rounds + 1):
        t = np.concatenate([gaps[:1], gaps[0] + np.cumsum(np.exp(gaps[1:]))])
        f = 1.0 / (1.0 + np.exp(-np.clip((x @ w)[:, None] - t[None, :], -60, 60)))
        f = np.concatenate([np.ones((len(y), 1)), f, np.zeros((len(y), 1))], axis=1)  # P(grade >= 0 .. grades)
        upper, lower = f[rows, y], f[rows, y + 1]
        p = np.maximum(upper - lower, 1e-12)
        g_score = -(1.0 - upper - lower) * weight
        g_t = np.zeros((len(y), grades + 1))
        g_t[rows, y] += upper * (1 - upper) / p
        g_t[rows, y + 1] -= lower * (1 - lower) / p
        g_t = (g_t * weight[:, None]).sum(axis=0)[1:grades]
        g_gap = np.cumsum(g_t[::-1])[::-1].copy()
        g_gap[1:] *= np.exp(gaps[1:])
        g = np.concatenate([g_score.astype(np.float32) @ x + decay * w, g_gap])
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        move = rate * (m / (1 - 0.9 ** it)) / (np.sqrt(v / (1 - 0.99 ** it)) + 1e-8)
        w -= move[:len(w)].astype(np.float32) * 20
        gaps -= move[len(w):]
    return OrdinalModel(w, np.concatenate([gaps[:1], gaps[0] + np.cumsum(np.exp(gaps[1:]))]))


def fit(docs: DataFrame, labels: DataFrame, grade: Column | None = None, per_grade: int = TRAIN_PER_GRADE) -> OrdinalModel:
    got = labelled_sample(docs, labels, graded() if grade is None else grade, per_grade, GRADES)
    x = np.zeros((len(got), DIM), dtype=np.float32)  # the one large table on the driver, bounded by the sample
    for i, t in enumerate(got["text"]):
        x[i] = text_features(t)
    return train(x, got["y"].to_numpy(dtype=np.int64), got["weight"].to_numpy(dtype=np.float64))


def grade_texts(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, held_out, expected_grade, tail probabilities p_ge_1 .., selected; one row per row.

    Whole texts. Null and empty texts have the zero vector, so the thresholds
    alone grade them. A null doc_id is not held out. Repeated rows are graded
    alike, other columns are ignored, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM weights
    tails = [f"p_ge_{k}" for k in range(1, GRADES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mod = shared.value
        for batch in batches:
            s = np.array([float(text_features(t.as_py()) @ mod.weights) for t in batch.column(1)])
            p = mod.tails(s.reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p.sum(axis=1)), *[pa.array(p[:, k]) for k in range(p.shape[1])]],
                names=["doc_id", "expected_grade", *tails])

    out = docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, expected_grade double, " + ", ".join(f"{t} double" for t in tails))
    return out.select("doc_id", F.coalesce(fold_of("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"),
                      "expected_grade", *tails, (F.col("p_ge_1") >= SELECT_TAIL).alias("selected"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier selects, in place (no exchange of texts)."""
    shared = spark.sparkContext.broadcast(fit(docs, table(spark, sf_dir, "labels")))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([float(text_features(t.as_py()) @ shared.value.weights) for t in batch.column(at)])
            yield batch.filter(pa.array(shared.value.tails(s.reshape(-1))[:, 0] >= SELECT_TAIL))

    return docs.mapInArrow(run, docs.schema)
