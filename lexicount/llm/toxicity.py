"""Toxicity scores (operator 2): subword-bag embeddings averaged into a linear softmax.

A window of consecutive words is the average of its words, a word the average
of the embeddings of its character n-grams; a two-class linear softmax on top
gives the window's log odds. The odds of a document are the summed odds of its
MOST most suspicious windows: one insult in a long text is not averaged away,
and neutral text of any length does not add up to an insult. Embeddings and softmax weights are trained jointly in numpy
on a bounded sample of labelled documents; unseen misspellings are scored
through the n-grams they share with seen words.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of
from .features import ngrams, text_codes, word_index
from .labelled import HELD_OUT, labelled_sample

LOW, HIGH, BITS, DIM, WINDOW = 3, 5, 18, 8, 3
#: Windows that decide on a document, whatever its length.
MOST = 4
#: Bound of the training sample, per class; documents scoring at least THRESHOLD are predicted toxic.
TRAIN_PER_CLASS = 1500
THRESHOLD = 0.3


@dataclass(frozen=True)
class ToxicityModel:
    embedding: np.ndarray  # buckets x DIM
    softmax: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2

    def bucket_logits(self) -> np.ndarray:
        """Share of each n-gram bucket in the log odds (the model is linear up to the pooling)."""
        return (self.embedding @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float64)


def word_bags(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket, word number) of every n-gram of a text, and its number of words."""
    codes = text_codes(text)
    words = word_index(codes)
    bucket, start = ngrams(codes, LOW, HIGH, BITS)
    return bucket, words[np.minimum(start + 1, len(codes) - 1)], int(words[-1])


def window_logits(bucket: np.ndarray, word: np.ndarray, n_words: int, per_bucket: np.ndarray) -> np.ndarray:
    """Log odds (without bias) of each window of WINDOW words."""
    if not n_words:
        return np.zeros(1)
    n = np.bincount(word, minlength=n_words)
    z = np.bincount(word, weights=per_bucket[bucket], minlength=n_words) / np.maximum(n, 1)
    win = np.arange(n_words) // WINDOW
    return np.bincount(win, weights=z) / np.bincount(win)


def pooled(z: np.ndarray, most: int = MOST) -> float:
    """Log of the summed odds of the ``most`` windows with the greatest odds: further neutral text adds nothing."""
    if len(z) > most:
        z = np.partition(z, len(z) - most)[-most:]
    top = z.max()
    return float(top + np.log(np.exp(z - top).sum()))


def score_text(text: str | None, per_bucket: np.ndarray, bias: float) -> float:
    z = pooled(window_logits(*word_bags(text), per_bucket) + bias)
    return float(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))


def train(texts: list[str], y: np.ndarray, weight: np.ndarray, rounds: int = 70, step: float = 1.8,
          decay: float = 0.002, seed: int = 7) -> ToxicityModel:
    """Joint full-batch descent on embeddings and softmax; distinct words are embedded once per round.

    Steps have a set length for each matrix as a whole, so n-grams seen in many
    documents move most and rare ones are not memorised.
    """
    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((1 << BITS, DIM)) * 0.01).astype(np.float32)
    top = (rng.standard_normal((DIM, 2)) * 0.5).astype(np.float32)
    base = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)) if len(y) else 0.05
    bias = np.array([0.0, np.log(base / (1 - base)) - 4.0], dtype=np.float32)
    if not len(y) or len(set(y.tolist())) < 2:
        return ToxicityModel(emb * 0, top, np.array([0.0, -60.0], dtype=np.float32))
    known: dict[str, int] = {}
    ids, win_of, doc_of = [], [], []
    n_win = 0
    for d, t in enumerate(texts):
        ws = (t or "").lower().split() or [""]
        ids.append(np.fromiter((known.setdefault(w, len(known)) for w in ws), dtype=np.int64, count=len(ws)))
        win_of.append(n_win + np.arange(len(ws)) // WINDOW)
        k = (len(ws) - 1) // WINDOW + 1
        doc_of.append(np.full(k, d))
        n_win += k
    word_ids, win, doc = np.concatenate(ids), np.concatenate(win_of), np.concatenate(doc_of)
    win_n = np.bincount(win, minlength=n_win)
    grams, edges = [], [0]
    for w in known:
        b, _ = ngrams(text_codes(w), LOW, HIGH, BITS)
        b = b if len(b) else np.zeros(1, dtype=np.int64)
        grams.append(b)
        edges.append(edges[-1] + len(b))
    gram, edge = np.concatenate(grams), np.array(edges)
    gram_n = np.diff(edge)
    weight = weight / weight.sum()
    first = np.searchsorted(doc, np.arange(len(y)))
    speed = [np.zeros_like(a) for a in (emb, top, bias)]
    for it in range(rounds):
        diff = top[:, 1] - top[:, 0]
        z_word = np.add.reduceat((emb @ diff)[gram], edge[:-1]) / gram_n
        z_win = np.bincount(win, weights=z_word[word_ids], minlength=n_win) / win_n + (bias[1] - bias[0])
        peak = np.maximum.reduceat(z_win, first)
        e = np.exp(z_win - peak[doc])
        total = np.add.reduceat(e, first)
        p = 1.0 / (1.0 + np.exp(-np.clip(peak + np.log(total), -60, 60)))
        g_win = ((p - y) * weight)[doc] * e / total[doc]
        g_word = np.bincount(word_ids, weights=(g_win / win_n)[win], minlength=len(known))
        g_bucket = np.bincount(gram, weights=np.repeat(g_word / gram_n, gram_n), minlength=1 << BITS).astype(np.float32)
        g_diff = emb.T @ g_bucket
        grads = (np.outer(g_bucket, diff), np.stack([-g_diff, g_diff], axis=1),
                 np.array([-g_win.sum(), g_win.sum()], dtype=np.float32))
        loss = float(-(weight * np.log(np.where(y == 1, p, 1 - p) + 1e-12)).sum())
        size = step * np.sqrt(len(y)) * (1 - it / rounds) * min(1.0, 0.1 + 2 * loss)
        for a, g, v, s in zip((emb, top, bias), grads, speed, (1.0, 0.02, 0.05), strict=True):
            v *= 0.8
            v += 0.2 * g / (np.sqrt((g * g).sum()) + 1e-12)
            a -= size * s * v
        emb *= 1 - decay
    return ToxicityModel(emb, top, bias)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> ToxicityModel:
    """Train on at most ``per_class`` documents of either label, outside the held-out fold.

    Without labels of both classes the model is constant and calls nothing toxic.
    """
    got = labelled_sample(docs, labels, F.col("toxic"), per_class, 2)
    return train(got["text"].tolist(), got["y"].to_numpy(dtype=np.float64), got["weight"].to_numpy(dtype=np.float64))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row and whole text.

    Null and empty texts get the score of one window without n-grams. A null
    doc_id is not held out. Repeated rows are scored alike; other columns are
    ignored; an empty table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((model.bucket_logits(), float(model.bias[1] - model.bias[0])))  # 2^BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_bucket, bias = shared.value
        for batch in batches:
            p = [score_text(t.as_py(), per_bucket, bias) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold_of("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
