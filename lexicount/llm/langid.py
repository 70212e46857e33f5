"""Language identification by Bayesian evidence fusion (operator 10).

Log posterior of a page's language = tempered text likelihood (hashed
character n-grams, learned from labelled documents) + declared markup language
+ address suffix + host prior. The last three are grouped aggregates of the
text posteriors over all pages; the host prior is smoothed towards its domain
and the domain towards the whole crawl, and leaves out the page itself.
"""
from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fold_of
from .features import ngrams, text_codes
from .labelled import HELD_OUT

LOW, HIGH, BITS = 1, 3, 15
#: Bound of the training sample, documents of a language; languages whose likelihoods one broadcast holds.
TRAIN_PER_LANGUAGE, LANGUAGE_BLOCK = 600, 64

_HIDDEN = re.compile(r"(script|style|nav)\b", re.I)
_CLOSING = re.compile(r"</(script|style|nav)\s*>", re.I)
_HTML_TAG = re.compile(r"<html\b[^>]*", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,8})", re.I)
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


@dataclass(frozen=True)
class Params:
    """temper: share of each n-gram's log likelihood (they are far from independent); kappa: smoothing weight."""

    temper: float = 0.05
    kappa: float = 5.0


def without_markup(page: str) -> str:
    """The page with a space for every tag, comment and script, style or nav element, in one pass.

    An element that is never closed loses its tag only; a comment or tag that
    is never closed is text.
    """
    closings: dict[str, list[tuple[int, int]]] = {}
    for m in _CLOSING.finditer(page):
        closings.setdefault(m.group(1).lower(), []).append(m.span())
    out, done, at, comments = [], 0, page.find("<"), True
    while at >= 0:
        end = -1
        if comments and page.startswith("<!--", at):
            end = page.find("-->", at + 4) + 3
            comments = end >= 3  # without one ahead of here there is none later on
        elif m := _HIDDEN.match(page, at + 1):
            spans = closings.get(m.group(1).lower(), [])
            i = bisect_left(spans, (m.end(), 0))
            end = spans[i][1] if i < len(spans) else -1
        if end < 3:
            end = page.find(">", at + 1) + 1
            if not end:
                break  # no tag ends after this
        out += [page[done:at], " "]
        done, at = end, page.find("<", end)
    return "".join(out) + page[done:]


def visible_text(page: str | None) -> str:
    return html.unescape(without_markup(page or ""))


def declared_language(page: str | None) -> str:
    """Language attribute of the first html tag."""
    tag = _HTML_TAG.search(page or "")
    m = _LANG.search(tag.group(0)) if tag else None
    return m.group(1).lower() if m else ""


def address(url: str | None) -> tuple[str, str, str]:
    """(host, domain, suffix), lower-cased; empty where there is none."""
    m = _HOST.match(url or "")
    if not m:
        return "", "", ""
    host = m.group(1).lower()
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1]


def training_rows(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """lang, text of at most ``per_language`` ids of each language, by smallest id hash, outside the held-out fold."""
    lab = docs.select("doc_id", "lang").filter("lang is not null and doc_id is not null").filter(fold_of("doc_id") != HELD_OUT)
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")  # group-limited before the shuffle
    ids = (lab.distinct().withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= per_language)
           .select(F.col("doc_id").alias("id"), F.col("lang").alias("of")))
    got = docs.join(ids, (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("of")))
    return got.select("lang", "text")


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, bucket, n: n-grams of the training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                bucket, _ = ngrams(text_codes(text.as_py()), LOW, HIGH, BITS)
                at, n = np.unique(bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()),
                                                  pa.array(n, pa.int64())], names=["lang", "bucket", "n"])

    return (rows.mapInArrow(run, "lang string, bucket long, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def likelihoods(counts: DataFrame, names: list[str]) -> np.ndarray:
    """log P(n-gram bucket | language) of some languages: len(names) x 2^BITS numbers on the driver."""
    got = counts.filter(F.col("lang").isin(names)).toPandas()
    table = np.full((len(names), 1 << BITS), 0.5)
    index = {name: i for i, name in enumerate(names)}
    table[got["lang"].map(index).to_numpy(dtype=np.int64), got["bucket"].to_numpy(dtype=np.int64)] += got["n"]
    return np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, host, domain, suffix, declared, seen, often (n-gram buckets of the visible text and their counts), ev (empty)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, said, seen, often = [], [], [], []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                page = page.as_py()
                bucket, n = np.unique(ngrams(text_codes(visible_text(page)), LOW, HIGH, BITS)[0], return_counts=True)
                seen.append(bucket.astype(np.int32)), often.append(n.astype(np.int32))
                places.append(address(url))
                said.append(declared_language(page))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([x[k] for x in places], pa.string()) for k in range(3)], pa.array(said, pa.string()),
                 pa.array(seen, ints), pa.array(often, ints), pa.array([[]] * len(said), pa.list_(pa.float64()))], names=_PAGE)

    return pages.select("page_id", "url", "html").mapInArrow(run, _PAGE_TYPES)


_PAGE = ["page_id", "host", "domain", "suffix", "declared", "seen", "often", "ev"]
_PAGE_TYPES = ("page_id long, host string, domain string, suffix string, declared string, seen array<int>, often array<int>, "
               "ev array<double>")


def with_block(rows: DataFrame, table: np.ndarray, p: Params) -> DataFrame:
    """Appends the tempered log likelihoods of one block of languages to ``ev``."""
    shared = rows.sparkSession.sparkContext.broadcast(table)  # LANGUAGE_BLOCK x 2^BITS numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ev = []
            for seen, often, have in zip(*(batch.column(k) for k in (5, 6, 7)), strict=True):
                at, n = seen.values.to_numpy(), often.values.to_numpy()
                more = p.temper * (shared.value[:, at].astype(np.float64) @ n) if len(at) else np.zeros(len(shared.value))
                ev.append(np.concatenate([have.values.to_numpy(), more]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(ev, pa.list_(pa.float64()))], names=_PAGE)

    return rows.mapInArrow(run, _PAGE_TYPES)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _sums(rows: DataFrame, key: str) -> DataFrame:
    """key, <key>_c: posteriors per language, summed as rows; written, so that joins on a hot key can be split."""
    each = rows.select(F.col(key).alias(f"{key}_k"), F.posexplode("q").alias("i", "x")).groupBy(f"{key}_k", "i").agg(F.sum("x").alias("x"))
    whole = each.groupBy(f"{key}_k").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("all"))  # one row per language
    return cut(whole.select(f"{key}_k", F.transform("all", lambda e: e["x"]).alias(f"{key}_c")), f"language-{key}")


def identify(pages: DataFrame, docs: DataFrame, p: Params = Params()) -> DataFrame:
    """page_id, lang, p, text_lang, declared, host: one row per page.

    Every labelled language takes part. A null or empty page has no text
    evidence and is decided by address and priors; a null or malformed address
    counts as one unknown host. Repeated rows count as pages of their own. Ties
    go to the language first by code point. Without labelled documents lang
    and p are null. Other columns are ignored; an empty table gives no rows.
    """
    counts = cut(gram_counts(training_rows(docs)), "language-grams")
    names = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # one row per language
    n = len(names)
    if not n:
        none = F.lit(None)
        return pages.select("page_id", none.cast("string").alias("lang"), none.cast("double").alias("p"),
                            none.cast("string").alias("text_lang"), none.cast("string").alias("declared"),
                            none.cast("string").alias("host"))
    rows = page_evidence(pages)
    for at in range(0, n, LANGUAGE_BLOCK):
        rows = with_block(rows, likelihoods(counts, names[at:at + LANGUAGE_BLOCK]), p)
    rows = rows.select("page_id", "host", "domain", "suffix", "declared", "ev", F.array_max("ev").alias("top"))
    rows = rows.select("page_id", "host", "domain", "suffix", "declared", F.transform("ev", lambda x: x - F.col("top")).alias("ev"))
    rows = rows.withColumn("q", F.transform("ev", lambda x: F.exp(x)))
    rows = rows.withColumn("weight", _total(F.col("q")))
    rows = cut(rows.withColumn("q", F.transform("q", lambda x: x / F.col("weight"))).drop("weight"), "language-pages")
    whole = {r["i"]: r["x"] for r in rows.select(F.posexplode("q").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()}
    total = [float(whole.get(i, 0.0)) for i in range(n)]
    everything = sum(total)

    def constants(values: list[float]) -> Column:
        return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")

    for key in ("host", "domain", "suffix", "declared"):
        rows = rows.join(_sums(rows.select(key, "q"), key), F.col(key) == F.col(f"{key}_k"), "left").drop(f"{key}_k")
        # without the page itself
        rows = rows.withColumn(f"{key}_c", F.zip_with(f"{key}_c", "q", lambda c, q: F.greatest(F.lit(0.0), c - q)))
        rows = rows.withColumn(f"{key}_n", _total(F.col(f"{key}_c")))
    k = F.lit(p.kappa)

    def smoothed(key: str, towards: Column) -> Column:
        """P(language | key), smoothed."""
        return F.zip_with(f"{key}_c", towards, lambda c, t: (c + k * t) / (F.col(f"{key}_n") + k))

    def given(key: str) -> Column:
        """P(value | language), smoothed by the value's share of all pages."""
        share = F.col(f"{key}_n") / F.lit(max(1.0, everything))
        return F.zip_with(f"{key}_c", constants(total), lambda c, t: (c + k * share + 1e-6) / (t + k + 1e-6))

    rows = rows.withColumn("in_domain", smoothed("domain", constants([(c + 1.0) / (everything + n) for c in total])))
    rows = rows.withColumn("in_host", smoothed("host", F.col("in_domain")))
    post = F.zip_with("ev", "in_host", lambda e, x: e + F.log(x))
    for key in ("declared", "suffix"):
        post = F.zip_with(post, given(key), lambda e, x: e + F.log(x))
    rows = rows.withColumn("log_post", post)
    rows = rows.withColumn("best", F.array_max("log_post"))
    code = F.array(*[F.lit(x) for x in names])
    return rows.select(
        "page_id", F.element_at(code, F.array_position("log_post", F.col("best")).cast("int")).alias("lang"),
        (F.lit(1.0) / F.aggregate("log_post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))).alias("p"),
        F.element_at(code, F.array_position("q", F.array_max("q")).cast("int")).alias("text_lang"), "declared", "host")
