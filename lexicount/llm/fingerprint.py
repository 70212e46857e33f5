"""Document fingerprints by consistent weighted sampling (operator 13, built-in functions only).

Every term of a document (a word, weighted by how often it occurs) draws a
step r and a threshold c, both Gamma(2, 1), and a shift b ~ U(0, 1) for each
sample, from a hash of the term and the sample's number alone. With
t = floor(ln w / r + b) the term bids c * exp(-r * (t - b + 1)); the sample is
the (term, t) with the smallest bid. Two documents draw the same sample with
the probability of their generalised Jaccard similarity,
sum(min(w1, w2)) / sum(max(w1, w2)).

Documents travel once in text form, in blocks of neighbours; counting,
sampling and comparing happen inside the block's task.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, in_order

#: Hashed bits that pick a quantile of the gamma distribution, and bits of the uniform shift.
_QUANTILE_BITS, _SHIFT_BITS = 12, 24
#: Bids are compared as fixed-point logarithms with 24 fraction bits, offset to be positive.
_LOG_OFFSET, _LOG_SCALE = 40.0, float(1 << 24)
_STEP = 1 << 16  # equal rows are multiplied by at most so many at a time
_LANE = 16  # bits kept of each sample, four samples to a long


@dataclass(frozen=True)
class Params:
    """samples of a fingerprint (a multiple of four); neighbours that share a block.

    The likeness of two fingerprints has a standard error of at most
    0.5 / sqrt(samples): 0.07 with 48.
    """

    samples: int = 48
    block: int = 64


def gamma_quantiles(bits: int = _QUANTILE_BITS) -> np.ndarray:
    """Midpoints of 2^bits equally likely parts of Gamma(2, 1), whose distribution is 1 - (1 + x) exp(-x)."""
    p = (np.arange(1 << bits) + 0.5) / (1 << bits)
    low, high = np.zeros_like(p), np.full_like(p, 64.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def _array(values: np.ndarray) -> Column:
    """A constant array (folded by the optimizer, shipped once with the plan)."""
    return F.split(F.lit(",".join(map(repr, values.tolist()))), ",").cast("array<double>")


def term_rows(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` without ``text``, once per distinct word (term: its hash, weight: how often it occurs).

    A text without words gives one row with a null term. Equal hashes stand
    together in the sorted array, so a weight is the distance between starts
    of runs and nothing is shuffled.
    """
    keep = [c for c in rows.columns if c != text]
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE), lambda w: w != "")
    d = rows.select(*keep, F.sort_array(F.transform(words, lambda w: F.xxhash64(w))).alias("_terms"))
    places = F.when(F.size("_terms") > 0, F.sequence(F.lit(0), F.size("_terms") - 1))
    starts = F.filter(places, lambda i: (i == 0) | (F.get("_terms", i) != F.get("_terms", i - 1)))
    d = d.select("*", starts.alias("_starts"))
    runs = F.transform("_starts", lambda i, j: F.struct(
        F.get("_terms", i).alias("term"), (F.coalesce(F.get("_starts", j + 1), F.size("_terms")) - i).alias("weight")))
    return d.select(*keep, F.explode_outer(runs).alias("_run")).select(*keep, "_run.term", "_run.weight")


def with_bids(rows: DataFrame, lanes: int) -> DataFrame:
    """Adds bid0, bid1, ...: the bids of a row's term for samples part * lanes, part * lanes + 1, ...

    A bid is the fixed-point logarithm of c * exp(-r * (t - b + 1)) above 32
    bits that name (term, t). The hash of (term, sample) picks r and c among
    equally likely quantiles of the gamma distribution, and b. Needs columns
    term, log_w, part.
    """
    gamma, mask = gamma_quantiles(), (1 << _QUANTILE_BITS) - 1
    steps, logs = _array(gamma), _array(np.log(gamma))
    js = range(lanes)
    d = rows.select("*", *[F.xxhash64("term", F.col("part") * lanes + j).alias(f"_h{j}") for j in js])

    def picked(table: Column, h: str, shift: int) -> Column:
        return table[F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(mask)).cast("int")]

    def shift_of(h: str) -> Column:
        b = F.shiftrightunsigned(h, 2 * _QUANTILE_BITS).bitwiseAND(F.lit((1 << _SHIFT_BITS) - 1))
        return (b + F.lit(0.5)) * F.lit(2.0 ** -_SHIFT_BITS)

    d = d.select(*rows.columns, *[picked(steps, f"_h{j}", 0).alias(f"_r{j}") for j in js],
                 *[picked(logs, f"_h{j}", _QUANTILE_BITS).alias(f"_c{j}") for j in js],
                 *[shift_of(f"_h{j}").alias(f"_b{j}") for j in js])
    d = d.select("*", *[F.floor(F.col("log_w") / F.col(f"_r{j}") + F.col(f"_b{j}")).alias(f"_t{j}") for j in js])

    def bid(j: int) -> Column:
        log_bid = F.col(f"_c{j}") - F.col(f"_r{j}") * (F.col(f"_t{j}") - F.col(f"_b{j}") + F.lit(1.0))
        name = F.col("term").bitwiseXOR(F.shiftleft(F.col(f"_t{j}"), 7)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftleft(F.floor((log_bid + F.lit(_LOG_OFFSET)) * F.lit(_LOG_SCALE)), 32).bitwiseOR(name)

    return d.select(*rows.columns, *[bid(j).alias(f"bid{j}") for j in js])


def fingerprints(rows: DataFrame, text: str, p: Params = Params()) -> DataFrame:
    """The other columns of ``rows`` (together a key of it) and ``sig``: longs of four 16-bit samples each.

    The signature of a text without words is null. If ``rows`` is already
    dealt out by some of its columns, nothing is exchanged; otherwise partial
    minima are, one row per document, four samples and task.
    """
    if p.samples % 4:
        raise ValueError("samples must be a multiple of four")
    keep = [c for c in rows.columns if c != text]
    d = term_rows(rows, text).select(*keep, "term", F.ln(F.col("weight").cast("double")).alias("log_w"))
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.lit(p.samples // 4 - 1)).cast("array<long>")).alias("part"))
    low = with_bids(d, 4).groupBy(*keep, "part").agg(*[F.min(f"bid{j}").alias(f"_m{j}") for j in range(4)])
    lanes = [F.shiftleft(F.col(f"_m{j}").bitwiseAND(F.lit((1 << _LANE) - 1)), _LANE * j) for j in range(4)]
    low = low.select(*keep, "part", reduce(lambda x, y: x.bitwiseOR(y), lanes).alias("_packed"))
    whole = low.groupBy(*keep).agg(*[F.max(F.when(F.col("part") == i, F.col("_packed"))).alias(f"_q{i}")
                                     for i in range(p.samples // 4)])
    sig = F.when(F.col("_q0").isNotNull(), F.array(*[f"_q{i}" for i in range(p.samples // 4)]))
    return whole.select(*keep, sig.alias("sig"))


def _folded(lanes: Column, step: int) -> Column:
    return F.transform(lanes, lambda x: x.bitwiseOR(F.shiftrightunsigned(x, step)))


def likeness(a: Column, b: Column, p: Params = Params()) -> Column:
    """Share of equal samples, an estimate of the generalised Jaccard similarity; without words on both sides 1, on one 0."""
    x = F.zip_with(a, b, lambda u, v: u.bitwiseXOR(v))
    for step in (8, 4, 2, 1):  # whatever bits of a lane differ end up in its lowest
        x = _folded(x, step)
    equal = F.aggregate(x, F.lit(p.samples), lambda n, v: n - F.bit_count(v.bitwiseAND(F.lit(0x0001000100010001))))
    return (F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0)
            .otherwise(equal / F.lit(float(p.samples))))


def printed(sig: Column, p: Params = Params()) -> Column:
    """A signature as lowercase hex; without words: empty."""
    parts = [F.lpad(F.hex(sig[i]), 16, "0") for i in range(p.samples // 4)]
    return F.coalesce(F.lower(F.concat(*parts)), F.lit(""))


def _edited(text: str, other: str) -> Column:
    """``text`` with its last floor(n_chars / 2) code points replaced by the first as many of ``other``."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.col("n_chars").cast("int") - half), F.substring(other, F.lit(1), half))


def edited_fingerprints(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Every document against an edited form of itself and against its neighbour; one row per input row.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. In the edited text the last floor(n_chars / 2) code
    points are replaced by the first as many (or all) of the next document by
    descending doc_id (null last; rows that share an id follow by the sha-256
    of id and text; after the last comes the first, for a single row itself).
    Null text counts as empty; texts without words have an empty fingerprint,
    like each other (1) and unlike all others (0). Equal texts have equal
    fingerprints. Rows that repeat id and text are neighbours of each other;
    they are handled once. An empty table gives no rows; other columns are
    ignored.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.col("text")).cast("binary"), 256)
    d = d.withColumn("key", F.substring(F.unhex(key), 1, 16))
    # positions are found on ids and digests alone
    keys = cut(d.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "fingerprint-keys")
    places = cut(in_order(keys, [F.desc("doc_id"), "key"], "fingerprint-order"), "fingerprint-places")
    total = places.count()
    own = F.floor(F.col("pos") / p.block)
    # a block also holds the document after its last one; after the very last comes the first
    first = (F.col("pos") % p.block == 0) & (F.col("pos") > 0)
    homes = [F.struct(own.alias("block"), F.col("pos").alias("at"), F.lit(False).alias("guest")),
             F.when(first, F.struct((own - 1).alias("block"), F.col("pos").alias("at"), F.lit(True).alias("guest"))),
             F.when(F.col("pos") == 0, F.struct(F.lit((total - 1) // p.block).cast("long").alias("block"),
                                                F.lit(total).cast("long").alias("at"), F.lit(True).alias("guest")))]
    d = d.select("key", "text").join(places.select("key", "doc_id", "copies", F.array_compact(F.array(*homes)).alias("homes")), "key")
    d = d.select("doc_id", "copies", "text", F.explode("homes").alias("home")).select("home.*", "doc_id", "copies", "text")
    d = d.repartition("block").dropDuplicates(["block", "at"])
    by_place = Window.partitionBy("block").orderBy("at")
    d = d.select("block", "at", "guest", "doc_id", "copies", "text", F.lead("text").over(by_place).alias("next"),
                 F.length("text").cast("long").alias("n_chars"))
    mine = ~F.col("guest")
    d = d.select("block", "at", "guest", "doc_id", "n_chars", "copies", "text", F.when(mine, _edited("text", "next")).alias("edited"),
                 F.when(mine & (F.col("copies") > 1), _edited("text", "text")).alias("doubled"))
    # what is known of a text goes along with its terms: nothing leaves the block's task before the result
    names = ("text", "edited", "doubled")
    forms = F.filter(F.array(*[F.struct((F.col("at") * 4 + i).alias("item"), F.col(c).alias("body"),
                                        (F.unhex(F.sha2(F.col(c).cast("binary"), 256)) if i else F.lit(b"")).alias("sha"))
                               for i, c in enumerate(names)]), lambda f: f["body"].isNotNull())
    d = d.select("block", "guest", "doc_id", "n_chars", "copies", F.explode(forms).alias("f")).select(
        "block", "f.item", "guest", "doc_id", "n_chars", "copies", "f.sha", "f.body")
    signed = fingerprints(d, "body", p).withColumn("of", F.struct("sig", "sha"))
    of = [F.max(F.when(F.col("item") % 4 == i, F.col("of"))).alias(c) for i, c in enumerate(("own", "edited", "doubled"))]
    about = [F.max(c).alias(c) for c in ("guest", "doc_id", "n_chars", "copies")]
    out = signed.groupBy("block", F.shiftright("item", 2).alias("at")).agg(*of, *about)
    out = out.withColumn("next", F.lead("own").over(by_place)).filter(mine)

    def one(edited: str, following: str, times: Column) -> Column:
        sig, other = F.col("own.sig"), F.col(f"{edited}.sig")
        return F.struct(times.alias("times"), F.lower(F.hex(F.col(f"{edited}.sha"))).alias("edited_sha256"), other.alias("other"),
                        likeness(sig, other, p).alias("near_edited"), likeness(sig, F.col(f"{following}.sig"), p).alias("near_next"))

    # of equal rows all but the last are followed by an equal one; rows are multiplied in steps of bounded arrays
    kinds = F.array(one("edited", "next", F.lit(1).cast("long")), one("doubled", "own", F.col("copies") - 1))
    out = out.select("doc_id", "n_chars", F.col("own.sig").alias("sig"), F.explode(kinds).alias("r")).filter("r.times > 0")
    out = out.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("r.times") - 1) / _STEP))).alias("step"))
    out = out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(_STEP).cast("long"), F.col("r.times") - F.col("step") * _STEP))))
    return out.select("doc_id", "n_chars", "r.edited_sha256", printed(F.col("sig"), p).alias("fingerprint"),
                      printed(F.col("r.other"), p).alias("edited_fingerprint"), "r.near_edited", "r.near_next")
