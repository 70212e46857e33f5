"""MinHash near-deduplication with b-bit signatures (operator 1).

One pass over the texts gives each document the digest of its word sequence,
its number of distinct shingles, b low bits of each of its minima packed into
longs, and one hash per band of minima. Documents with equal word sequences
are one class from then on. In every band the member nearest to the middle of
its group is elected and compared with the others: signature bit counts give
the collision-corrected similarity, pairs clearly below the threshold are
dropped, the others are confirmed on their full shingle sets. Where a band
still holds several components, its members are told apart from its elected
one: two sets differ in what just one of their differences from it has, so a
pair at the threshold has differences that share many shingles and meets by
one of their rarest. What a family has in common is in none of its
differences, so its members do not meet by it. No step pairs up a group.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_words, cut, mix64
from .graph import components


#: Shingles before a row's own in its prefix that the row carries, to meet a partner once.
_BEFORE = 8


@dataclass(frozen=True)
class Params:
    """shingle words; bands x rows minima; threshold as similarity >= num / den.

    A pair at similarity s shares no band with probability (1 - s^rows)^bands:
    5e-6 at 0.8, 6e-9 at 0.85. ``margin`` standard deviations of the signature
    estimate are allowed below the threshold before a pair is dropped
    unconfirmed (chance 3e-6 at 0.8). ``hubs`` members of a band are elected
    one after the other before its members meet by their differences from the last.
    """

    shingle: int = 5
    bands: int = 40
    rows: int = 6
    num: int = 80
    den: int = 100
    margin: float = 4.5
    hubs: int = 3

    @property
    def least_matches(self) -> int:
        """Equal 4-bit minima a pair must have: mean at the threshold less ``margin`` deviations."""
        k, c = self.bands * self.rows, 1 / 16
        p = c + (1 - c) * self.num / self.den
        return max(0, int(np.floor(k * p - self.margin * np.sqrt(k * p * (1 - p)))))


def shingle_set(words: list[bytes], n: int) -> set:
    """Distinct runs of n words; fewer words: the whole sequence as one; none: empty."""
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(n)), strict=False))


def _constants(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_061)
    return (rng.integers(0, 1 << 32, size=(k, 1), dtype=np.uint32),
            rng.integers(0, 1 << 31, size=(k, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1))


def minima(words: list[bytes], n: int, xor: np.ndarray, mul: np.ndarray) -> np.ndarray:
    """The k smallest 32-bit hashes of the shingles (words must not be empty)."""
    h = np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words))
    m = max(1, len(words) - n + 1)
    x = np.zeros(m, dtype=np.uint64)
    for i in range(min(n, len(words))):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[i:i + m]
    x = (mix64(x) >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(xor), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, m, 1024):
        np.minimum(best, ((x[None, at:at + 1024] ^ xor) * mul).min(axis=1), out=best)
    return best


def pack_low_bits(best: np.ndarray) -> np.ndarray:
    """Four low bits of each (mixed) minimum, sixteen to a long."""
    low = mix64(best.astype(np.uint64)) & np.uint64(15)
    lanes = low.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(lanes, axis=1).astype(np.int64)


def band_hashes(best: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit hash per band of minima, the band's number included."""
    b = best.reshape(bands, -1).astype(np.uint64)
    acc = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(b.shape[1]):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + b[:, j])
    return acc.astype(np.int64)


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, seq (digest of the words; null: no words), n_shingles, sig (longs), bucket (longs)."""
    k = p.bands * p.rows
    if k % 16:
        raise ValueError("bands x rows must be a multiple of 16")
    xor, mul = _constants(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, size, sig, bucket = [], [], [], []
            for t in batch.column(1):
                words = byte_words(t.as_py())
                if not words:
                    seq.append(None), size.append(0), sig.append(None), bucket.append(None)
                    continue
                best = minima(words, p.shingle, xor, mul)
                seq.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                size.append(len(shingle_set(words, p.shingle)))
                sig.append(pack_low_bits(best))
                bucket.append(band_hashes(best, p.bands))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(seq, pa.binary()), pa.array(size, pa.int64()), pa.array(sig, longs),
                 pa.array(bucket, longs)], names=["doc_id", "seq", "n_shingles", "sig", "bucket"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, seq binary, n_shingles long, sig array<long>, bucket array<long>")


def matches(a: str, b: str, k: int) -> Column:
    """Number of equal 4-bit minima of two packed signatures, from bit counts of their xor."""
    def differing(i: int) -> Column:
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return F.lit(k) - reduce(lambda u, v: u + v, [differing(i) for i in range(k // 16)])


def confirmed(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    t1 = texts.select(F.col("doc_id").alias("ida"), F.col("text").alias("ta"))
    t2 = texts.select(F.col("doc_id").alias("idb"), F.col("text").alias("tb"))
    both = pairs.join(t1, F.col("a") == F.col("ida")).join(t2, F.col("b") == F.col("idb")).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, set] = (None, set())
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2), batch.column(3), strict=True):
                x, y = shingle_set(byte_words(ta.as_py()), p.shingle), tb.as_py()
                if y != last[0]:  # rows arrive by b: an elected member's set is built once per run
                    last = (y, shingle_set(byte_words(y), p.shingle))
                common = len(x & last[1])
                keep.append(p.den * common >= p.num * (len(x) + len(last[1]) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _elected(open_rows: DataFrame) -> DataFrame:
    """bucket, hub: the member of each bucket with the greatest weight (ties: smallest id)."""
    best = F.max(F.struct("weight", (-F.col("id")).alias("minus")))
    return cut(open_rows.groupBy("bucket").agg(best.alias("h")).select("bucket", (-F.col("h.minus")).alias("hub")), "minhash-hubs")


def differences(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """(ref, id, seq, nr, n, shingle): for every pair (id, hub), the digests of the shingles that only one of the two has.

    ref and seq are the digests of the hub's and the other's words, nr and n
    the sizes of their sets; a pair of equal sets has no rows.
    """
    t1 = texts.select(F.col("doc_id").alias("ida"), F.col("text").alias("ta"))
    t2 = texts.select(F.col("doc_id").alias("idb"), F.col("text").alias("tb"))
    both = pairs.join(t1, F.col("id") == F.col("ida")).join(t2, F.col("hub") == F.col("idb")).select("id", "ta", "tb")

    def digest(words: Iterable[bytes]) -> bytes:
        return hashlib.blake2b(b" ".join(words), digest_size=8).digest()

    def table(sets: list[tuple[tuple, int]], found: list[bytes]) -> pa.RecordBatch:
        size = np.array([k for _, k in sets], dtype=np.int64)
        same = [pa.array(np.repeat(np.array(c, dtype=np.int64), size)) for c in zip(*(x for x, _ in sets), strict=True)]
        return pa.RecordBatch.from_arrays([*same, pa.array(np.frombuffer(b"".join(found), dtype=np.int64))],
                                          names=["ref", "id", "seq", "nr", "n", "shingle"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, set, int] = (None, set(), 0)
        sets, found = [], []
        for batch in batches:
            for i, ta, tb in zip(*batch.columns, strict=True):
                y, words = tb.as_py(), byte_words(ta.as_py())
                if y != last[0]:
                    hub = byte_words(y)
                    last = (y, shingle_set(hub, p.shingle), int.from_bytes(digest(hub), "little", signed=True))
                x = shingle_set(words, p.shingle)
                only = x ^ last[1]
                seq = int.from_bytes(digest(words), "little", signed=True)
                sets.append(((last[2], i.as_py(), seq, len(last[1]), len(x)), len(only)))
                found += map(digest, only)
                if len(found) >= 1 << 16:
                    yield table(sets, found)
                    sets, found = [], []
        if sets:
            yield table(sets, found)

    return both.mapInArrow(run, "ref long, id long, seq long, nr long, n long, shingle long")


def rare_pairs(texts: DataFrame, labels: DataFrame, p: Params) -> DataFrame:
    """(a, b), a > b, that can reach the threshold, of those with one hub and different labels.

    ``labels`` has id, label, hub: the documents to pair and the elected member
    that each is told apart from; ``texts`` has the distinct (doc_id, text) of
    both. Two sets differ in what exactly one of their differences from the hub
    has, so the pair is at the threshold when the differences, of da and db
    shingles, share at least (da + db - (den - num) / (den + num) * (na + nb)) / 2.
    What a family has in common is in none of its differences. Two members
    within the threshold of their hub are linked by it; all others must share one
    of the first shingles in the order of rarity, and far enough from the end.
    """
    up, down = p.den + p.num, p.den - p.num  # at the threshold: up * difference <= down * (na + nb)
    rows = cut(differences(labels.select("id", "hub"), texts, p), "minhash-differences")
    seen = rows.groupBy("ref", "shingle").agg(F.count(F.lit(1)).alias("seen"))
    sets = (rows.join(seen, ["ref", "shingle"]).groupBy("ref", "id", "seq", "nr", "n")
            .agg(F.sort_array(F.collect_list(F.struct("seen", "shingle"))).alias("all"))
            .withColumn("d", F.size("all").cast("long"))
            .withColumn("near", F.col("d") * up <= (F.col("n") + F.col("nr")) * down))
    # shingles before the place from which the rest is too short, whatever partner: a member near the hub needs a far one
    near = (F.col("d") * up + (F.col("n") - F.col("nr")) * down) / (2 * up)
    far = F.least(F.col("n") * (2 * down), F.col("d") * p.num + F.col("n") * down) / (2 * p.num)
    enough = F.greatest(F.lit(0).cast("long"), F.floor(F.when(F.col("near"), near).otherwise(far)) + 1).cast("int")
    mine = ["ref", "id", "n", "d", "near"]
    prefix = sets.select(*mine, F.slice("all", F.lit(1), enough).alias("all"))
    # each with the shingles before it in the prefix that others have too, as far as they help
    shared = F.transform(F.filter("all", lambda e: e["seen"] > 1), lambda e: e["shingle"])
    prefix = prefix.select(*mine, shared.alias("shared"), F.posexplode("all").alias("place", "f"))
    at = F.array_position("shared", F.col("f.shingle"))
    first = F.greatest(F.lit(1).cast("long"), at - _BEFORE)
    before = F.slice("shared", first.cast("int"), (at - first).cast("int"))
    prefix = prefix.filter("f.seen > 1").select(*mine, (F.col("d") - F.col("place")).alias("rest"), "f.shingle",
                                                before.alias("before"))
    prefix = cut(prefix.join(labels.select("id", "label").distinct(), "id"), "minhash-prefix")
    split = cut(prefix.groupBy("ref", "shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
                .filter("lo < hi").select("ref", "shingle"), "minhash-prefix-split")
    prefix = cut(prefix.join(split, ["ref", "shingle"]), "minhash-prefix")
    x, y = (prefix.select("ref", "shingle", *(F.col(c).alias(c + side) for c in ("id", "n", "d", "near", "rest", "label", "before")))
            for side in "ab")
    fits = F.least("na", "nb") * p.den >= F.greatest("na", "nb") * p.num
    # what the differences can still share from here on (itself included) must do
    reach = (F.col("da") + F.col("db") - F.least("resta", "restb") * 2) * up <= (F.col("na") + F.col("nb")) * down
    # a pair that shares an earlier shingle has met there already; its first common one always counts
    both = x.join(y, (x["ref"] == y["ref"]) & (x["shingle"] == y["shingle"]) & (F.col("ida") > F.col("idb"))
                  & (F.col("labela") != F.col("labelb")) & ~(F.col("neara") & F.col("nearb")) & fits & reach
                  & ~F.arrays_overlap("beforea", "beforeb"))
    return both.select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct()


def near_groups(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Words are runs of other than ASCII white space, A-Z lower-cased, of whole
    texts. Null, empty and blank texts have no shingles and link with nothing.
    Rows with a null doc_id have no identity to link by: they form their own
    component (null) and are kept. Rows that repeat an id all get the smallest
    component among their texts. Other columns are ignored; an empty
    table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    all_rows = cut(signatures(docs, p), "minhash-signatures")
    known = all_rows.filter("seq is not null and doc_id is not null")
    # classes of equal word sequences; the representative table is written, so a hot class can be split in the join
    reps = cut(known.groupBy("seq").agg(F.min("doc_id").alias("rep")), "minhash-classes")
    members = known.select("doc_id", "seq").join(reps, "seq").select("doc_id", "rep")
    rep_sig = cut(known.join(reps, "seq").filter("doc_id = rep").dropDuplicates(["seq"])
                  .select(F.col("rep").alias("id"), "sig", "bucket"), "minhash-reps")
    band = rep_sig.select(F.explode("bucket").alias("bucket"), "id").distinct()
    shared = band.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n"))
    shared = cut(shared.filter("lo < hi").select("bucket", "n"), "minhash-shared")
    first = cut(band.join(shared, "bucket").select("bucket", "id", "n"), "minhash-open")
    # members of the fullest bands are nearest to the middle of their group: they are elected first
    weight = cut(first.groupBy("id").agg(F.sum("n").alias("weight")), "minhash-weights")
    open_rows = cut(first.select("bucket", "id").join(weight, "id").select("bucket", "id", "weight"), "minhash-open")
    sig = rep_sig.select("id", "sig")
    cand_ids = weight.select(F.col("id").alias("cand"))
    texts = cut(docs.join(cand_ids, F.col("doc_id") == F.col("cand"), "left_semi"), "minhash-texts")

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs whose signatures, and then whose full sets, reach the threshold."""
        s1 = sig.select(F.col("id").alias("a"), F.col("sig").alias("sa"))
        s2 = sig.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
        likely = pairs.join(s1, "a").join(s2, "b").filter(matches("sa", "sb", p.bands * p.rows) >= p.least_matches)
        return cut(confirmed(cut(likely.select("a", "b"), "minhash-likely"), texts, p), "minhash-links")

    edges: DataFrame | None = None
    for _ in range(p.hubs):
        if open_rows.isEmpty():
            break
        hubs = _elected(open_rows)
        tried = open_rows.join(hubs, "bucket").filter(F.col("id") != F.col("hub"))
        found = links(tried.select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct())
        edges = found if edges is None else edges.unionByName(found)
        # elected members are done in their buckets; buckets with one component left are done
        rest = open_rows.select("bucket", "id", "weight").join(
            hubs.select("bucket", F.col("hub").alias("id")), ["bucket", "id"], "left_anti")
        labels = components(edges)
        rest = cut(rest.join(labels, F.col("id") == F.col("node"), "left")
                   .select("bucket", "id", "weight", F.coalesce("component", "id").alias("label")), "minhash-rest")
        split = cut(rest.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
                    .filter("lo < hi").select("bucket"), "minhash-split")
        open_rows = cut(rest.join(split, "bucket", "left_semi"), "minhash-open")
    if edges is not None and not open_rows.isEmpty():
        left = cut(open_rows.join(hubs, "bucket").select("id", "label", "hub").distinct(), "minhash-left")
        ids = left.select(F.col("id").alias("lid")).union(left.select("hub"))
        some = texts.join(ids, F.col("doc_id") == F.col("lid"), "left_semi")
        some = cut(some.dropDuplicates(["doc_id", "text"]), "minhash-some")  # written, so a hot hub can be split in the join
        edges = edges.unionByName(links(rare_pairs(some, left, p)))
    if edges is not None:
        members = cut(members, "minhash-members").join(components(edges), F.col("rep") == F.col("node"), "left")
    else:
        members = members.withColumn("component", F.col("rep"))
    comp = (members.select(F.col("doc_id").alias("member"), F.coalesce("component", "rep").alias("component_id"))
            .groupBy("member").agg(F.min("component_id").alias("component_id")))
    out = all_rows.select("doc_id", "n_shingles").join(comp, F.col("doc_id") == F.col("member"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                      F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"))


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group stays (five words, similarity 0.8 or more)."""
    gone = near_groups(docs).filter("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
