"""Suffix-array deduplication of repeated byte strings (operator 4).

Every 200-byte window belongs to its minimizer, the window's leftmost smallest
hashed gram, so equal windows share that gram wherever they occur. Grams that
occur once in the corpus settle all their windows. What is left is cut out of
the documents and goes through per-shard suffix arrays (Larsson-Sadakane
refinement, Kasai common prefixes), which find the repeats inside a shard; the
first copy of each window in a shard is then merged with the other shards,
routed by its gram, by binary search over sorted window keys. Grams with very
many such windows (a line that stands in many documents) are not routed whole:
each of their windows meets its equals by its own key.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64

GRAM = 64
SHARD_BYTES = 1 << 20
HOT_WINDOWS = 1 << 16  # first copies of one gram that may meet in one task
PIECE = 1 << 20  # long documents are hashed in overlapping pieces of this size
_POS_BITS = np.uint64(21)


def minimizers(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, gram hash) of each run of windows with the same leftmost smallest gram."""
    first, last, gram = [], [], []
    for at in range(0, max(1, len(data) - length + 1), PIECE):
        x = data[at:at + PIECE + length - 1]
        if len(x) < length:
            break
        h = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        span = 1
        while span < GRAM:
            h = h[:-span] * np.uint64(0x94D049BB133111EB) + h[span:]
            h ^= h >> np.uint64(31)
            span *= 2
        h *= np.uint64(0x9E3779B97F4A7C15)
        low = (h >> _POS_BITS) << _POS_BITS | np.arange(len(h), dtype=np.uint64)
        width, have = length - GRAM + 1, 1
        while have * 2 <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            low = np.minimum(low[:-(width - have)], low[width - have:])
        pos = (low & ((np.uint64(1) << _POS_BITS) - np.uint64(1))).astype(np.int64)
        edge = np.flatnonzero(np.diff(pos)) + 1
        a, b = np.concatenate([[0], edge]), np.concatenate([edge, [len(pos)]]) - 1
        first.append(a + at), last.append(b + at), gram.append(h[pos[a]].view(np.int64))
    if not first:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    return np.concatenate(first), np.concatenate(last), np.concatenate(gram)


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their first ``depth`` bytes or more (zeros follow the end).

    Larsson-Sadakane: groups of equal prefixes are split by the group of the
    position one prefix further on, which doubles the prefix each round; groups
    of one are finished and not touched again.
    """
    n = len(data)
    eight = words8(data)
    order = np.argsort(eight)
    key = eight[order]
    slot = np.arange(n)
    rank = np.zeros(n + depth + 1, dtype=np.int64)
    h = 8
    while True:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.flatnonzero(new)
        size = np.diff(np.concatenate([head, [len(key)]]))
        rank[order[slot]] = np.repeat(slot[head], size) + 1
        open_slots = slot[np.repeat(size > 1, size)]
        if h >= depth or not len(open_slots):
            return order
        idx = order[open_slots]
        key = (rank[idx] << 32) | rank[np.minimum(idx + h, n)]
        o = np.argsort(key)
        order[open_slots], key, slot = idx[o], key[o], open_slots
        h *= 2


def words8(data: np.ndarray) -> np.ndarray:
    """Big-endian value of the eight bytes from each position on (zeros follow the end)."""
    p = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    out = p[:-8].copy()
    for i in range(1, 8):
        out = (out << np.uint64(8)) | p[i:len(p) - 8 + i]
    return out


def common_prefixes(data: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Kasai: for each slot the common prefix (at most ``cap``) of its suffix with the one before it in ``order``.

    Positions are walked in text order, where a prefix shrinks by one at most;
    runs of 256 positions are walked side by side.
    """
    n = len(data)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    words = -(-cap // 8)
    w = np.concatenate([words8(data), np.zeros(2 * cap + 32, dtype=np.uint64)])
    out = np.zeros(n, dtype=np.int64)
    lane = np.arange(0, n, 256)
    have = np.zeros(len(lane), dtype=np.int64)
    for t in range(256):
        p = lane + t
        if p[-1] >= n:  # only the last run is shorter
            lane, have, p = lane[:-1], have[:-1], p[:-1]
            if not len(p):
                break
        q = before[p]
        h = np.where((have < cap) & (q >= 0), np.maximum(have - 1, 0), 0)  # ties beyond the cap are in any order
        more = equal_bytes(w[p + h] ^ w[q + h])
        h += more
        go = np.flatnonzero(more == 8)
        if len(go):  # the rest of a long prefix in one look
            at = h[go, None] + np.arange(0, 8 * words, 8)
            diff = w[p[go, None] + at] ^ w[q[go, None] + at]
            differs = diff != 0
            first = differs.argmax(axis=1)
            lead = 8 * first + equal_bytes(diff[np.arange(len(go)), first])
            h[go] += np.where(differs.any(axis=1), lead, cap)
        have = np.where(q >= 0, np.minimum(h, np.minimum(cap, n - np.maximum(p, q))), 0)
        out[p] = have
    return out[order]


_BYTE_STEPS = np.array([1 << (8 * k) for k in range(8)], dtype=np.uint64)


def equal_bytes(diff: np.ndarray) -> np.ndarray:
    """Number of leading zero bytes of each 64-bit difference (8 when all are equal)."""
    return 8 - np.searchsorted(_BYTE_STEPS, diff, side="right")


def window_keys(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of every window of ``length`` bytes, composed from those of its binary parts."""
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        part, span = mix64(data.astype(np.uint64) + np.uint64(salt)), 1
        key, done, rest = None, 0, length
        while rest:
            if rest & 1:
                tail = part[done:]
                if key is None:
                    key = tail
                else:
                    m = min(len(key), len(tail))
                    key = mix64(key[:m] * np.uint64(salt) + tail[:m])
                done += span
            rest >>= 1
            if rest:
                m = max(0, len(part) - span)
                part = mix64(part[:m] * np.uint64(salt) + part[span:span + m])
                span *= 2
        out.append(key[:max(0, len(data) - length + 1)])
    return out[0], out[1]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of each run of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


_OUT = "tid binary, lo long, hi long, gram long, bytes binary"
_FIELDS = ["tid", "lo", "hi", "gram", "bytes"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=_FIELDS)


def shard_repeats(shard: list[tuple[bytes, np.ndarray, tuple]], length: int) -> Iterator[tuple]:
    """Rows for one shard of (tid, bytes, (first, last, gram) of its repeated grams).

    Without bytes: windows lo .. hi have a copy inside the shard. With bytes: a
    stretch of windows with the first copy of something, for the merge.
    """
    spans, parts, at = [], [], 0
    for tid, data, (first, last, gram) in shard:
        flags = np.zeros(len(data) + 1, dtype=np.int32)
        np.add.at(flags, first, 1)
        np.add.at(flags, last + 1, -1)
        for lo, hi in zip(*runs(np.cumsum(flags)[:-1] > 0), strict=True):
            parts.append(data[lo:hi + length])
            spans.append((tid, data, lo, hi, at, first, last, gram))
            at += hi + length - lo
    if not parts:
        return
    text = np.concatenate(parts)
    n = len(text)
    valid = np.zeros(n, dtype=bool)
    for _, _, lo, hi, begin, *_ in spans:
        valid[begin:begin + hi - lo + 1] = True
    order = suffix_order(text, length)
    lcp = common_prefixes(text, order, length)
    group = np.cumsum(lcp < length)  # equal windows have one group number; windows over a seam are not counted
    ok = valid[order]
    order, group = order[ok], group[ok]
    new = np.concatenate([[True], group[1:] != group[:-1]])
    head = np.flatnonzero(new)
    size = np.diff(np.concatenate([head, [len(group)]]))
    copied, leads = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    copied[order[np.repeat(size > 1, size)]] = True
    leads[np.minimum.reduceat(order, head)] = True
    for tid, data, lo, hi, begin, first, last, gram in spans:
        here = slice(begin, begin + hi - lo + 1)
        for a, b in zip(*runs(copied[here]), strict=True):
            yield tid, int(a + lo), int(b + lo), 0, None
        lead = np.flatnonzero(leads[here]) + lo
        i0, i1 = np.searchsorted(first, lo), np.searchsorted(first, hi, "right")
        left = np.searchsorted(lead, first[i0:i1])
        right = np.searchsorted(lead, last[i0:i1], "right")
        for k in np.flatnonzero(right > left):
            a, b = int(lead[left[k]]), int(lead[right[k] - 1])
            yield tid, a, b, int(gram[i0 + k]), data[a:b + length].tobytes()


def stretch_keys(stretches: list[tuple], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset of each stretch's first window and the end, both keys of all windows) of stretches (tid, lo, hi, gram, bytes)."""
    # keys of all bytes at once; windows over a seam between two stretches are left out
    ends = np.cumsum([len(c[4]) for c in stretches])
    whole = np.frombuffer(b"".join([c[4] for c in stretches]), dtype=np.uint8)
    count = np.array([c[2] - c[1] + 1 for c in stretches])
    edge = np.concatenate([[0], np.cumsum(count)])
    begin = ends - np.array([len(c[4]) for c in stretches])
    at_byte = np.repeat(begin - edge[:-1], count) + np.arange(edge[-1])
    k1, k2 = (k[at_byte] for k in window_keys(whole, length))
    return edge, k1, k2


def _solve(chunk: list[tuple], carry: tuple | None, more: bool, length: int) -> tuple[list[tuple], tuple | None]:
    """(flagged windows of a chunk of stretches and of ``carry``, distinct windows to carry on of the last gram)."""
    edge, k1, k2 = stretch_keys(chunk, length)
    order = np.lexsort((k2, k1))
    s1, s2 = k1[order], k2[order]
    head = np.flatnonzero(np.concatenate([[True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])]))
    size = np.diff(np.concatenate([head, [len(order)]]))
    hit = np.zeros(len(order), dtype=bool)
    hit[order[np.repeat(size > 1, size)]] = True
    out: list[tuple] = []
    if carry is not None:  # windows of earlier chunks, sorted by their first key
        c1, c2, holder, window, told = carry
        at = np.searchsorted(c1, k1)
        at[at == len(c1)] = 0
        match = (c1[at] == k1) & (c2[at] == k2)
        hit |= match
        for i in np.unique(at[match]):
            if not told[i]:
                told[i] = True
                out.append((holder[i], int(window[i]), int(window[i]), 0, None))
    opens = np.zeros(len(hit), dtype=bool)
    opens[edge[:-1]] = True
    start_at = np.flatnonzero(hit & (opens | ~np.concatenate([[False], hit[:-1]])))
    shut = np.concatenate([opens[1:] | ~hit[1:], [True]])
    end_at = np.flatnonzero(hit & shut)
    owner = np.searchsorted(edge, start_at, "right") - 1
    for i, x, y in zip(owner.tolist(), (start_at - edge[owner]).tolist(), (end_at - edge[owner]).tolist(), strict=True):
        out.append((chunk[i][0], x + chunk[i][1], y + chunk[i][1], 0, None))
    if not more:
        return out, None
    start = next(i for i, c in enumerate(chunk) if c[3] == chunk[-1][3])  # stretches of one gram are neighbours
    lead = order[head]
    lead = lead[lead >= edge[start]]
    owner = np.searchsorted(edge, lead, "right") - 1
    held = (k1[lead], k2[lead], [chunk[i][0] for i in owner],
            np.array([chunk[i][1] for i in owner]) + lead - edge[owner], hit[lead])
    if carry is not None and start == 0:  # the whole chunk is of the carried gram
        new = np.flatnonzero(~np.isin(held[0], carry[0]))
        o = np.argsort(np.concatenate([carry[0], held[0][new]]), kind="stable")
        holder = carry[2] + [held[2][i] for i in new]
        held = (np.concatenate([carry[0], held[0][new]])[o], np.concatenate([carry[1], held[1][new]])[o],
                [holder[i] for i in o], np.concatenate([carry[3], held[3][new]])[o],
                np.concatenate([carry[4], held[4][new]])[o])
    return out, held


def merged_repeats(rows: Iterator[tuple], length: int, chunk_bytes: int = 4 * SHARD_BYTES) -> Iterator[tuple]:
    """Windows that occur in more than one stretch, from stretches (tid, lo, hi, gram, bytes) in gram order.

    Stretches are taken in chunks; the distinct windows of a gram that goes on
    into the next chunk are kept as a sorted list, into which the next chunk is
    merged by binary search. Memory is a chunk and one gram's distinct windows.
    """
    carry: tuple | None = None
    carried: int | None = None
    chunk: list[tuple] = []
    total = 0
    for r in rows:
        if chunk and total >= chunk_bytes:
            more = r[3] == chunk[-1][3]
            use = carry if carried == chunk[0][3] else None
            out, carry = _solve(chunk, use, more, length)
            carried = r[3] if more else None
            yield from out
            chunk, total = [], 0
        chunk.append(r)
        total += len(r[4])
    if chunk:
        yield from _solve(chunk, carry if carried == chunk[0][3] else None, False, length)[0]


def hot_repeats(stretches: DataFrame, length: int) -> DataFrame:
    """(tid, lo, hi) of the windows that occur in more than one stretch, each window a row dealt by its keys.

    Shards hold a first copy each, so the windows of one key grow with the
    shards, not with the documents; the join is a plain exchange.
    """
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = list(zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True))
                edge, k1, k2 = stretch_keys(part, length)
                count = np.diff(edge)
                lo = np.arange(edge[-1]) + np.repeat(np.array([c[1] for c in part]) - edge[:-1], count)
                tid = pa.array([c[0] for c in part], pa.binary()).take(pa.array(np.repeat(np.arange(len(part)), count)))
                yield pa.RecordBatch.from_arrays(
                    [tid, pa.array(lo, pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))],
                    names=["tid", "lo", "k1", "k2"])

    each = cut(stretches.select(*_FIELDS).mapInArrow(windows, "tid binary, lo long, k1 long, k2 long"), "suffix-windows")
    again = each.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = again.select(F.col("k1").alias("r1"), F.col("k2").alias("r2"))
    found = each.join(again, (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")), "left_semi")
    return found.select("tid", "lo", F.col("lo").alias("hi"))


def repeated_bytes(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per input row.

    Removed are the bytes covered by a ``length``-byte string that starts more
    than once in the whole table (same document included, overlaps counted,
    judged on the input). Null text is empty; texts shorter than ``length``
    keep everything. Rows are told apart by their text, so equal texts of any
    ids, null and repeated ids included, lose all their bytes together when long
    enough. Other columns are ignored; an empty table gives no rows.
    """
    if length < GRAM:
        raise ValueError(f"strings shorter than {GRAM} bytes are not supported")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = cut(docs.select("doc_id", F.unhex(F.sha2(raw, 256)).alias("sha"), F.octet_length(raw).alias("n_bytes")),
               "suffix-rows").withColumn("tid", F.substring("sha", 1, 16))
    # one copy of every text long enough, with its grams
    row_key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    kinds = cut(rows.groupBy("tid").agg(F.count(F.lit(1)).alias("copies"), F.min(row_key).alias("one")), "suffix-texts")
    long_texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") >= length)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tids, found, many = [], [], []
            for text in batch.column(0):
                data = np.frombuffer(text.as_py().encode(), dtype=np.uint8)
                g, n = np.unique(minimizers(data, length)[2], return_counts=True)
                tids.append(hashlib.sha256(data).digest()[:16]), found.append(g), many.append(n > 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tids, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(many, pa.list_(pa.bool_()))],
                names=["tid", "grams", "many"])

    per_text = cut(long_texts.mapInArrow(grams, "tid binary, grams array<long>, many array<boolean>"), "suffix-grams")
    each = per_text.select("tid", F.explode(F.arrays_zip("grams", "many")).alias("g")).select(
        "tid", F.col("g.grams").alias("gram"), F.col("g.many").alias("many"))
    # a gram matters if two different texts have it, or one text has it twice
    both = each.groupBy("gram").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi"), F.max("many").alias("many"))
    repeated = cut(both.filter("many or lo <> hi").select("gram"), "suffix-repeated")
    wanted = each.select("tid", "gram").join(repeated, "gram").groupBy("tid").agg(F.collect_set("gram").alias("wanted"))
    wanted = wanted.join(kinds.select(F.col("tid").alias("ktid"), "one"), F.col("tid") == F.col("ktid"))
    wanted = cut(wanted.select("tid", "one", "wanted"), "suffix-wanted")
    # the text of one row of each: copies of a text never meet in one task
    source = docs.select(row_key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    texts = source.join(wanted, F.col("key") == F.col("one")).filter(F.col("tid") == F.unhex(F.substring(
        F.sha2(F.col("text").cast("binary"), 256), 1, 32)))
    texts = cut(texts.dropDuplicates(["key", "tid"]).select("tid", "text", "wanted"), "suffix-candidates")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, total = [], 0
        for batch in batches:
            for t, text, want in zip(*batch.columns, strict=True):
                data = np.frombuffer(text.as_py().encode(), dtype=np.uint8)
                first, last, gram = minimizers(data, length)
                keep = np.isin(gram, np.asarray(want.values))
                first, last, gram = first[keep], last[keep], gram[keep]
                shard.append((t.as_py(), data, (first, last, gram)))
                total += int((last - first + length).sum())
                if total >= SHARD_BYTES:
                    yield _batch(list(shard_repeats(shard, length)))
                    shard, total = [], 0
        if shard:
            yield _batch(list(shard_repeats(shard, length)))

    local = cut(texts.select("tid", "text", "wanted").mapInArrow(shards, _OUT), "suffix-shards")
    leads = local.filter("bytes is not null")
    hot = leads.groupBy("gram").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("windows"))
    # at most one gram for every HOT_WINDOWS windows of the corpus
    hot = F.broadcast(cut(hot.filter(F.col("windows") > HOT_WINDOWS).select(F.col("gram").alias("hot")), "suffix-hot"))
    stretches = leads.join(hot, F.col("gram") == F.col("hot"), "left_anti").repartition("gram").sortWithinPartitions("gram")
    crowds = hot_repeats(leads.join(hot, F.col("gram") == F.col("hot"), "left_semi"), length)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_in = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held: list[tuple] = []
        for row in merged_repeats(rows_in, length):
            held.append(row)
            if len(held) >= 10_000:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    across = cut(stretches.select(*_FIELDS).mapInArrow(merge, _OUT).select("tid", "lo", "hi"), "suffix-across")
    flagged = local.filter("bytes is null").select("tid", "lo", "hi").unionByName(across).unionByName(crowds)
    windows = flagged.groupBy("tid").agg(F.collect_list(F.struct("lo", "hi")).alias("windows"))
    again = windows.withColumnRenamed("tid", "wtid").join(texts.select("tid", "text"), F.col("wtid") == F.col("tid"))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, text, win in zip(*batch.columns, strict=True):
                data = np.frombuffer(text.as_py().encode(), dtype=np.uint8)
                lo, hi = (np.asarray(win.values.field(k)) for k in (0, 1))
                flags = np.zeros(len(data) + 1, dtype=np.int64)
                np.add.at(flags, lo, 1)
                np.add.at(flags, hi + length, -1)
                gone = np.cumsum(flags)[:-1] > 0
                out.append((t.as_py(), int(gone.sum()), len(runs(gone)[0]), hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            kinds_ = (pa.binary(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds_)],
                                             names=["rtid", "r_bytes", "r_spans", "r_sha"])

    cleaned = cut(again.select("tid", "text", "windows").mapInArrow(
        removed, "rtid binary, r_bytes long, r_spans long, r_sha string"), "suffix-cleaned")
    out = rows.join(kinds.select(F.col("tid").alias("ktid"), "copies"), F.col("tid") == F.col("ktid"))
    out = out.join(cleaned, F.col("tid") == F.col("rtid"), "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id", F.col("n_bytes").cast("long").alias("n_bytes"),
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("r_bytes", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("r_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("r_sha", F.lower(F.hex("sha")))).alias("kept_sha256"))
