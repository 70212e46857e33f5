"""Prefix trie of conversations (operator 12): a minimal perfect hash over prefix digests.

The digest of a conversation's first d turns is the exclusive or of hashes of
(position, turn), so all prefixes of all conversations come from running
aggregates; one grouped count over digests gives the distinct prefixes. That
every digest stands for one prefix is verified (its rows must agree in depth,
parent digest and turn content); otherwise another seed is taken.

Sums over subtrees: every node is charged to its smallest conversation, and a
conversation's path lies in one shard. A shard gives each of its digests a
slot by a minimal perfect hash, looks slots up with verification against the
stored digests, scatters its nodes into flat numpy arrays and adds them into
their parents' slots from the deepest up; the shards' sums of a node are then
added by one grouped sum.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, cut, in_order, mix64

#: Rows a shard should hold, turns between two stored prefix totals, depth handled at once, ids of a joined piece.
SHARD_ROWS, STRIDE, BAND, PIECE = 1 << 18, 4096, 1 << 16, 4096
_CONTENT = [f"t{i}" for i in range(4)]


class PerfectHash:
    """Slots 0..n-1 for n distinct (a, b) pairs of 64-bit digests; foreign pairs are recognised.

    Levels of hash tables: a pair that is alone in its cell is placed there, the
    others go on to the next level; a placed pair's slot is the number of
    placed cells before its own. The pairs are stored by slot, and every
    lookup is compared with them.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, int]] = []
        self.a, self.b = np.zeros_like(a), np.zeros_like(b)
        left, base = np.arange(len(a)), 0
        while len(left):
            cells = max(1, 2 * len(left))
            h = self._cell(a[left], b[left], len(self.levels), cells)
            alone = np.bincount(h, minlength=cells) == 1
            self.levels.append((np.where(alone, base + np.cumsum(alone) - 1, -1), cells))
            placed = alone[h]
            slots = self.levels[-1][0][h[placed]]
            self.a[slots], self.b[slots] = a[left[placed]], b[left[placed]]
            base += int(alone.sum())
            left = left[~placed]

    @staticmethod
    def _cell(a: np.ndarray, b: np.ndarray, level: int, cells: int) -> np.ndarray:
        x = mix64(a.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        return (mix64(x ^ b.view(np.uint64)) % np.uint64(cells)).astype(np.int64)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each pair, -1 for pairs that are not in the table."""
        out, left = np.full(len(a), -1), np.arange(len(a))
        for level, (table, cells) in enumerate(self.levels):
            if not len(left):
                break
            got = table[self._cell(a[left], b[left], level, cells)]
            out[left] = got
            left = left[got < 0]
        found = np.flatnonzero(out >= 0)
        wrong = (self.a[out[found]] != a[found]) | (self.b[out[found]] != b[found])
        out[found[wrong]] = -1
        return out


def subtree_sums(p1: np.ndarray, p2: np.ndarray, q1: np.ndarray, q2: np.ndarray, depth: np.ndarray,
                 values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct digests of the rows and, for each, the sums of the values in its subtree.

    A row is a digest, its parent's digest, its depth and values; digests may
    repeat. Parents that are not among the digests end a path.
    """
    order = np.lexsort((p2, p1))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (p1[order][1:] != p1[order][:-1]) | (p2[order][1:] != p2[order][:-1])
    first = order[new]
    table = PerfectHash(p1[first], p2[first])
    n = len(first)
    own = table.slots(p1, p2)
    deep, parent = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    deep[own] = depth
    parent[own] = table.slots(q1, q2)
    sums = [np.zeros(n, dtype=np.int64) for _ in values]
    for s, v in zip(sums, values, strict=True):
        np.add.at(s, own, v)
    by_depth = np.argsort(deep, kind="stable")
    edges = np.flatnonzero(np.diff(deep[by_depth])) + 1
    for slots in reversed(np.split(by_depth, edges)):
        slots = slots[parent[slots] >= 0]
        for s in sums:
            np.add.at(s, parent[slots], s[slots])
    return table.a, table.b, sums


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, at from 1, words, content), (conv_id, n)): turns in order, and conversations."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = (conversations.filter("conv_id is not null")
            .select(F.col("conv_id").cast("long").alias("conv_id"), "turn", count_words("text").alias("words"), content.alias("sha")))
    rows = in_order(cut(rows, "trie-turns"), ["conv_id", F.col("turn").asc_nulls_first(), "sha"], "trie-order")
    convs = cut(rows.groupBy(F.col("conv_id").alias("id")).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")),
                "trie-conversations")
    rows = rows.join(convs, F.col("conv_id") == F.col("id"))
    pieces = [F.conv(F.substring("sha", 16 * i + 1, 16), 16, -10).cast("long").alias(t) for i, t in enumerate(_CONTENT)]
    rows = rows.select("conv_id", (F.col("pos") - F.col("first") + 1).alias("at"), "words", *pieces)
    return cut(rows, "trie-turns"), convs.select(F.col("id").alias("conv_id"), "n")


def rebuilt(turns: DataFrame, convs: DataFrame, period: int = 20, spread: int = 4) -> tuple[DataFrame, DataFrame]:
    """((c, d, words, content), (c, n)): the first h turns of conversation c - c % period, then c's own after its first h."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread
    c = convs.select(F.col("conv_id").alias("c"), "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % period).alias("donor"))
    donors = convs.filter(F.col("conv_id") % period == 0).select(F.col("conv_id").alias("donor"), F.col("n").alias("has"))
    plan = c.join(donors, "donor", "left")
    plan = cut(plan.select("c", "h", "donor", "n", F.least("h", F.coalesce("has", F.lit(0))).alias("lent")), "trie-plan")
    lent = (turns.filter((F.col("conv_id") % period == 0) & (F.col("at") < spread))
            .join(plan, F.col("conv_id") == F.col("donor")).filter("at <= h").select("c", F.col("at").alias("d"), "words", *_CONTENT))
    own = (turns.join(plan, F.col("conv_id") == F.col("c")).filter("at > h")
           .select("c", (F.col("lent") + F.col("at") - F.col("h")).alias("d"), "words", *_CONTENT))
    return (cut(lent.unionByName(own), "trie-rebuilt"),
            plan.select("c", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")))


def prefixes(rows: DataFrame, seed: int) -> DataFrame:
    """Adds the digest (p1, p2) of the prefix that ends with a row, and (q1, q2) of the one before."""
    for i in (1, 2):
        rows = rows.withColumn(f"g{i}", F.xxhash64(F.lit(2 * seed + i).cast("long"), F.col("d"), *_CONTENT))
    rows = rows.withColumn("block", F.floor((F.col("d") - 1) / STRIDE))
    inside = Window.partitionBy("c", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    long_ones = rows.filter(F.col("d") > STRIDE).select(F.col("c").alias("lc")).distinct()
    totals = rows.join(cut(long_ones, "trie-long"), F.col("c") == F.col("lc"), "left_semi").groupBy("c", "block").agg(
        *[F.bit_xor(f"g{i}").alias(f"s{i}") for i in (1, 2)])
    totals = cut(totals.select("c", "block", *[F.coalesce(F.bit_xor(f"s{i}").over(before), F.lit(0)).alias(f"o{i}")
                                               for i in (1, 2)]), "trie-offsets")
    rows = rows.select("*", *[F.bit_xor(f"g{i}").over(inside).alias(f"x{i}") for i in (1, 2)])
    rows = rows.join(totals, ["c", "block"], "left")
    ps = [F.col(f"x{i}").bitwiseXOR(F.coalesce(f"o{i}", F.lit(0))).alias(f"p{i}") for i in (1, 2)]
    rows = rows.select("c", "d", "words", *_CONTENT, *ps, "g1", "g2")
    return rows.select("c", "d", "words", *_CONTENT, "p1", "p2",
                       *[F.col(f"p{i}").bitwiseXOR(F.col(f"g{i}")).alias(f"q{i}") for i in (1, 2)])


def verified_nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with digests, distinct prefixes p1, p2, q1, q2, depth, conv_id, n_convs, words), collisions excluded."""
    seed = 0
    while True:
        marked = cut(prefixes(rows, seed), "trie-prefixes")
        same = ["d", "q1", "q2", *_CONTENT]
        nodes = cut(marked.groupBy("p1", "p2").agg(
            F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id"), F.max("words").alias("words"),
            *[F.min(x).alias(x) for x in same], *[F.max(x).alias(f"{x}_") for x in same]), "trie-nodes")
        differs = " or ".join(f"{x} <> {x}_" for x in same)
        if nodes.filter(f"{differs} or (p1 = 0 and p2 = 0)").isEmpty():  # (0, 0) is the root's
            return marked, nodes.select("p1", "p2", "q1", "q2", F.col("d").alias("depth"), "conv_id", "n_convs", "words")
        seed += 1


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtree sums of one shard: columns c, p1, p2, q1, q2, d, saved, leaves in; p1, p2, saved, leaves out."""
    got = [[col.to_numpy(zero_copy_only=False) for col in b.columns[1:]] for b in batches if b.num_rows]
    if not got:
        return
    p1, p2, q1, q2, d, saved, leaves = (np.concatenate(cols) for cols in zip(*got, strict=True))
    a, b, (s, n) = subtree_sums(p1, p2, q1, q2, d, [saved, leaves])
    for at in range(0, len(a), 1 << 16):
        part = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (a, b, s, n)], names=["p1", "p2", "saved", "leaves"])


def accumulated(marked: DataFrame, nodes: DataFrame, shard_rows: int = SHARD_ROWS, band: int = BAND) -> DataFrame:
    """p1, p2, saved, leaves: sums over the subtree of every node.

    ``nodes`` carry their own saved and leaves. Depths are handled ``band`` at
    a time from the deepest up, so that not even one conversation's path is
    unbounded in a task; nodes at the top of a band pass their sums on.
    """
    zero = F.lit(0).cast("long")
    owners = nodes.select(F.col("conv_id").alias("oc")).distinct()
    paths = marked.join(owners, F.col("c") == F.col("oc"), "left_semi").select(
        "c", "p1", "p2", "q1", "q2", "d", zero.alias("saved"), zero.alias("leaves"))
    own = nodes.select(F.col("conv_id").alias("c"), "p1", "p2", "q1", "q2", F.col("depth").alias("d"), "saved", "leaves")
    rows = cut(paths.unionByName(own), "trie-paths")
    deepest = rows.agg(F.max("d")).first()[0] or 0
    out: DataFrame | None = None
    carry: DataFrame | None = None
    for low in range((max(deepest, 1) - 1) // band * band, -1, -band):
        part = rows.filter((F.col("d") > low) & (F.col("d") <= low + band))
        if carry is not None:
            part = part.unionByName(carry)
        shards = max(1, -(-part.count() // shard_rows))
        got = part.repartition(shards, "c").mapInArrow(_shard, "p1 long, p2 long, saved long, leaves long")
        got = cut(got.groupBy("p1", "p2").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")), "trie-sums")
        out = got if out is None else out.unionByName(got)
        if low:
            top = got.join(own.filter(F.col("d") == low + 1).select("p1", "p2", F.col("q1").alias("u1"), F.col("q2").alias("u2")),
                           ["p1", "p2"]).groupBy("u1", "u2").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
            up = own.filter(F.col("d") == low).drop("saved", "leaves")
            carry = cut(up.join(top, (F.col("p1") == F.col("u1")) & (F.col("p2") == F.col("u2"))).select(
                "c", "p1", "p2", "q1", "q2", "d", "saved", "leaves"), "trie-carry")
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (p1, p2, c) to (p1, p2, first id, up to PIECE ids joined by commas)."""
    for batch in batches:
        p1, p2, c = (col.to_numpy(zero_copy_only=False) for col in batch.columns)
        edge = np.concatenate([[0], np.flatnonzero((np.diff(p1) != 0) | (np.diff(p2) != 0)) + 1, [len(c)]])
        starts = [s for i, j in zip(edge[:-1], edge[1:], strict=True) for s in range(i, j, PIECE)]
        ends = [*starts[1:], len(c)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(p1[starts]), pa.array(p2[starts]), pa.array(c[starts]),
             pa.array([",".join(map(str, c[i:j].tolist())) for i, j in zip(starts, ends, strict=True)], pa.string())],
            names=["p1", "p2", "c", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (p1, p2, c, ids) to (p1, p2, sha-256 of all ids of a digest joined by commas), one piece in memory at a time."""
    stream = ((key, ids) for b in batches for key, ids in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True),
                                                               b.column(3).to_pylist(), strict=True))
    done: list[tuple[int, int, str]] = []

    def flush() -> pa.RecordBatch:
        cols = zip(*done, strict=True)
        out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)],
                                         names=["p1", "p2", "ends"])
        done.clear()
        return out

    for key, group in groupby(stream, key=lambda r: r[0]):
        digest = hashlib.sha256()
        for i, (_, ids) in enumerate(group):
            digest.update((("," if i else "") + ids).encode())
        done.append((*key, digest.hexdigest()))
        if len(done) == 4096:
            yield flush()
    if done:
        yield flush()


def end_digests(ends: DataFrame) -> DataFrame:
    """p1, p2, ends: sha-256 of the ascending ids (c) of each digest, joined by commas.

    Ids are joined to pieces by a range exchange first, so the one task that
    must hash a digest's ids in order reads a few long strings.
    """
    order = ["p1", "p2", "c"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _pieces, "p1 long, p2 long, c long, ids string")
    pieces = cut(pieces, "trie-pieces")
    return pieces.repartition("p1", "p2").sortWithinPartitions(*order).mapInArrow(_hashed, "p1 long, p2 long, ends string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie over rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Null roles and
    texts count as empty; turns are ordered by turn (null first), then by the
    digest of role and text, so repeated rows are repeated turns. Rows
    without conv_id belong to no conversation. Remainders of negative ids
    are negative (towards zero). Without conversations there is no row. Other
    columns are ignored.
    """
    turns, convs = ordered_turns(conversations)
    rows, lengths = rebuilt(turns, convs)
    lengths = cut(lengths, "trie-lengths")
    marked, nodes = verified_nodes(rows)
    children = cut(nodes.groupBy(F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children")),
                   "trie-children")

    def at(df: DataFrame, a: str, b: str) -> Column:
        return (F.col("p1") == df[a]) & (F.col("p2") == df[b])

    nodes = nodes.join(children, at(children, "k1", "k2"), "left").drop("k1", "k2")
    nodes = cut(nodes.select("p1", "p2", "q1", "q2", "depth", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                             ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
                             F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves")), "trie-nodes")
    sums = accumulated(marked, nodes)
    zero = F.lit(0).cast("long")
    ends = marked.join(lengths.select(F.col("c").alias("lc"), F.col("n").alias("ln")),
                       (F.col("c") == F.col("lc")) & (F.col("d") == F.col("ln"))).select("p1", "p2", "c")
    ends = ends.unionByName(lengths.filter("n = 0").select(zero.alias("p1"), zero.alias("p2"), "c"))
    digests = cut(end_digests(ends), "trie-ends")
    # the root: all conversations, and the sums over all nodes
    everyone = lengths.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    whole = nodes.agg(F.coalesce(F.sum("saved"), zero).alias("saved"), F.greatest(F.coalesce(F.sum("leaves"), zero), F.lit(1)).alias("leaves"),
                      F.coalesce(F.sum(F.when(F.col("depth") == 1, 1)), zero).alias("n_children"))
    one = F.lit(1)
    root = everyone.withColumn("one", one).join(whole.withColumn("one", one), "one").filter("n_convs > 0").select(
        zero.alias("p1"), zero.alias("p2"), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"), zero.alias("depth"),
        "conv_id", "n_convs", "n_children", "saved", "leaves")
    sums = sums.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("saved").alias("in_saved"), F.col("leaves").alias("in_leaves"))
    below = nodes.join(sums, at(sums, "k1", "k2")).select(
        "p1", "p2", "q1", "q2", "depth", "conv_id", "n_convs", "n_children", F.col("in_saved").alias("saved"), F.col("in_leaves").alias("leaves"))
    every = cut(root.unionByName(below), "trie-every")
    digests = digests.select(F.col("p1").alias("e1"), F.col("p2").alias("e2"), "ends")
    parents = every.select(F.col("p1").alias("u1"), F.col("p2").alias("u2"), F.col("conv_id").alias("parent_conv_id"))
    out = every.join(digests, at(digests, "e1", "e2"), "left")
    out = out.join(parents, (F.col("q1") == F.col("u1")) & (F.col("q2") == F.col("u2")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
                      F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(empty)).alias("ends_sha256"))
