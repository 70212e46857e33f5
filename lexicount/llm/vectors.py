"""Embedding near-deduplication by collision-counting projections (operator 7).

Vectors of one label are laid out in the sorted order of a first random
projection and cut into blocks; blocks whose ranges lie within the reach of
that projection meet. Inside a pair of blocks every vector is a query with a
window around it on each of many projections: collisions are counted per pair
and pairs with at least the recall-calibrated count are verified by cosine in
double precision. A pair of blocks returns link counts and a spanning forest,
never its pairs, so a dense group stays linear in size.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import components


@dataclass(frozen=True)
class Params:
    """cosine threshold; number of projections; window in deviations of a pair at the threshold; allowed miss rate."""

    threshold: float = 0.93
    projections: int = 64
    width: float = 2.0
    misses: float = 1e-9
    block: int = 1024

    @property
    def spread(self) -> float:
        """Distance of two unit vectors at the threshold: the deviation of their difference on a projection."""
        return sqrt(max(0.0, 2 - 2 * self.threshold))

    @property
    def least_collisions(self) -> int:
        """Largest count that a pair at the threshold misses with probability below ``misses``."""
        hit, m, below = erf(self.width / sqrt(2)), self.projections, 0.0
        for c in range(m + 1):
            below += comb(m, c) * hit ** c * (1 - hit) ** (m - c)
            if below > self.misses:
                return c
        return m


def directions(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng(77_003 + dim).standard_normal((dim, count))


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def projected(emb: DataFrame, p: Params) -> DataFrame:
    """vec_id, label, dim, first, vec (doubles as bytes) of the vectors that can link with anything."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, label, v in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if i is None or label is None or not v or None in v:
                    continue
                x = np.array(v, dtype=np.float64)
                norm = sqrt(float((x * x).sum())) if np.isfinite(x).all() else 0.0
                if norm > 0 and np.isfinite(norm):
                    rows.append((i, label, len(x), float(x @ directions(len(x), 1)[:, 0]) / norm, x.tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                             names=["vec_id", "label", "dim", "first", "vec"])

    return emb.select("vec_id", F.col("label").cast("long"), "embedding").mapInArrow(
        run, "vec_id long, label long, dim int, first double, vec binary")


def blocks(rows: DataFrame, p: Params) -> DataFrame:
    """label, dim, block, lo, hi, ids, vecs: runs of at most ``p.block`` vectors of a label in projected order."""
    parts = max(1, rows.count() // p.block)
    dealt = rows.repartitionByRange(parts, "label", "dim", "first").sortWithinPartitions("label", "dim", "first", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        held: list[dict] = []

        def packed() -> pa.RecordBatch:
            out = {"label": [held[0]["label"]], "dim": [held[0]["dim"]], "block": [(task << 32) + n],
                   "lo": [held[0]["first"]], "hi": [held[-1]["first"]],
                   "ids": [np.array([r["vec_id"] for r in held], dtype=np.int64).tobytes()],
                   "vecs": [b"".join(r["vec"] for r in held)]}
            return pa.RecordBatch.from_pydict(out, schema=pa.schema(
                [("label", pa.int64()), ("dim", pa.int32()), ("block", pa.int64()), ("lo", pa.float64()),
                 ("hi", pa.float64()), ("ids", pa.binary()), ("vecs", pa.binary())]))

        for batch in batches:
            for r in batch.to_pylist():
                if held and (len(held) >= p.block or (r["label"], r["dim"]) != (held[0]["label"], held[0]["dim"])):
                    yield packed()
                    held, n = [], n + 1
                held.append(r)
        if held:
            yield packed()

    return cut(dealt.mapInArrow(run, "label long, dim int, block long, lo double, hi double, ids binary, vecs binary"),
               "vector-blocks")


def candidates(a: np.ndarray, b: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors with enough window collisions (windows are a step wider than set, never narrower)."""
    d = directions(a.shape[1], p.projections)
    step = 9.0 / 120  # projections of unit vectors are near N(0, 1); clipping at 4.5 only adds collisions
    qa, qb = (np.clip(np.rint(x @ d / step), -60, 60).astype(np.int8).T.copy() for x in (a, b))
    window = np.int8(min(120, int(p.width * p.spread / step) + 1))
    found_i, found_j = [], []
    for at in range(0, len(a), 256):
        counts = np.zeros((min(256, len(a) - at), len(b)), dtype=np.uint8)
        for k in range(p.projections):
            counts += np.abs(qa[k, at:at + 256, None] - qb[k, None, :]) <= window
        i, j = np.nonzero(counts >= p.least_collisions)
        found_i.append(i + at), found_j.append(j)
    return np.concatenate(found_i), np.concatenate(found_j)


def links(ids_a: np.ndarray, a: np.ndarray, ids_b: np.ndarray, b: np.ndarray, same: bool,
          p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, root id, number of links) of the vectors of two blocks that have a verified link between them."""
    i, j = candidates(units(a), units(b), p)
    ok = (ids_a[i] != ids_b[j]) & ((i < j) if same else True)
    i, j = i[ok], j[ok]
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    good = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), 1 << 15):
        s = slice(at, at + (1 << 15))
        good[s] = np.einsum("nd,nd->n", a[i[s]], b[j[s]]) / (na[i[s]] * nb[j[s]]) >= p.threshold
    i, j = i[good], j[good]
    base = 0 if same else len(a)
    node_ids = ids_a if same else np.concatenate([ids_a, ids_b])
    n = len(node_ids)
    count = np.bincount(i, minlength=n) + np.bincount(j + base, minlength=n)
    root = np.arange(n)
    while True:  # smallest label over all links until nothing changes
        low = np.minimum(root[i], root[j + base])
        nxt = root.copy()
        np.minimum.at(nxt, i, low)
        np.minimum.at(nxt, j + base, low)
        nxt = nxt[nxt]
        if (nxt == root).all():
            break
        root = nxt
    used = np.flatnonzero(count)
    return node_ids[used], node_ids[root[used]], count[used]


def near_vectors(emb: DataFrame, p: Params = Params()) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row.

    Only vectors of one label (not null) and one length are compared. Vectors
    that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do rows without an id (component null, kept). Rows that
    repeat an id are never linked with each other and share that id's
    component; their links add up. Other columns are ignored; an empty table
    gives no rows. Every vector meets every block within six deviations of the
    first projection, so work grows with the square of a label's vectors.
    """
    blk = blocks(cut(projected(emb, p), "vector-rows"), p)
    reach = 6 * p.spread
    left = blk.select("label", "dim", F.col("block").alias("x"), F.col("lo").alias("xlo"), F.col("hi").alias("xhi"))
    right = blk.select("label", "dim", F.col("block").alias("y"), F.col("lo").alias("ylo"), F.col("hi").alias("yhi"))
    met = left.join(right, ["label", "dim"]).filter(
        (F.col("x") <= F.col("y")) & (F.col("ylo") - F.col("xhi") <= reach) & (F.col("xlo") - F.col("yhi") <= reach))
    parts = max(1, blk.count())
    pair = met.select("dim", "x", "y").repartition(parts, "x", "y")
    pay = blk.select("block", "ids", "vecs")
    pair = pair.join(pay.toDF("x", "xids", "xvecs"), "x").join(pay.toDF("y", "yids", "yvecs"), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = [np.frombuffer(r[k], dtype=np.int64) for k in ("xids", "yids")]
                vec = [np.frombuffer(r[k], dtype=np.float64).reshape(-1, r["dim"]) for k in ("xvecs", "yvecs")]
                out = links(ids[0], vec[0], ids[1], vec[1], r["x"] == r["y"], p)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["vec_id", "root", "links"])

    found = cut(pair.select("dim", "x", "y", "xids", "xvecs", "yids", "yvecs").mapInArrow(
        run, "vec_id long, root long, links long"), "vector-links")
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("n_links")).withColumnRenamed("vec_id", "c_id")
    comp = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    out = emb.select("vec_id").join(counts, F.col("vec_id") == F.col("c_id"), "left")
    out = out.join(comp, F.col("vec_id") == F.col("node"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                     F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
