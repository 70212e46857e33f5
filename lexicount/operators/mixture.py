"""Deficit-driven, token-budgeted mixture plan without a document loop.

The sequential rule: before each draw, pick the language with the largest
deficit ``w_k - c_k / S`` (target share minus consumed share over the active
languages), draw its next document (per-epoch seeded order, looping over
epochs), stop when the total reaches ``budget x max_epochs`` or a language
is strictly over ``max_epochs`` epochs (the check precedes the draw).

Spark plan:
1. From the weights alone the driver computes the fluid (many small
   documents) solution: per language, piecewise-linear segments mapping its
   own cumulative consumption ``c`` to total consumption ``t``. Size is
   bounded by languages x schedule events.
2. Documents are replicated over the reachable epochs only, ordered per
   language by the seeded key, and a two-level prefix sum gives ``c_before``.
3. A broadcast range join on the segments turns ``c_before`` into a global
   position; a second two-level prefix sum along that position gives the
   total consumed before each draw; the caps cut the sequence.
"""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFICIT_TIE_TOLERANCE, MixConfig
from ..functions.columns import key_bucket, map_literal, order_key
from .budget import normalize, validate_schedule, whitelist_predicate
from ..session import cut_lineage
from .prefix_sum import running_sums


@dataclass(frozen=True)
class Segment:
    key: str
    c_lo: float
    c_hi: float
    t_lo: float
    rate: float


def fluid_segments(stages: Sequence[tuple[float, Mapping[str, float]]], total_budget: float,
                   keys: Sequence[str] | None = None, tol: float = DEFICIT_TIE_TOLERANCE
                   ) -> tuple[list[Segment], dict[str, float]]:
    """Water-fill solution of the deficit rule in the small-document limit.

    While the contenders A (keys tied at the largest deficit) are fixed, key
    k in A receives the share ``w_k + (1 - Σ_A w) / |A|``; a key j joins A
    when the consumed total over active keys reaches
    ``(c_j + C_R / |A|) / (w_j + (1 - Σ_A w) / |A|)``. Stages switch at
    ``frac x total_budget`` of the total over all keys. Returns segments
    (the last one per key open-ended) and the consumption at the horizon.
    """
    pts = validate_schedule(stages)
    allk = list(keys or sorted({k for _, w in pts for k in w}))
    c = {k: 0.0 for k in allk}
    segs: list[Segment] = []
    T = 0.0
    for i, (_, w) in enumerate(pts):
        last = i + 1 == len(pts)
        t_end = total_budget if last else pts[i + 1][0] * total_budget
        active = [k for k in w if w[k] > 0]
        for _ in range(4 * len(allk) + 4):
            if not last and T >= t_end:
                break
            S = sum(c[k] for k in active)
            d = {k: w[k] - (c[k] / S if S > 0 else 0.0) for k in active}
            dmax = max(d.values())
            A = [k for k in active if d[k] > dmax - tol]
            while True:  # absorb keys whose join point is already reached
                extra = (1.0 - sum(w[k] for k in A)) / len(A)
                R = [k for k in active if k not in A]
                CR = sum(c[k] for k in R)
                joins = {j: (c[j] + CR / len(A)) / (w[j] + extra) for j in R}
                now = [j for j, sj in joins.items() if sj <= S * (1 + 1e-12) + 1e-15 * max(1.0, total_budget)]
                if not now:
                    break
                A += now
            rates = {k: w[k] for k in A} if len(A) == len(active) else {k: w[k] + extra for k in A}
            step_join = min((sj - S for sj in joins.values()), default=math.inf)
            if last and T + step_join >= t_end:
                # steady state up to (and past) the horizon: open-ended segments
                segs += [Segment(k, c[k], math.inf, T, rates[k]) for k in A]
                for k in A:
                    c[k] += rates[k] * max(t_end - T, 0.0)
                T = max(T, t_end)
                break
            step = min(step_join, t_end - T)
            for k in A:
                c_new = c[k] + rates[k] * step
                segs.append(Segment(k, c[k], c_new, T, rates[k]))
                c[k] = c_new
            T += step
        else:
            raise RuntimeError("water-fill did not converge")
    return segs, c


def _merge(segs: list[Segment]) -> list[Segment]:
    """Drop empty segments and keep per-key order."""
    return [s for s in segs if s.c_hi > s.c_lo]


def mix_plan(docs: DataFrame, cfg: MixConfig, key: str = "lang", id_col: str = "doc_id",
             available: Mapping[str, int] | None = None, hex_buckets: int | None = None,
             position_buckets: int | None = None, checkpoint: bool = True,
             carry: tuple[str, ...] = ()) -> DataFrame:
    """M03 + M04 + M05: the ordered, capped draw sequence.

    ``docs`` has ``(key, id_col, ref_tokens, raw_tokens)`` (after the category
    filter); ``carry`` names extra columns to keep. ``available`` defaults to
    A12 on the same rows (floor of Σ raw / premium). Returns one row per draw:
    key, id, epoch, order_key, ref_tokens, ``lang_before`` (same key, earlier
    draws), ``position``, ``total_before`` and ``draw`` (0-based draw index).
    """
    spark = docs.sparkSession
    stages = list(cfg.schedule) if cfg.schedule else [(0.0, cfg.weights)]
    pts = validate_schedule(stages)
    total_cap = int(cfg.total_token_budget)

    if cfg.category_whitelist:
        if "category" not in docs.columns:
            raise ValueError("a category whitelist needs documents with a category column")
        docs = docs.filter(whitelist_predicate(cfg.category_whitelist))
    # Only the columns the plan needs travel on (no text); persisted because
    # the per-key statistics and the plan both read it.
    weighted = {k for _, w in pts for k in w}
    base = docs.select(key, id_col, "ref_tokens", "raw_tokens", *carry).persist(StorageLevel.MEMORY_AND_DISK)
    # One small aggregate per key: epoch size, raw total, largest document.
    stats = {r[key]: r for r in base.groupBy(key).agg(
        F.sum("ref_tokens").cast("long").alias("epoch_tokens"),
        F.sum(F.coalesce(F.col("raw_tokens"), F.lit(0))).cast("long").alias("raw"),
        F.max("ref_tokens").cast("long").alias("max_doc"),
        F.count(F.lit(1)).alias("n_docs")).collect()}
    if available is None:
        available = {k: int(math.floor(r["raw"] / cfg.premium[k])) if k in cfg.premium else int(r["epoch_tokens"])
                     for k, r in stats.items()}
    for k in weighted:
        if k not in stats or not stats[k]["epoch_tokens"]:
            raise ValueError(f"{key}={k!r} has a positive weight but no tokens to draw")

    # solved for a unit budget and scaled (the water-fill is scale-invariant),
    # so the breakpoints are the same doubles any engine gets from unit x cap
    unit, c_unit = fluid_segments(pts, 1.0, keys=sorted(weighted))
    T = float(total_cap)
    segs = [Segment(x.key, x.c_lo * T, x.c_hi * T, x.t_lo * T, x.rate) for x in _merge(unit)]
    c_final = {k: v * T for k, v in c_unit.items()}
    max_doc = max(int(stats[k]["max_doc"] or 0) for k in weighted)
    horizon = float(total_cap) + 4.0 * len(weighted) * max_doc + 1.0

    # consumption a key can reach inside the horizon: fluid value + margin
    margin = (4 * len(weighted) + 1) * max_doc
    reach = {k: c_final.get(k, 0.0) + margin for k in weighted}
    epochs = {}
    for k in weighted:
        e = stats[k]["epoch_tokens"]
        epochs[k] = int(min(cfg.max_epochs + 1, math.floor(reach[k] / e) + 1))
    caps = {k: int(cfg.max_epochs * max(1, int(available.get(k, 0)))) for k in weighted}

    # bucket counts follow the data: about 4k+ rows per bucket, 16..65536 buckets
    n_max = max(int(stats[k]["n_docs"]) for k in weighted)
    if hex_buckets is None:
        hex_buckets = min(4, max(1, math.ceil(math.log(max(n_max, 1) / 4096, 16)) if n_max > 4096 else 1))
    if position_buckets is None:
        rows = sum(int(stats[k]["n_docs"]) * epochs[k] for k in weighted)
        position_buckets = int(min(65536, max(16, rows // 4096)))

    d = base.filter(F.col(key).isin(sorted(weighted)))
    d = d.withColumn("epoch", F.explode(F.sequence(
        F.lit(0), F.element_at(map_literal(epochs, "int"), F.col(key)) - 1)))
    d = d.withColumn("order_key", order_key(cfg.seed, "epoch", id_col))
    nb = 16 ** hex_buckets
    # buckets that start beyond the reachable consumption are dropped before
    # the window sort (a small budget over a huge corpus sorts only a prefix)
    d = running_sums(d, ["ref_tokens"], order=["epoch", "order_key", id_col],
                     bucket=F.col("epoch") * nb + key_bucket("order_key", hex_buckets),
                     partition=[key], suffix="_lang_before", keep_until=reach)
    d = d.withColumnRenamed("ref_tokens_lang_before", "lang_before")

    seg_df = spark.createDataFrame(
        [(s.key, s.c_lo, s.c_hi, s.t_lo, s.rate) for s in segs],
        f"{key} string, c_lo double, c_hi double, t_lo double, rate double")
    s = F.broadcast(seg_df.withColumnRenamed(key, "_seg_key"))
    cond = ((F.col(key) == s["_seg_key"]) & (F.col("lang_before") >= s["c_lo"])
            & (F.col("lang_before") < s["c_hi"]))
    d = d.join(s, cond, "inner")
    d = d.withColumn("position", F.col("t_lo") + (F.col("lang_before") - F.col("c_lo")) / F.col("rate"))
    d = d.drop("_seg_key", "c_lo", "c_hi", "t_lo", "rate").filter(F.col("position") <= F.lit(horizon))

    d = d.withColumn("_one", F.lit(1).cast("long"))
    pb = F.least(F.floor(F.col("position") / F.lit(horizon) * position_buckets),
                 F.lit(position_buckets - 1)).cast("int")
    d = running_sums(d, ["ref_tokens", "_one"], order=["position", key, "epoch", "order_key"],
                     bucket=pb, suffix="_before")
    d = d.withColumnRenamed("ref_tokens_before", "total_before").withColumnRenamed("_one_before", "draw").drop("_one")

    out = apply_caps(d, total_cap, caps, key=key, checkpoint=checkpoint)
    if checkpoint:
        base.unpersist()  # the plan now lives in the checkpoint
    return out


def apply_caps(seq: DataFrame, total_cap: int, caps: Mapping[str, int], key: str = "lang",
               checkpoint: bool = True) -> DataFrame:
    """M03 on an ordered draw sequence (``draw``, ``total_before``,
    ``lang_before``, ``ref_tokens``): keep draws made while the total was
    below ``total_cap`` and no key was strictly over its cap (the check
    precedes the draw, so the crossing draw is kept)."""
    d = seq.filter(F.col("total_before") < F.lit(int(total_cap)))
    if checkpoint:
        d = cut_lineage(d)
    cap_col = F.element_at(map_literal({k: int(v) for k, v in caps.items()}, "long"), F.col(key))
    breach = d.filter(F.col("lang_before") + F.col("ref_tokens") > cap_col).agg(F.min("draw"))
    if checkpoint:
        first = breach.collect()[0][0]
        return d if first is None else d.filter(F.col("draw") <= F.lit(int(first)))
    return d.filter(F.col("draw") <= F.coalesce(breach.scalar(), F.col("draw")))


def share_report(plan: DataFrame, weights: Mapping[str, float], key: str = "lang") -> DataFrame:
    """Achieved token share and document share per key against the target, and the counter-example.

    ``uniform_token_share`` is what the weights would give if they chose
    documents instead of tokens: a key's share then follows its mean document
    size, target * mean / sum(target * mean).
    """
    w = normalize(weights)
    agg = plan.groupBy(key).agg(F.sum("ref_tokens").cast("long").alias("tokens"),
                                F.count(F.lit(1)).alias("docs"))
    tot = Window.partitionBy()  # over the aggregated table: one row per key
    target = F.element_at(map_literal(w, "double"), F.col(key))
    pull = target * (F.col("tokens") / F.col("docs"))
    return agg.select(
        key, "tokens", "docs",
        (F.col("tokens") / F.sum("tokens").over(tot)).alias("token_share"),
        (F.col("docs") / F.sum("docs").over(tot)).alias("doc_share"),
        target.alias("target_share"), (pull / F.sum(pull).over(tot)).alias("uniform_token_share"))


def cell_grid(docs: DataFrame, cells: Mapping[str, Mapping[str, Sequence[str] | None]],
              premium: Mapping[str, float], budget: int) -> DataFrame:
    """For every config cell (a whitelist), available reference tokens and
    the epochs needed per language to cover ``budget`` tokens of that language.

    One pass: each row is tagged with the cells that keep it (array of flags),
    exploded and aggregated; no per-cell rescans.
    """
    from .budget import whitelist_predicate
    names = list(cells)
    flags = F.array(*[F.when(whitelist_predicate(cells[n]), F.lit(n)) for n in names])
    d = docs.withColumn("cell", F.explode(F.filter(flags, lambda x: x.isNotNull())))
    agg = d.groupBy("cell", "lang").agg(F.sum(F.coalesce(F.col("raw_tokens"), F.lit(0))).cast("long").alias("raw_tokens"))
    p = F.element_at(map_literal(premium, "double"), F.col("lang"))
    agg = agg.withColumn("available", F.floor(F.col("raw_tokens") / p).cast("long"))
    return agg.withColumn("epochs_for_budget", F.lit(float(budget)) / F.greatest(F.col("available"), F.lit(1)))
