"""Packing into fixed-length sequences, steps, milestones.

Packing never loops over documents: a prefix sum of (length + 1) gives each
document's global token offset; a document is exploded once per output
sequence it touches (so a giant document spreads over many rows/tasks), and
each sequence gathers at most ``seq_len`` tokens.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PackConfig
from ..functions.columns import milestone_name
from .prefix_sum import running_sums


def pack_pieces(plan: DataFrame, seq_len: int, length: str = "n_tokens", order: str = "draw",
                bucket_rows: int = 1 << 16) -> DataFrame:
    """T07 (layout): one row per (sequence, document piece).

    Documents with ``length`` 0 (empty text, P03) are skipped; every other
    document contributes ``length + 1`` tokens (its ids then ``<eos>``).
    Only complete sequences are kept (the trailing remainder is dropped).
    Columns: seq_id, piece_start (0-based token offset inside the document's
    ids+eos), piece_len, seq_pos (offset inside the sequence) + plan columns.
    """
    d = plan.filter(F.col(length) > 0).withColumn("_span", (F.col(length) + 1).cast("long"))
    total = F.coalesce(d.agg(F.sum("_span")).scalar(), F.lit(0))  # a plain aggregate, no window
    d = running_sums(d, ["_span"], order=[order], bucket=F.floor(F.col(order) / F.lit(bucket_rows)),
                     suffix="_off")
    d = d.withColumnRenamed("_span_off", "token_offset")
    L = F.lit(seq_len)
    d = d.withColumn("seq_id", F.explode(F.sequence(
        F.floor(F.col("token_offset") / L), F.floor((F.col("token_offset") + F.col("_span") - 1) / L))))
    start = F.greatest(F.col("seq_id") * L - F.col("token_offset"), F.lit(0))
    end = F.least((F.col("seq_id") + 1) * L - F.col("token_offset"), F.col("_span"))
    d = d.withColumns({"piece_start": start.cast("long"), "piece_len": (end - start).cast("long"),
                       "seq_pos": (F.greatest(F.col("token_offset") - F.col("seq_id") * L, F.lit(0))).cast("long")})
    return d.filter(F.col("seq_id") < F.floor(total / L)).drop("_span")


def pack_sequences(pieces: DataFrame, ids: str = "ids", eos_id: int = 2) -> DataFrame:
    """T07 (ids): assemble ``seq_len`` ids per sequence from the pieces.

    Each group holds at most ``seq_len`` tokens, so the per-sequence
    ``collect_list`` is bounded."""
    full = F.concat(F.col(ids), F.array(F.lit(eos_id).cast("int")))
    p = pieces.withColumn("_piece", F.slice(full, F.col("piece_start") + 1, F.col("piece_len")))
    g = p.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("seq_pos", "_piece"))).alias("_parts"))
    return g.select("seq_id", F.flatten(F.transform("_parts", lambda x: x["_piece"])).alias("input_ids"))


def pack_stats(pieces: DataFrame, seq_len: int) -> DataFrame:
    """Documents per sequence and whether one document dominates it."""
    g = pieces.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_docs"),
                                     F.max("piece_len").alias("max_piece"),
                                     F.sum("piece_len").alias("n_tokens"))
    return g.withColumns({"max_piece_share": F.col("max_piece") / F.lit(float(seq_len)),
                          "dominated": F.col("max_piece") * 2 > F.lit(seq_len)})


def assign_steps(seqs: DataFrame, cfg: PackConfig) -> DataFrame:
    """Sequence -> micro-batch -> rank -> accumulation slot -> optimizer step.
    Ranks receive disjoint sequences."""
    mb = F.floor(F.col("seq_id") / F.lit(cfg.micro_batch_size))
    per_step = cfg.micro_batch_size * cfg.grad_accum_steps * cfg.world_size
    return seqs.withColumns({
        "micro_batch": mb.cast("long"),
        "rank": (mb % F.lit(cfg.world_size)).cast("int"),
        "accum_slot": (F.floor(mb / F.lit(cfg.world_size)) % F.lit(cfg.grad_accum_steps)).cast("int"),
        "step": F.floor(F.col("seq_id") / F.lit(per_step)).cast("long") + 1})


def cap_steps(seqs: DataFrame, steps: int, cfg: PackConfig) -> DataFrame:
    """Keep the sequences of the first ``steps`` optimizer steps."""
    per_step = cfg.micro_batch_size * cfg.grad_accum_steps * cfg.world_size
    return seqs.filter(F.col("seq_id") < F.lit(steps * per_step))


def estimate_steps(budget: int, max_epochs: int, cfg: PackConfig, fertility: float = 1.0) -> int:
    """Budget x epochs // tokens per step (min 1); ``fertility`` (A22,
    tokenizer tokens per reference token) corrects the estimate."""
    per_step = cfg.micro_batch_size * cfg.grad_accum_steps * cfg.seq_len * cfg.world_size
    return max(1, int(budget * max_epochs * fertility) // per_step)


def milestone_crossings(plan: DataFrame, milestones: Sequence[int], tokens_per_step: int | None = None) -> DataFrame:
    """J04 + P10: for each milestone, the first draw whose inclusive running
    total reaches it (several milestones may fire on one draw). The milestone
    list is a tiny broadcast table; each milestone matches exactly one draw
    (``total_before < m <= total_before + ref_tokens``). Name collisions
    (e.g. 10k and 100k both -> chck_1M) are flagged. With ``tokens_per_step``
    the optimizer step that reads the crossing token is added (``step``)."""
    spark = plan.sparkSession
    m = F.broadcast(spark.createDataFrame([(int(x),) for x in sorted(set(milestones))], "milestone long"))
    cond = (F.col("total_before") < m["milestone"]) & (
        F.col("total_before") + F.col("ref_tokens") >= m["milestone"])
    j = plan.join(m, cond, "inner").select(
        "milestone", milestone_name(F.col("milestone")).alias("name"), "draw",
        (F.col("total_before") + F.col("ref_tokens")).alias("ref_tokens_at_save"))
    from pyspark.sql import Window
    if tokens_per_step:
        j = j.withColumn("step", F.ceil(F.col("milestone") / F.lit(tokens_per_step)).cast("long"))
    return j.withColumn("name_collision", F.count(F.lit(1)).over(Window.partitionBy("name")) > 1)


def log_intervals(steps: DataFrame, log_every: int, tokens_per_step: int,
                  step: str = "step", loss: str = "loss", ts: str = "ts") -> DataFrame:
    """Mean loss per ``log_every`` steps and tokens/s from the wall-clock
    delta between interval ends (previous interval end via ``lag``)."""
    from pyspark.sql import Window
    b = F.ceil(F.col(step) / F.lit(log_every)).cast("long")
    g = steps.withColumn("interval", b).groupBy("interval").agg(
        F.avg(loss).alias("mean_loss"), F.max(step).alias("last_step"),
        F.max(ts).alias("t_end"), F.count(F.lit(1)).alias("n_steps"))
    # the interval before is in the same block of intervals, or the last one of the block before
    block = F.floor(F.col("interval") / F.lit(4096))
    g = g.withColumn("_block", block)
    ends = g.groupBy("_block").agg(F.max_by("t_end", "interval").alias("_last"))  # one row per 4096 intervals
    ends = ends.withColumn("_edge", F.lag("_last").over(Window.orderBy("_block"))).drop("_last")
    g = g.join(ends, "_block")
    prev = F.coalesce(F.lag("t_end").over(Window.partitionBy("_block").orderBy("interval")), F.col("_edge"))
    g = g.withColumn("_prev", prev)
    dt = F.unix_micros(F.col("t_end").cast("timestamp")) - F.unix_micros(F.col("_prev").cast("timestamp"))
    return g.withColumn("tok_per_s", F.when(dt > 0, F.lit(float(tokens_per_step)) * F.col("n_steps")
                                            / (dt / F.lit(1e6)))).drop("_block", "_edge", "_prev")
