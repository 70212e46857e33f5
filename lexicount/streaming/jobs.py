"""Structured Streaming versions of the corpus operators.

State lives where Spark keeps it (streaming aggregation state per key) or in
a small table in the shared checkpoint folder (``foreachBatch`` jobs that are
idempotent per batch id). No operator funnels a micro-batch through one
group: aggregations are partial before the shuffle, milestone crossings use
the two-level prefix sum inside each batch.
"""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import milestone_name
from ..operators.budget import whitelist_predicate, with_ref_tokens  # noqa: F401
from ..operators.prefix_sum import numbered, running_sums
from ..session import checkpoint_dir, cut_lineage


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stream_corpus(spark: SparkSession, path: str, schema: T.StructType | str,
                  whitelist: Mapping[str, Sequence[str] | None] | None = None,
                  max_files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Lazy corpus stream; the category whitelist is applied before any
    shuffle (it is a plain filter on the stream)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    df = r.load(path)
    return df.filter(whitelist_predicate(whitelist)) if whitelist else df


def run_to_memory(df: DataFrame, mode: str = "complete", name: str | None = None) -> DataFrame:
    """Run a streaming aggregation over everything available (``availableNow``)
    into a memory sink: its rows (one per key) end up on the driver, so this is
    for results of a few keys; everything else goes through ``run_to_files``."""
    spark = df.sparkSession
    name = name or f"lexicount_{uuid.uuid4().hex[:10]}"
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
           .option("checkpointLocation", scratch(spark, "stream-ckpt"))
           .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)


def run_to_files(df: DataFrame, out: str | None = None) -> DataFrame:
    """Run an append-only streaming query over everything available into a
    Parquet sink (exactly once per batch) and return what was written."""
    spark = df.sparkSession
    out = out or scratch(spark, "stream-out")
    q = (df.writeStream.format("parquet").outputMode("append").option("path", out)
           .option("checkpointLocation", scratch(spark, "stream-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def run_updates(df: DataFrame, key: str, out: str | None = None) -> DataFrame:
    """Run a streaming aggregation over everything available and return the
    last row of every ``key``. Each batch writes the rows it changed into its
    own folder (overwrite, so a replayed batch is idempotent); none of them
    goes through the driver."""
    spark = df.sparkSession
    out = out or scratch(spark, "stream-updates")
    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{out}/batch_id=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (df.writeStream.foreachBatch(write).outputMode("update")
           .option("checkpointLocation", scratch(spark, "stream-ckpt"))
           .trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch_id", T.LongType())])).parquet(out)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*df.columns), "batch_id").alias("r"))
    return last.select("r.*")


def stream_consumption(stream: DataFrame, premium: Mapping[str, float], total_budget: int,
                       raw: str = "num_tokens") -> DataFrame:
    """Running reference-token consumption per language (streaming state
    is one row per language) and each language's ``frac`` of the total budget."""
    d = with_ref_tokens(stream, premium, raw=raw)
    agg = d.groupBy("lang").agg(F.sum("ref_tokens").cast("long").alias("consumed"),
                                F.count(F.lit(1)).alias("docs"))
    return agg.withColumn("frac_of_budget", F.col("consumed") / F.lit(float(max(1, total_budget))))


def shuffle_slot(seed: int, lane: str, n: int, buffer: int) -> int:
    """The slot that the n-th arrival of a lane replaces: a function of its number alone, so replays agree."""
    return int(hashlib.md5(f"{seed}|{lane}|{n}".encode()).hexdigest()[:8], 16) % buffer


def _slot(seed: int, lane: Column, n: Column, buffer: int) -> Column:
    """``shuffle_slot`` of every row."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), lane, n.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(buffer)


def stream_local_shuffle(stream: DataFrame, seed: int, out: str, buffer: int = 1000, lanes: int = 1,
                         key: str = "lang", order: str = "doc_id") -> DataFrame:
    """Bounded-buffer shuffle of a stream; returns (lane, seq, and the columns of the stream).

    Rows go through the buffer of their lane: ``key``, split into ``lanes``
    parts by a hash of ``order`` so that a hot key is several groups. A buffer
    holds ``buffer`` rows; once it is full, every arriving row takes a random
    slot and the row that was there is emitted (a *local* shuffle: biased when
    the input is clustered). Rows of a batch arrive in ``order``. The slot is a
    function of the arrival's number alone, so a row leaves when the next one
    of its lane and slot arrives: one window over (lane, slot) says when, and
    no task holds a buffer or a batch. The buffers are a table in the shared
    checkpoint folder, carried from batch to batch; emitted rows go to
    ``out/batch_id=N`` (overwrite, so a replayed batch is idempotent). What is
    left in the buffers when no input is left follows in a seeded order.
    """
    spark = stream.sparkSession
    lane = F.concat_ws("|", F.col(key), (F.crc32(F.col(order).cast("string").cast("binary")) % lanes).cast("string"))
    rows = stream.select(lane.alias("lane"), F.col(order).alias("at"), F.struct(*stream.columns).alias("row"))
    row = T.StructField("row", stream.schema)
    held = T.StructType([T.StructField("lane", T.StringType()), T.StructField("n", T.LongType()),
                         T.StructField("slot", T.LongType()), row])
    gone = T.StructType([T.StructField("lane", T.StringType()), T.StructField("seq", T.LongType()), row])
    kept = scratch(spark, "shuffle-buffers")
    spark.createDataFrame([], held).write.parquet(f"{kept}/-1")
    done = [-1]  # the last batch

    def process(batch: DataFrame, batch_id: int) -> None:
        before = batch.sparkSession.read.schema(held).parquet(f"{kept}/{batch_id - 1}")
        arrived = before.groupBy("lane").agg(F.max("n").alias("arrived"))  # the last arrival is always held
        new = numbered(batch, "lane", [F.col("at").asc_nulls_last()], "shuffle-arrivals").join(F.broadcast(arrived), "lane", "left")
        new = new.withColumn("n", F.col("n") + F.coalesce("arrived", F.lit(0)))
        new = new.select("lane", "n", F.when(F.col("n") <= buffer, F.col("n") - 1).otherwise(
            _slot(seed, F.col("lane"), F.col("n"), buffer)).alias("slot"), "row")
        leaves = F.lead("n").over(Window.partitionBy("lane", "slot").orderBy("n"))
        moved = cut_lineage(before.unionByName(new).withColumn("leaves", leaves), "shuffle-moved")
        moved.filter("leaves is not null").select("lane", (F.col("leaves") - buffer).alias("seq"), "row") \
            .write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        moved.filter("leaves is null").drop("leaves").write.mode("overwrite").parquet(f"{kept}/{batch_id}")
        done[0] = batch_id

    q = (rows.writeStream.foreachBatch(process).option("checkpointLocation", scratch(spark, "shuffle-ckpt"))
             .trigger(availableNow=True).start())
    q.awaitTermination()
    rest = spark.read.schema(held).parquet(f"{kept}/{done[0]}")
    lane_rows = Window.partitionBy("lane")  # at most ``buffer`` rows
    left = F.md5(F.concat_ws("|", F.lit(seed), "lane", F.lit("rest"), "slot"))
    first = F.max("n").over(lane_rows) - F.count(F.lit(1)).over(lane_rows)
    rest = rest.select("lane", (first + F.row_number().over(lane_rows.orderBy(left, "slot"))).alias("seq"), "row")
    if done[0] >= 0:
        rest = spark.read.schema(gone).parquet(out).select("lane", "seq", "row").unionByName(rest)
    return rest.select("lane", "seq", "row.*")


def stream_milestones(stream: DataFrame, milestones: Sequence[int], state_dir: str,
                      order: Sequence[str] = ("doc_id",), tokens: str = "ref_tokens"):
    """Milestone crossing events, each emitted once.

    Per micro-batch: the running total inside the batch (two-level prefix sum,
    order = arrival order key), plus the total of all earlier batches read
    from the state table; a milestone fires on the row where the running total
    first reaches it. Outputs and the new batch total are written under
    ``state_dir/batch_id=N`` (overwrite), so a replayed batch is idempotent.
    """
    spark = stream.sparkSession
    ms = sorted(set(int(m) for m in milestones))

    def process(batch: DataFrame, batch_id: int) -> None:
        # batch 0 has no state; for any other a missing or unreadable state must stop the query
        before = 0
        if batch_id > 0:
            prev = spark.read.parquet(f"{state_dir}/totals").filter(F.col("batch_id") < batch_id)
            before = prev.agg(F.sum("batch_tokens")).first()[0] or 0
        b = batch.withColumn("_t", F.col(tokens).cast("long"))
        b = running_sums(b, ["_t"], order=list(order), bucket=F.floor(F.col(order[0]) / F.lit(1 << 16)),
                         suffix="_before")
        b = b.withColumn("total_before", F.col("_t_before") + F.lit(int(before)))
        m = F.broadcast(spark.createDataFrame([(x,) for x in ms], "milestone long"))
        hits = b.join(m, (F.col("total_before") < m["milestone"])
                      & (F.col("total_before") + F.col("_t") >= m["milestone"]))
        (hits.select("milestone", milestone_name(F.col("milestone")).alias("name"), *order,
                     (F.col("total_before") + F.col("_t")).alias("ref_tokens_at_save"))
             .withColumn("batch_id", F.lit(batch_id))
             .write.mode("overwrite").parquet(f"{state_dir}/events/batch_id={batch_id}"))
        (b.agg(F.coalesce(F.sum("_t"), F.lit(0)).cast("long").alias("batch_tokens"))
          .withColumn("batch_id", F.lit(batch_id))
          .write.mode("overwrite").parquet(f"{state_dir}/totals/batch_id={batch_id}"))

    return (stream.writeStream.foreachBatch(process)
                  .option("checkpointLocation", f"{state_dir}/_checkpoint")
                  .trigger(availableNow=True).start())


def stream_log_metrics(lines: DataFrame, log_every: int) -> DataFrame:
    """Live training-log telemetry: mean loss and last token count per
    ``log_every``-step interval (streaming aggregation keyed by interval)."""
    from ..sources.evals import train_log_steps
    s = train_log_steps(lines.withColumnRenamed("value", "line"))
    return s.groupBy(F.ceil(F.col("step") / F.lit(log_every)).cast("long").alias("interval")).agg(
        F.avg("loss").alias("mean_loss"), F.max("step").alias("last_step"),
        F.max("ref_tokens").alias("ref_tokens"), F.count(F.lit(1)).alias("n_steps"))


def stream_log_throughput(steps: DataFrame, log_every: int, tokens_per_step: int) -> DataFrame:
    """Mean loss, last step and tokens/s of every ``log_every``-step interval of a live log (step, loss, ts).

    An interval's state holds its own steps and the end of the interval before
    it: every step also counts as a possible end for the interval that
    follows, so the rate needs no order between batches and no group but the
    interval's own.
    """
    interval = F.ceil(F.col("step") / F.lit(log_every)).cast("long")
    both = steps.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False))))
    own = F.col("own")
    g = both.groupBy(F.when(own, interval).otherwise(interval + 1).alias("interval")).agg(
        F.avg(F.when(own, F.col("loss"))).alias("mean_loss"), F.max(F.when(own, F.col("step"))).alias("last_step"),
        F.max(F.when(own, F.col("ts"))).alias("t_end"), F.count(F.when(own, F.lit(1))).alias("n_steps"),
        F.max(F.when(~own, F.col("ts"))).alias("before"))
    dt = F.unix_micros(F.col("t_end").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))
    rate = F.when(dt > 0, F.lit(float(tokens_per_step)) * F.col("n_steps") / (dt / F.lit(1e6)))
    return g.select("interval", "mean_loss", "last_step", "t_end", "n_steps", rate.alias("tok_per_s"))


def stream_leakage(stream: DataFrame, probes: DataFrame, out: str, block_chars: int = 1 << 22):
    """Leakage screen of a stream against static probes; returns the started query.

    The probe index is built once. Probes of at most ``block_chars``
    characters become one automaton on every executor, and the stream itself
    emits hits: no batch plans, joins or shuffles anything. For larger probe
    sets an index of their word n-grams is written before the stream starts;
    each batch looks its texts' n-grams up there by the n-gram of every probe
    that earlier batches have seen least, and adds its own document
    frequencies. A replayed batch overwrites what it wrote.
    """
    from ..operators import leakage
    spark = stream.sparkSession
    ckpt = scratch(spark, "leakage-ckpt")
    if leakage.n_blocks(probes, block_chars) == 1:
        shared, ids = leakage.share_block(probes, 0, 1)
        schema = leakage.hit_schema(stream, ids)
        hits = stream.select("doc_id", "lang", "data_source", "category", "text").mapInArrow(
            leakage.scanner(shared, schema.names), schema)
        return (hits.writeStream.format("parquet").outputMode("append").option("path", out)
                    .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    index = leakage.ProbeIndex.build(probes, scratch(spark, "leakage-index"))

    def screen(batch: DataFrame, batch_id: int) -> None:
        index.screen(batch, batch_id).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (stream.writeStream.foreachBatch(screen).option("checkpointLocation", ckpt)
                  .trigger(availableNow=True).start())


def stream_dedup_prefix(stream: DataFrame, n: int | None = 300, watermark: str = "1 hour",
                        ts: str | None = None) -> DataFrame:
    """Drop documents whose first ``n`` characters were already seen
    (per language) within the watermark. Without an event-time column the
    ingestion time is used (the watermark is ours, not part of the source)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    d = stream.withColumn("prefix_hash", F.md5(F.substring(t, 1, n) if n else t))
    tcol = ts or "_ingest_ts"
    if ts is None:
        d = d.withColumn(tcol, F.current_timestamp())
    return d.withWatermark(tcol, watermark).dropDuplicatesWithinWatermark(["lang", "prefix_hash"])
