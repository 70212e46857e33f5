"""Streaming state across micro-batches equals the batch computation."""
from __future__ import annotations

import tempfile
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexicount.operators.budget import with_ref_tokens
from lexicount.plans.fixture import FIXTURE_PREMIUM
from lexicount.sources.corpus import DOCUMENTS_SCHEMA, corpus_view
from lexicount.streaming import jobs as R

from conftest import SF_SMALL


def test_milestones_and_consumption_across_batches(spark):
    src = tempfile.mkdtemp(prefix="lexicount-stream-", dir="/tmp")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    n = docs.count()
    for i, (lo, hi) in enumerate([(0, n // 3), (n // 3, 2 * n // 3), (2 * n // 3, n + 1)]):
        docs.filter((F.col("doc_id") >= lo) & (F.col("doc_id") < hi)).coalesce(1) \
            .write.parquet(f"{src}/part{i}")
        time.sleep(1.1)  # file order = modification time
    stream = with_ref_tokens(corpus_view(R.stream_corpus(spark, f"{src}/part*/*.parquet", DOCUMENTS_SCHEMA,
                                                         max_files_per_trigger=1)), FIXTURE_PREMIUM)
    milestones = [5_000 * i for i in range(1, 20)]
    state = R.scratch(spark, "test-milestones")
    R.stream_milestones(stream, milestones, state).awaitTermination()
    got = {(r.milestone, r.doc_id, r.ref_tokens_at_save) for r in spark.read.parquet(f"{state}/events").collect()}
    assert spark.read.parquet(f"{state}/totals").count() == 3  # three micro-batches

    batch = with_ref_tokens(corpus_view(docs), FIXTURE_PREMIUM)
    w = Window.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    b = batch.withColumn("before", F.coalesce(F.sum("ref_tokens").over(w), F.lit(0))).collect()
    want = set()
    for r in b:
        for m in milestones:
            if r.before < m <= r.before + r.ref_tokens:
                want.add((m, r.doc_id, r.before + r.ref_tokens))
    assert got == want and len(want) > 0

    cons = R.run_to_memory(R.stream_consumption(
        corpus_view(R.stream_corpus(spark, f"{src}/part*/*.parquet", DOCUMENTS_SCHEMA, max_files_per_trigger=1)),
        FIXTURE_PREMIUM, 10 ** 6), mode="complete")
    s = {r.lang: r.consumed for r in cons.collect()}
    e = {r.lang: r.t for r in batch.groupBy("lang").agg(F.sum("ref_tokens").alias("t")).collect()}
    assert s == e


def test_last_row_of_every_key_across_batches(spark):
    src = tempfile.mkdtemp(prefix="lexicount-updates-", dir="/tmp")
    for i in range(3):
        spark.range(i * 40, i * 40 + 60).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(src)
    out = R.scratch(spark, "test-updates")
    got = R.run_updates(stream.groupBy(F.expr("id div 25").alias("interval")).agg(F.count(F.lit(1)).alias("n")), "interval", out)
    want = {}
    for i in range(3):
        for x in range(i * 40, i * 40 + 60):
            want[x // 25] = want.get(x // 25, 0) + 1
    assert {r.interval: r.n for r in got.collect()} == want
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 3  # three micro-batches


def test_log_metrics_stay_off_the_driver(spark, monkeypatch):
    from lexicount.plans.catalog import QUERIES

    def to_driver(*args, **kwargs):
        raise AssertionError("rows that grow with the input were put into the driver's memory sink")
    monkeypatch.setattr(R, "run_to_memory", to_driver)
    assert QUERIES["stream_log_metrics"](spark, SF_SMALL).count() > 0


def sequential_shuffle(rows, seed, buffer):
    """Rows in the order in which a buffer of that size lets them out, and the rows it keeps."""
    held, out = [], []
    for n, (lane, x) in enumerate(rows, 1):
        if len(held) < buffer:
            held.append(x)
            continue
        i = R.shuffle_slot(seed, lane, n, buffer)
        out.append(held[i])
        held[i] = x
    return out, held


def test_shuffle_buffer_is_carried_over_batches(spark):
    src = tempfile.mkdtemp(prefix="lexicount-shuffle-", dir="/tmp")
    for lo in (0, 30, 60):
        rows = [(i, "a" if i % 3 else "b", f"text {i}") for i in range(lo, lo + 30)] + [(1000 + lo, None, "")]
        spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1).write.parquet(f"{src}/part{lo}")
        time.sleep(1.1)  # file order = modification time
    stream = R.stream_corpus(spark, f"{src}/part*/*.parquet", "doc_id long, lang string, text string", max_files_per_trigger=1)
    got = R.stream_local_shuffle(stream, 5, R.scratch(spark, "test-shuffle"), buffer=8).orderBy("lane", "seq").collect()
    assert len(got) == 93 and {r.text for r in got if r.lang} == {f"text {i}" for i in range(90)}
    for lang in "ab":
        mine = [r for r in got if r.lang == lang]
        assert [r.seq for r in mine] == list(range(1, len(mine) + 1))
        arrivals = [(f"{lang}|0", i) for i in range(90) if (i % 3 != 0) == (lang == "a")]
        out, held = sequential_shuffle(arrivals, 5, 8)
        assert [r.doc_id for r in mine[:len(out)]] == out and {r.doc_id for r in mine[len(out):]} == set(held)


def test_throughput_across_batches_equals_the_intervals(spark):
    from lexicount.operators import packing
    rows = [(i, float(i % 7), 1_700_000_000 + 3 * i + (i // 10) ** 2) for i in range(1, 95)]
    steps = spark.createDataFrame(rows, "step long, loss double, s long").select(
        "step", "loss", F.timestamp_seconds("s").alias("ts"))
    src = tempfile.mkdtemp(prefix="lexicount-steps-", dir="/tmp")
    steps.repartition(5, "step").write.mode("append").parquet(src)
    live = spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = R.run_updates(R.stream_log_throughput(live, 10, 512), "interval").filter("n_steps > 0")
    want = packing.log_intervals(steps, 10, 512).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_shuffle_buffers_are_no_task_of_python(spark):
    """Order and ties of one batch; no lane goes through one Python group."""
    src = tempfile.mkdtemp(prefix="lexicount-lanes-", dir="/tmp")
    rows = [(i if i % 50 else None, "a", f"text {i}") for i in range(1, 400)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3).write.mode("append").parquet(src)
    stream = R.stream_corpus(spark, src, "doc_id long, lang string, text string")
    got = R.stream_local_shuffle(stream, 3, R.scratch(spark, "test-lanes"), buffer=5, lanes=2)
    assert "Python" not in got._jdf.queryExecution().toString() and not hasattr(R, "pd")
    got = got.orderBy("lane", "seq").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((x or 0, t) for x, _, t in rows)
    for lane in {r.lane for r in got}:
        mine = [r for r in got if r.lane == lane]
        assert [r.seq for r in mine] == list(range(1, len(mine) + 1))
        ids = sorted((r.doc_id for r in mine), key=lambda x: (x is None, x))
        out, held = sequential_shuffle([(lane, x) for x in ids], 3, 5)
        assert [r.doc_id for r in mine[:len(out)]] == out
