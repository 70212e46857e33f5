"""Smoke run of the training-data path: sample -> BPE -> encode -> mixture
plan -> pack -> steps -> milestones -> summary, with an exact check of the
packed ids against a driver-side concatenation (small data, test only)."""
from __future__ import annotations

import json

from pyspark.sql import functions as F

from lexicount.config import MixConfig, PackConfig
from lexicount.operators import budget, mixture, packing, tokenizer
from lexicount.plans.fixture import FIXTURE_PREMIUM
from lexicount.sinks import writers as K
from lexicount.sources.corpus import documents_corpus
from lexicount.streaming.jobs import scratch

from conftest import SF_SMALL

SEQ = 64


def test_end_to_end_packing_is_exact(spark):
    corpus = budget.with_ref_tokens(documents_corpus(spark, SF_SMALL), FIXTURE_PREMIUM)
    sample = budget.char_budget_sample(corpus, 20_000, seed=12)
    merges, _ = tokenizer.learn_bpe(tokenizer.pretoken_counts(sample), vocab_size=4 + 256 + 20)
    eos = 2
    enc = tokenizer.encode(corpus.select("lang", "doc_id", "text"), merges).select("lang", "doc_id", "ids")
    docs = corpus.select("lang", "doc_id", F.col("num_tokens").alias("raw_tokens"), "ref_tokens")
    cfg = MixConfig(weights={"en": 0.5, "de": 0.2, "es": 0.15, "fr": 0.15}, budget_reference_tokens=10_000,
                    max_epochs=2, seed=12, premium=dict(FIXTURE_PREMIUM))
    plan = mixture.mix_plan(docs, cfg)
    with_ids = plan.join(enc, ["lang", "doc_id"]).withColumn("n_tokens", F.size("ids"))
    pieces = packing.pack_pieces(with_ids, SEQ, length="n_tokens")
    seqs = packing.pack_sequences(pieces, eos_id=eos)
    out = scratch(spark, "e2e-seqs")
    K.write_sequences(seqs, out)
    got = [r.input_ids for r in spark.read.parquet(out).orderBy("seq_id").collect()]
    assert got and all(len(s) == SEQ for s in got)
    # driver-side reference: ids + <eos> of non-empty documents in draw order
    rows = with_ids.filter(F.col("n_tokens") > 0).orderBy("draw").select("ids").collect()
    flat = [t for r in rows for t in list(r.ids) + [eos]]
    want = [flat[i * SEQ:(i + 1) * SEQ] for i in range(len(flat) // SEQ)]
    assert got == want

    ms = packing.milestone_crossings(plan, [10_000, 100_000]).collect()
    assert {r.name for r in ms} <= {"chck_1M"}
    assert all(r.name_collision for r in ms) or len(ms) < 2

    pc = PackConfig(seq_len=SEQ, micro_batch_size=4, grad_accum_steps=2, world_size=2)
    steps = packing.assign_steps(seqs.select("seq_id"), pc)
    n_steps = steps.agg(F.max("step")).collect()[0][0]
    avail = budget.available_ref_tokens(docs.withColumnRenamed("raw_tokens", "num_tokens"), FIXTURE_PREMIUM)
    summary = json.loads(K.run_summary(budget.consumption_summary(plan, avail), n_steps).collect()[0].json)
    assert summary["steps"] == n_steps
    assert summary["ref_tokens"] == plan.agg(F.sum("ref_tokens")).collect()[0][0]
    assert summary["ref_tokens"] >= cfg.total_token_budget or any(
        v > cfg.max_epochs for v in summary["epochs_per_lang"].values())
    # ranks receive disjoint sequences
    per_rank = steps.groupBy("rank").agg(F.collect_set("seq_id").alias("s")).collect()
    seen = [set(r.s) for r in per_rank]
    assert sum(len(x) for x in seen) == len(set().union(*seen))
