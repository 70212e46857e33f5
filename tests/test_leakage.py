"""Anchored leakage join == nested-loop join (including short probes and
probes that start or end mid-word)."""
from __future__ import annotations

import pytest

from lexicount.operators import leakage
from lexicount.sources.corpus import documents_corpus, table

from conftest import SF_SMALL


def _key(rows):
    return sorted((r.set, r.probe_id, r.doc_id, r.match_pos, r.context) for r in rows)


def test_anchored_equals_nested_on_fixture(spark):
    docs = documents_corpus(spark, SF_SMALL)
    probes = leakage.prepare_probes(table(spark, SF_SMALL, "benchmark"))
    a = leakage.leakage_hits(docs, probes).collect()
    b = leakage.leakage_hits_nested(docs, probes).collect()
    assert _key(a) == _key(b)


@pytest.mark.parametrize("block_chars", [1 << 22, 1500])
def test_automaton_equals_nested(spark, block_chars):
    docs = documents_corpus(spark, SF_SMALL)
    probes = leakage.prepare_probes(table(spark, SF_SMALL, "benchmark"))
    assert (leakage.n_blocks(probes, block_chars) > 1) == (block_chars < 1 << 22)
    a = leakage.leakage_hits_char(docs, probes, block_chars=block_chars).collect()
    b = leakage.leakage_hits_nested(docs, probes, block_chars=block_chars * 2).collect()
    assert _key(a) == _key(b) and len(a) > 0


def test_automaton_on_unspaced_text_and_odd_probes(spark):
    zh = spark.createDataFrame([(1, "zho", "s", "c", "我们今天去公园散步然后回家吃饭睡觉😀公园"), (2, "zho", "s", "c", "公园"),
                                (3, "zho", "s", "c", None), (4, None, None, None, ""), (5, "en", "s", "c", "aaaa")],
                               "doc_id long, lang string, data_source string, category string, text string")
    pr = spark.createDataFrame([("z", 1, "今天去公园散步然后"), ("z", 2, "公园"), ("y", 7, "公园"), ("z", 3, "园散"),
                                ("z", 4, "aa"), ("z", 5, "😀公"), ("z", 6, "x")], "set string, probe_id long, probe string")
    got = leakage.leakage_hits_char(zh, pr).collect()
    assert _key(got) == _key(leakage.leakage_hits_nested(zh, pr).collect())
    assert sorted((r.probe_id, r.doc_id) for r in got) == [(1, 1), (2, 1), (2, 2), (3, 1), (4, 5), (5, 1), (7, 1), (7, 2)]
    assert leakage.leakage_hits_char(zh, pr.limit(0)).count() == 0
    assert leakage.leakage_hits_char(zh.limit(0), pr).count() == 0


def test_automaton_plan_shuffles_nothing(spark):
    docs = documents_corpus(spark, SF_SMALL)
    probes = leakage.prepare_probes(table(spark, SF_SMALL, "benchmark"))
    plan = leakage.leakage_hits_char(docs, probes)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Generate" not in plan


@pytest.mark.parametrize("block_chars", [1 << 22, 100])
def test_stream_over_several_batches_equals_the_batch_screen(spark, block_chars):
    from pyspark.sql import functions as F

    from lexicount.sources.corpus import DOCUMENTS_SCHEMA, corpus_view
    from lexicount.streaming import jobs as R
    raw = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    src = R.scratch(spark, "test-leak-src")
    for i in range(3):
        raw.filter(F.col("doc_id") % 3 == i).coalesce(1).write.mode("append").parquet(src)
    probes = leakage.prepare_probes(table(spark, SF_SMALL, "benchmark"))
    probes = probes.unionByName(spark.createDataFrame([("benchmark", -1, "la")], probes.schema))  # too short for an n-gram
    stream = corpus_view(R.stream_corpus(spark, src, DOCUMENTS_SCHEMA, max_files_per_trigger=1))
    out = R.scratch(spark, "test-leak-out")
    R.stream_leakage(stream, probes, out, block_chars=block_chars).awaitTermination()
    want = leakage.leakage_hits_nested(documents_corpus(spark, SF_SMALL), probes).collect()
    assert _key(spark.read.parquet(out).collect()) == _key(want)


def test_anchored_handles_cut_words_and_short_probes(spark):
    text = "Alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, "en", "s", "c", text), (2, "en", "s", "c", "nothing here at all")],
                                 "doc_id long, lang string, data_source string, category string, text string")
    probes = spark.createDataFrame([
        ("t", 1, "pha beta gamma delta epsi"),   # cut at both ends
        ("t", 2, "delta eps"),                   # too short for an interior anchor
        ("t", 3, "gamma  delta epsilon zeta"),   # whitespace differs: not a substring
        ("t", 4, "theta iota kappa"),
    ], "set string, probe_id long, probe string")
    got = sorted((r.probe_id, r.doc_id) for r in leakage.leakage_hits(docs, probes).collect())
    assert got == [(1, 1), (2, 1), (4, 1)]
    summ = leakage.leakage_summary(leakage.leakage_hits(docs, probes), probes).collect()[0]
    assert (summ.probes, summ.hits_total, summ.hit_pairs) == (4, 3, 3)
