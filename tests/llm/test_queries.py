"""Registered queries of the subpackage on the smallest tables, and the pipeline against brute force."""
from __future__ import annotations

import re
from collections import Counter

import pytest
from conftest import SF_SMALL
from oracle_check import compare, open_oracle
from pyspark.sql import functions as F

import corpus_pipeline
from lexicount.llm import minhash, pieces, quality
from lexicount.llm.common import table
from lexicount.llm.queries import ORACLE, QUERIES

ROWS = {"op2_toxicity": "documents", "op3_quality": "documents", "op8_sentencepiece": "documents", "op10_language": "pages",
        "op13_fingerprints": "documents"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    ok, message = compare(spark, open_oracle(SF_SMALL), SF_SMALL, name, QUERIES[name], ORACLE[name])
    assert ok, message


@pytest.mark.parametrize("name", sorted(ROWS))
def test_one_row_per_input_row(spark, name):
    source = table(spark, SF_SMALL, ROWS[name])
    key = source.columns[0]
    got = QUERIES[name](spark, SF_SMALL)
    assert got.select(key).exceptAll(source.select(key)).count() == 0 and got.count() == source.count()


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_language_of_pages(spark):
    got = QUERIES["op10_language"](spark, SF_SMALL).join(table(spark, SF_SMALL, "pages").select("page_id", "url"), "page_id")
    path = F.regexp_extract("url", r"://[^/]+/([a-z]{2})/", 1)
    assert got.filter((path != "") & (path != F.col("lang"))).count() == 0


def test_pipeline_stages_against_brute_force(spark):
    docs = table(spark, SF_SMALL, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen, frames = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        frames = corpus_pipeline.cut(stage(spark, frames, SF_SMALL), "test-stage")
        seen[name] = frames
        if name != names[-1]:
            assert frames.columns == docs.columns
    everything = {r.doc_id: r for r in docs.collect()}
    model = quality.fit(docs, table(spark, SF_SMALL, "labels"))
    selected = {i: r for i, r in everything.items()
                if model.tails((quality.text_features(r.text) @ model.weights).reshape(1))[0, 0] >= quality.SELECT_TAIL}
    assert {r.doc_id for r in seen[names[0]].collect()} == set(selected)
    first = {}
    for i in sorted(selected):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", selected[i].text or ""), i)
    assert {r.doc_id for r in seen[names[1]].collect()} == set(first.values())
    sets = {i: minhash.shingle_set(minhash.byte_words(everything[i].text), 5) for i in sorted(first.values())}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    ids = [i for i in sets if sets[i]]
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    assert {r.doc_id for r in seen[names[2]].collect()} == {i for i in sets if root(i) == i}
    size, total = Counter(), Counter()
    for r in seen[names[2]].collect():
        size[r.source] += len(minhash.byte_words(r.text))
    for r in seen[names[3]].collect():
        total[r.source] += len(minhash.byte_words(r.text))
    assert all(total[s] <= 2 * size[s] for s in total)
    assert abs(sum(total.values()) / (1.5 * sum(size.values())) - 1) < 0.1
    voc = pieces.load_vocabulary(pieces.MODEL_PATH)
    out = seen[names[4]]
    assert out.count() == seen[names[3]].count() and out.filter("not exact").count() == 0
    assert all(pieces.decode_ids(voc, r.ids) == everything[r.doc_id].text for r in out.limit(50).collect())
