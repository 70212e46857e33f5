"""The water-fill plan held, draw by draw, against the rule of the mixture."""
from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexicount.config import MixConfig
from lexicount.operators import budget, mixture
from lexicount.plans.fixture import FIXTURE_PREMIUM
from lexicount.sources.corpus import documents_corpus

from conftest import SF_SMALL


def audit_draws(draws, share_at, budget_total, caps, slack):
    """Walk a finished plan and hold every draw against the rule it must follow.

    ``draws`` are (language, tokens) in order. A drawn language may be ahead of
    its share by ``slack`` tokens at most compared with the language furthest
    behind, and the plan goes on exactly until the budget or a cap is passed.
    """
    got = Counter()
    for n, (lang, tokens) in enumerate(draws):
        done = sum(got.values())
        assert done < budget_total and all(got[k] <= caps[k] for k in caps), f"draw {n} comes after the end"
        share = share_at(done / budget_total)
        assert lang in share, (n, lang)
        among = sum(got[k] for k in share)
        behind = {k: share[k] * among - got[k] for k in share}
        assert behind[lang] >= max(behind.values()) - slack, (n, lang, behind)
        got[lang] += tokens
    assert sum(got.values()) >= budget_total or any(got[k] > caps[k] for k in caps), "the plan ends early"


def _setup(spark):
    c = budget.with_ref_tokens(documents_corpus(spark, SF_SMALL), FIXTURE_PREMIUM)
    docs = c.select("lang", "doc_id", F.col("num_tokens").alias("raw_tokens"), "ref_tokens")
    rows = docs.collect()
    by = {}
    for r in rows:
        by.setdefault(r.lang, []).append((r.doc_id, r.ref_tokens))
    avail = {r.lang: r.available for r in budget.available_ref_tokens(
        docs.withColumnRenamed("raw_tokens", "num_tokens"), FIXTURE_PREMIUM).collect()}
    maxdoc = {k: max(t for _, t in v) for k, v in by.items()}
    return docs, by, avail, maxdoc


@pytest.mark.parametrize("schedule", [
    ((0.0, {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}),),
    ((0.0, {"en": 1.0}), (0.5, {"en": 0.6, "de": 0.4}), (0.9, {"en": 0.34, "de": 0.33, "fr": 0.33})),
])
def test_plan_follows_the_rule(spark, schedule):
    docs, by, avail, maxdoc = _setup(spark)
    budget_tokens = sum(avail.values())
    cfg = MixConfig(schedule=schedule, budget_reference_tokens=budget_tokens, max_epochs=2, seed=12,
                    premium=dict(FIXTURE_PREMIUM))
    plan = mixture.mix_plan(docs, cfg)
    pts = budget.validate_schedule(schedule)

    def weights_at(f):
        cur = pts[0][1]
        for fr, w in pts:
            if f >= fr:
                cur = w
        return cur

    draws = [(r.lang, r.ref_tokens) for r in plan.orderBy("draw").collect()]
    caps = {k: 2 * max(1, avail[k]) for _, w in pts for k in w}
    audit_draws(draws, weights_at, budget_tokens * 2, caps, slack=3 * max(maxdoc.values()))
