"""Plan-level scale guards: no running total or rank sorts raw rows in one task.

A ``Window`` without a partition spec puts every input row into one task;
it is only acceptable on top of an aggregate (bucket totals, one row per
model, one row per log interval). The executed plans of the heavy queries
are walked and every unpartitioned window must have an aggregate below it.
"""
from __future__ import annotations

import re

import pytest

from lexicount.config import MixConfig
from lexicount.operators import mixture
from lexicount.plans.catalog import QUERIES
from lexicount.plans.q_plan import fixture_config, plan_docs

from conftest import SF_SMALL

HEAVY = ["corpus_profile", "length_stats", "token_share", "prefix_dup_rate", "category_samples",
         "order_bias", "leakage_hits", "train_log_steps", "tokenizer_sample", "pack_pieces",
         "milestone_crossings", "revision_curve_rows", "language_average", "leaderboard",
         "log_intervals", "sweep_scores", "whitespace_ratio", "top_sources"]


def _unpartitioned_windows_without_aggregate(df) -> list[str]:
    df.write.format("noop").mode("overwrite").save()
    lines = df._jdf.queryExecution().executedPlan().treeString().splitlines()
    bad = []
    for i, line in enumerate(lines):
        if "Window [" not in line or "WindowGroupLimit" in line:
            continue
        first = re.search(r"windowspecdefinition\(([^,)]*)", line)
        if not first:
            continue
        head = first.group(1)
        unpartitioned = (" ASC" in head or " DESC" in head or head.startswith("specifiedwindowframe"))
        if not unpartitioned:
            continue
        indent = len(line) - len(line.lstrip(" :+-"))
        below = []
        for nxt in lines[i + 1:]:
            if len(nxt) - len(nxt.lstrip(" :+-")) <= indent:
                break
            below.append(nxt)
        if not any("Aggregate" in x for x in below):
            bad.append(line.strip()[:150])
    return bad


@pytest.mark.parametrize("name", HEAVY)
def test_no_global_window_over_raw_rows(spark, name):
    assert _unpartitioned_windows_without_aggregate(QUERIES[name](spark, SF_SMALL)) == []


def test_mixture_plan_internals(spark):
    docs = plan_docs(spark, SF_SMALL)
    base = fixture_config(docs)
    for cfg in (base, MixConfig(schedule=((0.0, {"en": 1.0}), (0.5, {"en": 0.5, "de": 0.5})),
                                budget_reference_tokens=base.budget_reference_tokens, max_epochs=2,
                                premium=base.premium)):
        plan = mixture.mix_plan(docs, cfg, checkpoint=False)
        assert _unpartitioned_windows_without_aggregate(plan) == []


def test_guard_detects_a_global_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    bad = df.withColumn("cum", F.sum("v").over(Window.orderBy("id")))
    assert _unpartitioned_windows_without_aggregate(bad) != []
