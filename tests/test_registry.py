"""Every registered query runs on the smallest tables and matches its SQL oracle."""
from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from lexicount.plans.catalog import QUERIES
from conftest import SF_SMALL
from oracle_check import compare, open_oracle

# covered (exactly, against a sequential learner and by enumeration) by test_tokenizer.py
HEAVY = {"unigram_vocab", "unigram_invariants", "bpe_vocab_specials"}
NAMES = [n for n in QUERIES if n not in HEAVY]


@pytest.fixture(scope="module")
def con():
    return open_oracle(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, SF_SMALL, name, queries()[name], oracle_sql().get(name))
    assert ok, msg


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "token_share" in df.columns


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
