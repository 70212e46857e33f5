"""Registered queries: one Spark plan per operator, each with its SQL oracle.

Every query reads the driver's tables (``sf_dir``) or data Spark derives
from them, over whole tables and whole texts. ``ORACLE`` holds the same
query in plain SQL (DuckDB dialect) for the correctness gate.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from ..sinks import writers
from ..sources.corpus import at_rest, documents_corpus, table
from ..streaming.jobs import scratch
from .fixture import FIXTURE_GROUPS, FIXTURE_SEED

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# Shared SQL fragments
# ---------------------------------------------------------------------------

CORPUS_CTE = r"""corpus AS (
  SELECT doc_id, lang, source AS category, source AS data_source,
         CASE WHEN doc_id % 5 = 0 THEN 'Cyrl' WHEN lang IN ('en','de','es','fr','eng','nld') THEN 'Latn'
              WHEN lang = 'zho' THEN 'Hans' END AS script,
         CASE doc_id % 4 WHEN 0 THEN 'n/a' WHEN 2 THEN '5+' WHEN 3 THEN '6+' END AS age_estimate, text, n_chars,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) AS BIGINT) AS num_tokens
  FROM documents)"""


def crc32_sql(digits: str) -> str:
    """crc32 of a string of ASCII characters, bit by bit."""
    step = "list_reduce(range(0, 8)::UBIGINT[], lambda y, i: xor(y >> 1, 3988292384 * (y & 1)), xor(c, a)::UBIGINT)"
    codes = f"list_transform(string_split({digits}, ''), lambda z: ascii(z)::UBIGINT)"
    return f"xor(list_reduce({codes}, lambda c, a: {step}, 4294967295::UBIGINT), 4294967295::UBIGINT)"


def _groups_case(col: str = "category") -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in FIXTURE_GROUPS.items())
    return f"coalesce(CASE {whens} END, 'Other')"


# ---------------------------------------------------------------------------
# Audit (A01-A11, A21, A23, W04, L02, L03)
# ---------------------------------------------------------------------------

@register("corpus_profile", f"""WITH {CORPUS_CTE}
SELECT lang, count(*) AS n_docs, CAST(sum(num_tokens) AS BIGINT) AS total_raw_tokens,
       CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS total_chars
FROM corpus GROUP BY lang""")
def q_corpus_profile(spark, d):
    return audit.corpus_profile(documents_corpus(spark, d))


@register("length_stats", f"""WITH {CORPUS_CTE}
SELECT lang, CAST(floor(avg(coalesce(length(text), 0))) AS BIGINT) AS doc_chars_mean,
       quantile_cont(coalesce(length(text), 0), 0.5) AS doc_chars_median,
       quantile_cont(coalesce(length(text), 0), 0.95) AS doc_chars_p95,
       CAST(max(coalesce(length(text), 0)) AS BIGINT) AS doc_chars_max
FROM corpus GROUP BY lang""")
def q_length_stats(spark, d):
    return audit.length_stats(documents_corpus(spark, d))


@register("token_share", f"""WITH {CORPUS_CTE},
t AS (SELECT lang, category, CAST(sum(num_tokens) AS BIGINT) AS tokens FROM corpus GROUP BY ALL)
SELECT lang, category, tokens,
       round(CAST(tokens AS DOUBLE) / CAST(sum(tokens) OVER (PARTITION BY lang) AS DOUBLE), 4) AS token_share
FROM t""")
def q_token_share(spark, d):
    return audit.token_share(documents_corpus(spark, d), dim="category")


@register("doc_share", f"""WITH {CORPUS_CTE},
t AS (SELECT lang, category, count(*) AS docs FROM corpus GROUP BY ALL)
SELECT lang, category, docs,
       round(CAST(docs AS DOUBLE) / CAST(sum(docs) OVER (PARTITION BY lang) AS DOUBLE), 4) AS doc_share
FROM t""")
def q_doc_share(spark, d):
    return audit.doc_share(documents_corpus(spark, d), dim="category")


@register("script_share", f"""WITH {CORPUS_CTE},
t AS (SELECT lang, script, CAST(sum(num_tokens) AS BIGINT) AS tokens FROM corpus GROUP BY ALL)
SELECT lang, script, tokens,
       round(CAST(tokens AS DOUBLE) / CAST(sum(tokens) OVER (PARTITION BY lang) AS DOUBLE), 4) AS token_share
FROM t""")
def q_script_share(spark, d):
    return audit.token_share(documents_corpus(spark, d), dim="script")


@register("top_sources", f"""WITH {CORPUS_CTE},
t AS (SELECT lang, data_source, CAST(sum(num_tokens) AS BIGINT) AS tokens FROM corpus GROUP BY ALL),
s AS (SELECT lang, data_source, tokens,
        round(CAST(tokens AS DOUBLE) / CAST(sum(tokens) OVER (PARTITION BY lang) AS DOUBLE), 4) AS token_share,
        row_number() OVER (PARTITION BY lang ORDER BY tokens DESC, data_source ASC) AS rank
      FROM t)
SELECT lang, data_source, tokens, token_share, CAST(rank AS INTEGER) AS rank FROM s WHERE rank <= 5""")
def q_top_sources(spark, d):
    return audit.top_sources(documents_corpus(spark, d), k=5)


@register("top_doc_share", f"""WITH {CORPUS_CTE},
t AS (SELECT lang, data_source, count(*) AS docs FROM corpus GROUP BY ALL),
s AS (SELECT lang, data_source, docs,
        round(CAST(docs AS DOUBLE) / CAST(sum(docs) OVER (PARTITION BY lang) AS DOUBLE), 4) AS doc_share,
        row_number() OVER (PARTITION BY lang ORDER BY docs DESC, data_source ASC) AS rank
      FROM t)
SELECT lang, data_source, docs, doc_share, CAST(rank AS INTEGER) AS rank FROM s WHERE rank <= 10""")
def q_top_doc_share(spark, d):
    return audit.top_doc_share(documents_corpus(spark, d), k=10, dim="data_source")


@register("age_coverage", f"""WITH {CORPUS_CTE}
SELECT lang, count(*) AS n_docs,
       CAST(sum(CASE WHEN coalesce(age_estimate, 'n/a') = 'n/a' THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
       round(1.0 - CAST(sum(CASE WHEN coalesce(age_estimate, 'n/a') = 'n/a' THEN 1 ELSE 0 END) AS DOUBLE)
             / CAST(count(*) AS DOUBLE), 4) AS age_coverage
FROM corpus GROUP BY lang""")
def q_age_coverage(spark, d):
    return audit.age_coverage(documents_corpus(spark, d))


_DUP_SQL = """WITH {cte}
SELECT lang, count(*) AS n_docs, count(DISTINCT md5({expr})) AS unique_hashes,
       round(1.0 - CAST(count(DISTINCT md5({expr})) AS DOUBLE) / CAST(count(*) AS DOUBLE), 4) AS dup_rate
FROM corpus GROUP BY lang"""


@register("prefix_dup_rate", _DUP_SQL.format(cte=CORPUS_CTE, expr="substring(coalesce(text, ''), 1, 300)"))
def q_prefix_dup_rate(spark, d):
    return audit.prefix_dup_rate(documents_corpus(spark, d), n=300)


@register("exact_dup_rate", _DUP_SQL.format(cte=CORPUS_CTE, expr="coalesce(text, '')"))
def q_exact_dup_rate(spark, d):
    return audit.prefix_dup_rate(documents_corpus(spark, d), n=None)


@register("register_rollup", f"""WITH {CORPUS_CTE},
g AS (SELECT lang, {_groups_case()} AS register_group, num_tokens FROM corpus),
langs AS (SELECT DISTINCT lang FROM corpus),
names AS (SELECT * FROM (VALUES ('Transcription'), ('Education'), ('Books, Wiki, News'),
                                ('Subtitles'), ('Padding'), ('Other')) v(register_group))
SELECT l.lang, n.register_group,
       CAST(coalesce((SELECT sum(num_tokens) FROM g WHERE g.lang = l.lang
                      AND g.register_group = n.register_group), 0) AS BIGINT) AS tokens
FROM langs l, names n""")
def q_register_rollup(spark, d):
    return audit.register_rollup(documents_corpus(spark, d), groups=FIXTURE_GROUPS)


def _fixture_classes():
    g = F.element_at(F.create_map(*[F.lit(x) for kv in FIXTURE_GROUPS.items() for x in kv]),
                     F.col("category"))
    return {"transcription_share": g == "Transcription",
            "subtitle_share": g.isin("Subtitles", "Padding"),
            "educational_share": g == "Education"}


@register("register_comparability", f"""WITH {CORPUS_CTE},
g AS (SELECT lang, {_groups_case()} AS grp, num_tokens FROM corpus)
SELECT lang,
  round(CAST(sum(CASE WHEN grp = 'Transcription' THEN num_tokens ELSE 0 END) AS DOUBLE) / CAST(sum(num_tokens) AS DOUBLE), 4) AS transcription_share,
  round(CAST(sum(CASE WHEN grp IN ('Subtitles', 'Padding') THEN num_tokens ELSE 0 END) AS DOUBLE) / CAST(sum(num_tokens) AS DOUBLE), 4) AS subtitle_share,
  round(CAST(sum(CASE WHEN grp = 'Education' THEN num_tokens ELSE 0 END) AS DOUBLE) / CAST(sum(num_tokens) AS DOUBLE), 4) AS educational_share
FROM g GROUP BY lang""")
def q_register_comparability(spark, d):
    return audit.register_comparability(documents_corpus(spark, d), _fixture_classes())


@register("whitespace_ratio", f"""WITH {CORPUS_CTE},
c AS (SELECT *, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r]+'), lambda x: x <> '')) AS BIGINT) AS ws_tokens
      FROM corpus)
SELECT lang, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS raw_token_field_sum,
       CAST(sum(ws_tokens) AS BIGINT) AS empirical_whitespace_tokens,
       CAST(sum(n_chars) AS DOUBLE) / CAST(sum(ws_tokens) AS DOUBLE) AS raw_to_ws_ratio,
       CAST(floor(sum(ws_tokens) / count(*)) AS BIGINT) AS ws_per_doc_mean
FROM c GROUP BY lang""")
def q_whitespace_ratio(spark, d):
    """The stored size field of the table (n_chars) against the words counted in the texts."""
    c = table(spark, d, "documents")
    ws = F.size(F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"[ \t\n\r]+"), lambda x: x != ""))
    return audit.whitespace_ratio(c.withColumn("ws_tokens", ws), field="n_chars")


# where a row lies in the pre-shuffled copy of the corpus: files and rows are ordered by the seeded key
AT_REST_SQL = f"md5(concat_ws('|', '{FIXTURE_SEED}', '0', CAST(doc_id AS VARCHAR)))"


def shuffled_at_rest(spark, d):
    """The corpus as it lies in several pre-shuffled files, with positions."""
    out = scratch(spark, "at-rest")
    c = documents_corpus(spark, d).select("doc_id", "lang", "category", "num_tokens")
    writers.write_shuffled(c, out, FIXTURE_SEED, partitions=5)
    return at_rest(spark, out)


@register("prefix_sample", f"""WITH {CORPUS_CTE},
r AS (SELECT *, {AT_REST_SQL} AS at, row_number() OVER (PARTITION BY lang ORDER BY {AT_REST_SQL}) AS rn FROM corpus)
SELECT doc_id, lang, category, num_tokens FROM r WHERE rn <= 25""")
def q_prefix_sample(spark, d):
    return audit.prefix_sample(shuffled_at_rest(spark, d), 25, by=("lang",), order=("position",)).select(
        "doc_id", "lang", "category", "num_tokens")


@register("order_bias", f"""WITH {CORPUS_CTE},
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {AT_REST_SQL}) AS rn FROM corpus),
a AS (SELECT lang, category, count(*) AS docs_all,
             CAST(sum(CASE WHEN rn <= 50 THEN 1 ELSE 0 END) AS BIGINT) AS docs_head FROM r GROUP BY ALL),
s AS (SELECT *, CAST(docs_all AS DOUBLE) / sum(docs_all) OVER (PARTITION BY lang) AS share_all,
             CAST(docs_head AS DOUBLE) / sum(docs_head) OVER (PARTITION BY lang) AS share_head FROM a)
SELECT *, sum(abs(share_head - share_all)) OVER (PARTITION BY lang) / 2 AS tv_distance FROM s""")
def q_order_bias(spark, d):
    return audit.order_bias(shuffled_at_rest(spark, d), 50, order=("position",))


@register("category_samples", f"""WITH {CORPUS_CTE},
r AS (SELECT *, row_number() OVER (PARTITION BY lang, category
                                   ORDER BY md5(concat_ws('|', '12', CAST(doc_id AS VARCHAR))), doc_id) AS sample_no
      FROM corpus)
SELECT lang, category, CAST(sample_no AS INTEGER) AS sample_no, doc_id, data_source AS src, age_estimate AS age,
       CAST(coalesce(length(text), 0) AS INTEGER) AS len,
       replace(substring(text, 1, 200), chr(10), '\\n') AS head
FROM r WHERE sample_no <= 2""")
def q_category_samples(spark, d):
    return audit.category_samples(documents_corpus(spark, d), n=2, seed=12)


# Query modules register themselves on import.
from . import q_plan  # noqa: E402,F401
from . import q_leak  # noqa: E402,F401
from . import q_eval  # noqa: E402,F401
from . import q_logs  # noqa: E402,F401
from . import q_tok  # noqa: E402,F401
from . import q_stream  # noqa: E402,F401
from . import q_more  # noqa: E402,F401
