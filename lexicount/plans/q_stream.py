"""Registered streaming queries: each stream runs to completion over the
driver's files (``availableNow``) and the sink is returned; the oracle is the
batch result of the same computation."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import leakage
from ..sources.corpus import DOCUMENTS_SCHEMA, corpus_view, table
from ..streaming import jobs as R
from .catalog import CORPUS_CTE, ORACLE, crc32_sql, register
from .fixture import FIXTURE_PREMIUM, FIXTURE_SEED
from .q_leak import LEAK_CTE
from .q_logs import STEPS_CTE, TOKENS_PER_STEP, step_rows, train_log_lines
from .q_plan import _values

WHITELIST = {"en": [f"src{i}" for i in range(10)]}
MILESTONES = [50_000 * i for i in range(1, 9)]
LOG_EVERY = 25
BUFFER, LANES = 24, 2


def doc_stream(spark, d, whitelist=None):
    # a glob, because a file source watches a directory (or a pattern in it)
    raw = R.stream_corpus(spark, f"{d}/documents*.parquet", DOCUMENTS_SCHEMA)
    c = corpus_view(raw)
    return c.filter(R.whitelist_predicate(whitelist)) if whitelist else c


REF_CTE = f"""{CORPUS_CTE}, {_values(FIXTURE_PREMIUM, 'prem')},
ref AS (SELECT c.*, CAST(floor(c.num_tokens / p.x) AS BIGINT) AS ref_tokens FROM corpus c JOIN prem p USING (lang))"""


@register("stream_consumption", f"""WITH {REF_CTE}
SELECT lang, CAST(sum(ref_tokens) AS BIGINT) AS consumed, count(*) AS docs,
       CAST(sum(ref_tokens) AS DOUBLE) / 1000000.0 AS frac_of_budget
FROM ref WHERE lang <> 'en' OR category IN ({', '.join(repr(c) for c in WHITELIST['en'])}) GROUP BY lang""")
def q_stream_consumption(spark, d):
    s = doc_stream(spark, d, WHITELIST)
    return R.run_to_memory(R.stream_consumption(s, FIXTURE_PREMIUM, 1_000_000), mode="complete")


# the buffer of every lane, one arrival at a time
SHUFFLE_SQL = f"""WITH RECURSIVE a AS (
  SELECT doc_id, concat_ws('|', lang, CAST({crc32_sql('CAST(doc_id AS VARCHAR)')} % {LANES} AS VARCHAR)) AS lane FROM documents),
i AS (SELECT lane, doc_id, row_number() OVER (PARTITION BY lane ORDER BY doc_id) AS n FROM a),
t(lane, n, held, gone) AS (SELECT DISTINCT lane, 0::BIGINT, []::BIGINT[], NULL::BIGINT FROM i
  UNION ALL
  SELECT s.lane, s.n, CASE WHEN s.n <= {BUFFER} THEN list_append(s.held, s.doc_id)
                           ELSE list_concat(s.held[:s.slot], [s.doc_id], s.held[s.slot + 2:]) END,
         CASE WHEN s.n > {BUFFER} THEN s.held[s.slot + 1] END
  FROM (SELECT t.lane, i.n, t.held, i.doc_id,
               ('0x' || substr(md5(concat_ws('|', '{FIXTURE_SEED}', t.lane, CAST(i.n AS VARCHAR))), 1, 8))::BIGINT % {BUFFER} AS slot
        FROM t JOIN i ON i.lane = t.lane AND i.n = t.n + 1) s),
z AS (SELECT lane, n, held FROM t WHERE n = (SELECT max(n) FROM i WHERE i.lane = t.lane)),
r AS (SELECT lane, n, len(held) AS m, unnest(held) AS doc_id, unnest(range(0, len(held))) AS slot FROM z)
SELECT lane, CAST(n - {BUFFER} AS BIGINT) AS seq, gone AS doc_id FROM t WHERE gone IS NOT NULL
UNION ALL
SELECT lane, CAST(n - m + row_number() OVER (PARTITION BY lane ORDER BY
       md5(concat_ws('|', '{FIXTURE_SEED}', lane, 'rest', CAST(slot AS VARCHAR))), slot) AS BIGINT), doc_id FROM r"""


@register("stream_local_shuffle", SHUFFLE_SQL)
def q_stream_local_shuffle(spark, d):
    out = R.scratch(spark, "shuffled")
    docs = doc_stream(spark, d)
    return R.stream_local_shuffle(docs.select("lang", "doc_id", "text"), FIXTURE_SEED, out, BUFFER, LANES).select(
        "lane", "seq", "doc_id")


@register("stream_log_throughput", ORACLE["log_intervals"])
def q_stream_log_throughput(spark, d):
    """The steps arrive in several files, one to a batch and out of order."""
    logdir = R.scratch(spark, "steplog")
    steps = step_rows(spark, d).select("step", F.col("value").alias("loss"), "ts")
    steps.repartition(4, "step").write.parquet(logdir)
    live = spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 1).parquet(logdir)
    out = R.run_updates(R.stream_log_throughput(live, LOG_EVERY, TOKENS_PER_STEP), "interval")
    return out.filter("n_steps > 0")


@register("stream_milestones", f"""WITH {REF_CTE},
r AS (SELECT doc_id, ref_tokens, coalesce(sum(ref_tokens) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING
             AND 1 PRECEDING), 0) AS total_before FROM ref),
m AS (SELECT unnest([{', '.join(map(str, MILESTONES))}]) AS milestone)
SELECT m.milestone, 'chck_' || CAST(greatest(ceil(m.milestone / 1000000), 1) AS BIGINT) || 'M' AS name, r.doc_id,
       CAST(r.total_before + r.ref_tokens AS BIGINT) AS ref_tokens_at_save
FROM r JOIN m ON r.total_before < m.milestone AND r.total_before + r.ref_tokens >= m.milestone""")
def q_stream_milestones(spark, d):
    from ..operators.budget import with_ref_tokens
    state = R.scratch(spark, "milestones")
    s = with_ref_tokens(doc_stream(spark, d), FIXTURE_PREMIUM)
    R.stream_milestones(s, MILESTONES, state).awaitTermination()
    return spark.read.parquet(f"{state}/events").drop("batch_id")


@register("stream_log_metrics", f"""WITH {STEPS_CTE}
SELECT CAST(ceil(step / {LOG_EVERY}) AS BIGINT) AS interval, avg(value) AS mean_loss, CAST(max(step) AS BIGINT) AS last_step,
       CAST(max(ref_tok) AS BIGINT) AS ref_tokens, count(*) AS n_steps FROM st GROUP BY 1""")
def q_stream_log_metrics(spark, d):
    logdir = R.scratch(spark, "trainlog")
    train_log_lines(spark, d).select(F.col("line").alias("value")).write.text(logdir)
    lines = spark.readStream.format("text").load(logdir)
    return R.run_updates(R.stream_log_metrics(lines, LOG_EVERY), "interval")


@register("stream_leakage", f"WITH {LEAK_CTE} SELECT * FROM hits")
def q_stream_leakage(spark, d):
    probes = leakage.prepare_probes(table(spark, d, "benchmark"))
    out = R.scratch(spark, "leakage-hits")
    R.stream_leakage(doc_stream(spark, d), probes, out).awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


@register("stream_dedup_prefix", f"""WITH {CORPUS_CTE}
SELECT lang, count(DISTINCT md5(substring(coalesce(text, ''), 1, 300))) AS kept FROM corpus GROUP BY lang""")
def q_stream_dedup_prefix(spark, d):
    kept = R.run_to_files(R.stream_dedup_prefix(doc_stream(spark, d), 300).select("lang", "doc_id"))
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
