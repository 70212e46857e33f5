"""Registered budget / mixture / packing queries on the driver's documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MixConfig, PackConfig
from ..operators import budget, mixture, packing
from ..sources.corpus import documents_corpus
from .catalog import CORPUS_CTE, register
from .fixture import (FIXTURE_MAX_EPOCHS, FIXTURE_PREMIUM, FIXTURE_SEED, FIXTURE_SEQ_LEN,
                      FIXTURE_WEIGHTS)

W = budget.normalize(FIXTURE_WEIGHTS)


def plan_docs(spark: SparkSession, d: str) -> DataFrame:
    """Planner input without text, cached: the budget, the per-language
    statistics and the plan all read it (Spark matches the cached plan when
    the same query is built again)."""
    c = documents_corpus(spark, d)
    c = budget.with_ref_tokens(c, FIXTURE_PREMIUM)
    return c.select("lang", "doc_id", "category", F.col("num_tokens").alias("raw_tokens"),
                    "ref_tokens").persist()


def fixture_config(docs: DataFrame) -> MixConfig:
    """Budget = the whole corpus once (Σ available), at most 2 epochs."""
    avail = budget.available_ref_tokens(docs.withColumnRenamed("raw_tokens", "num_tokens"),
                                        FIXTURE_PREMIUM)
    total = avail.agg(F.sum("available")).collect()[0][0]
    return MixConfig(weights=W, budget_reference_tokens=int(total), max_epochs=FIXTURE_MAX_EPOCHS,
                     seed=FIXTURE_SEED, premium=dict(FIXTURE_PREMIUM))


def fixture_plan(spark: SparkSession, d: str) -> DataFrame:
    docs = plan_docs(spark, d)
    return mixture.mix_plan(docs, fixture_config(docs))


# --- SQL pieces --------------------------------------------------------------

def _values(m: dict, name: str) -> str:
    rows = ", ".join(f"('{k}', CAST('{v!r}' AS DOUBLE))" for k, v in m.items())
    return f"{name} AS (SELECT * FROM (VALUES {rows}) v(lang, x))"


def _plan_tail(key: str, max_epochs: int, seed: int) -> str:
    """The static-weight plan in SQL over ``docs``, ``wts(key, x)``,
    ``avail(key, available)`` and ``budget(cap)``: position = key_before / weight."""
    return f"""rep AS (SELECT d.*, e.epoch,
               md5(concat_ws('|', '{seed}', CAST(e.epoch AS VARCHAR), CAST(d.doc_id AS VARCHAR))) AS order_key
        FROM docs d CROSS JOIN (SELECT unnest(range(0, {max_epochs + 1})) AS epoch) e
        WHERE d.{key} IN (SELECT {key} FROM wts)),
lb AS (SELECT *, CAST(coalesce(sum(ref_tokens) OVER (PARTITION BY {key} ORDER BY epoch, order_key, doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lang_before FROM rep),
pos AS (SELECT lb.*, CAST(lb.lang_before AS DOUBLE) / w.x AS position FROM lb JOIN wts w USING ({key})),
g AS (SELECT *, CAST(coalesce(sum(ref_tokens) OVER (ORDER BY position, {key}, epoch, order_key
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS total_before,
             CAST(row_number() OVER (ORDER BY position, {key}, epoch, order_key) - 1 AS BIGINT) AS draw FROM pos),
capped AS (SELECT g.* FROM g, budget WHERE g.total_before < budget.cap),
breach AS (SELECT min(draw) AS fb FROM capped JOIN avail USING ({key})
           WHERE lang_before + ref_tokens > {max_epochs} * greatest(available, 1)),
plan AS (SELECT capped.* FROM capped, breach WHERE breach.fb IS NULL OR capped.draw <= breach.fb)"""


PLAN_CTE = f"""{CORPUS_CTE},
{_values(FIXTURE_PREMIUM, 'prem')},
{_values(W, 'wts')},
docs AS (SELECT c.lang, c.doc_id, c.category, c.num_tokens AS raw_tokens,
                CAST(floor(c.num_tokens / p.x) AS BIGINT) AS ref_tokens
         FROM corpus c JOIN prem p USING (lang)),
avail AS (SELECT d.lang, CAST(floor(sum(d.raw_tokens) / p.x) AS BIGINT) AS available
          FROM docs d JOIN prem p USING (lang) GROUP BY d.lang, p.x),
budget AS (SELECT sum(available) * {FIXTURE_MAX_EPOCHS} AS cap FROM avail),
{_plan_tail("lang", FIXTURE_MAX_EPOCHS, FIXTURE_SEED)}"""

PLAN_COLS = ["lang", "doc_id", "epoch", "order_key", "ref_tokens", "lang_before", "position",
             "total_before", "draw"]


@register("available_ref_tokens", f"""WITH {PLAN_CTE}
SELECT d.lang, CAST(sum(d.raw_tokens) AS BIGINT) AS raw_tokens,
       CAST(floor(sum(d.raw_tokens) / p.x) AS BIGINT) AS available
FROM docs d JOIN prem p USING (lang) GROUP BY d.lang, p.x""")
def q_available(spark, d):
    c = documents_corpus(spark, d)
    return budget.available_ref_tokens(c, FIXTURE_PREMIUM)


@register("mix_plan", f"""WITH {PLAN_CTE}
SELECT {', '.join(PLAN_COLS)} FROM plan""")
def q_mix_plan(spark, d):
    return fixture_plan(spark, d).select(*PLAN_COLS)


@register("consumption_summary", f"""WITH {PLAN_CTE},
c AS (SELECT lang, CAST(sum(ref_tokens) AS BIGINT) AS consumed, count(*) AS docs FROM plan GROUP BY lang)
SELECT a.lang, a.available, coalesce(c.consumed, 0) AS consumed, coalesce(c.docs, 0) AS docs,
       CAST(coalesce(c.consumed, 0) AS DOUBLE) / greatest(a.available, 1) AS epochs
FROM avail a LEFT JOIN c USING (lang)""")
def q_consumption(spark, d):
    docs = plan_docs(spark, d)
    cfg = fixture_config(docs)
    plan = mixture.mix_plan(docs, cfg)
    avail = budget.available_ref_tokens(docs.withColumnRenamed("raw_tokens", "num_tokens"), FIXTURE_PREMIUM)
    return budget.consumption_summary(plan, avail)


@register("share_report", f"""WITH {PLAN_CTE},
c AS (SELECT lang, CAST(sum(ref_tokens) AS BIGINT) AS tokens, count(*) AS docs FROM plan GROUP BY lang)
SELECT c.lang, c.tokens, c.docs, CAST(c.tokens AS DOUBLE) / sum(c.tokens) OVER () AS token_share,
       CAST(c.docs AS DOUBLE) / sum(c.docs) OVER () AS doc_share, w.x AS target_share,
       w.x * (CAST(c.tokens AS DOUBLE) / c.docs) / sum(w.x * (CAST(c.tokens AS DOUBLE) / c.docs)) OVER () AS uniform_token_share
FROM c JOIN wts w USING (lang)""")
def q_share_report(spark, d):
    return mixture.share_report(fixture_plan(spark, d), W)


@register("running_consumption", f"""WITH {PLAN_CTE}
SELECT lang, doc_id, epoch, draw,
       CAST(lang_before + ref_tokens AS BIGINT) AS lang_total,
       CAST(total_before + ref_tokens AS BIGINT) AS total,
       CAST(total_before + ref_tokens AS DOUBLE) / (SELECT cap FROM budget) AS frac_done,
       CAST(lang_before + ref_tokens AS DOUBLE) / greatest(a.available, 1) AS epochs_seen
FROM plan JOIN avail a USING (lang)""")
def q_running_consumption(spark, d):
    docs = plan_docs(spark, d)
    cfg = fixture_config(docs)
    # recompute the sums from the draw order alone (generic W01 path)
    plan = mixture.mix_plan(docs, cfg).drop("lang_before", "total_before")
    avail = {r.lang: r.available for r in budget.available_ref_tokens(
        docs.withColumnRenamed("raw_tokens", "num_tokens"), FIXTURE_PREMIUM).collect()}
    rc = budget.running_consumption(plan, cfg.total_token_budget)
    rc = budget.epochs_timeline(rc.withColumn("ref_tokens_lang_total", F.col("lang_total")), avail)
    return rc.select("lang", "doc_id", "epoch", "draw", "lang_total", "total", "frac_done", "epochs_seen")


MILESTONES = [10_000, 50_000, 100_000, 200_000, 300_000, 400_000, 500_000, 1_000_000]


@register("milestone_crossings", f"""WITH {PLAN_CTE},
m AS (SELECT unnest([{', '.join(map(str, MILESTONES))}]) AS milestone),
j AS (SELECT m.milestone, 'chck_' || CAST(greatest(ceil(m.milestone / 1000000), 1) AS BIGINT) || 'M' AS name,
             plan.draw, CAST(plan.total_before + plan.ref_tokens AS BIGINT) AS ref_tokens_at_save
      FROM plan JOIN m ON plan.total_before < m.milestone AND plan.total_before + plan.ref_tokens >= m.milestone)
SELECT *, count(*) OVER (PARTITION BY name) > 1 AS name_collision FROM j""")
def q_milestones(spark, d):
    return packing.milestone_crossings(fixture_plan(spark, d), MILESTONES)


_PC = PackConfig(seq_len=FIXTURE_SEQ_LEN, micro_batch_size=8, grad_accum_steps=2, world_size=4)


def fixture_pieces(spark, d):
    docs = plan_docs(spark, d)
    plan = mixture.mix_plan(docs, fixture_config(docs))
    # the whitespace tokens stand in for encoded ids (same count)
    return packing.pack_pieces(plan.withColumn("n_tokens", F.col("raw_tokens")), FIXTURE_SEQ_LEN,
                               length="n_tokens")


PIECES_CTE = f"""{PLAN_CTE},
pl AS (SELECT plan.*, docs.raw_tokens AS n_tokens FROM plan JOIN docs USING (lang, doc_id) WHERE docs.raw_tokens > 0),
off AS (SELECT *, CAST(coalesce(sum(n_tokens + 1) OVER (ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS token_offset FROM pl),
tot AS (SELECT max(token_offset + n_tokens + 1) AS t FROM off),
ex AS (SELECT off.*, s.seq_id FROM off, LATERAL (SELECT unnest(range(CAST(floor(token_offset / {FIXTURE_SEQ_LEN}) AS BIGINT),
          CAST(floor((token_offset + n_tokens) / {FIXTURE_SEQ_LEN}) AS BIGINT) + 1)) AS seq_id) s),
pieces AS (SELECT ex.*, greatest(seq_id * {FIXTURE_SEQ_LEN} - token_offset, 0) AS piece_start,
                 least((seq_id + 1) * {FIXTURE_SEQ_LEN} - token_offset, n_tokens + 1) - greatest(seq_id * {FIXTURE_SEQ_LEN} - token_offset, 0) AS piece_len,
                 greatest(token_offset - seq_id * {FIXTURE_SEQ_LEN}, 0) AS seq_pos
           FROM ex, tot WHERE seq_id < floor(tot.t / {FIXTURE_SEQ_LEN}))"""


@register("pack_pieces", f"""WITH {PIECES_CTE}
SELECT CAST(seq_id AS BIGINT) AS seq_id, draw, doc_id, lang, CAST(piece_start AS BIGINT) AS piece_start,
       CAST(piece_len AS BIGINT) AS piece_len, CAST(seq_pos AS BIGINT) AS seq_pos FROM pieces""")
def q_pack_pieces(spark, d):
    return fixture_pieces(spark, d).select("seq_id", "draw", "doc_id", "lang", "piece_start", "piece_len", "seq_pos")


@register("pack_stats", f"""WITH {PIECES_CTE},
ps AS (SELECT CAST(seq_id AS BIGINT) AS seq_id, count(*) AS n_docs, CAST(max(piece_len) AS BIGINT) AS max_piece,
             CAST(sum(piece_len) AS BIGINT) AS n_tokens FROM pieces GROUP BY seq_id)
SELECT *, max_piece / {float(FIXTURE_SEQ_LEN)} AS max_piece_share, max_piece * 2 > {FIXTURE_SEQ_LEN} AS dominated FROM ps""")
def q_pack_stats(spark, d):
    return packing.pack_stats(fixture_pieces(spark, d), FIXTURE_SEQ_LEN)


@register("assign_steps", f"""WITH {PIECES_CTE},
s AS (SELECT DISTINCT CAST(seq_id AS BIGINT) AS seq_id FROM pieces)
SELECT seq_id, CAST(floor(seq_id / 8) AS BIGINT) AS micro_batch, CAST(floor(seq_id / 8) % 4 AS INTEGER) AS rank,
       CAST(floor(floor(seq_id / 8) / 4) % 2 AS INTEGER) AS accum_slot, CAST(floor(seq_id / 64) AS BIGINT) + 1 AS step
FROM s""")
def q_assign_steps(spark, d):
    seqs = fixture_pieces(spark, d).select("seq_id").distinct()
    return packing.assign_steps(seqs, _PC)


@register("budget_cut", f"""WITH {PLAN_CTE}
SELECT lang, doc_id, epoch, draw, total_before FROM g WHERE total_before < (SELECT cap FROM budget) // 4""")
def q_budget_cut(spark, d):
    """L04 alone: the uncapped global sequence cut at a quarter of the budget."""
    docs = plan_docs(spark, d)
    cfg = fixture_config(docs)
    big = MixConfig(weights=cfg.weights, budget_reference_tokens=cfg.budget_reference_tokens * 100,
                    max_epochs=cfg.max_epochs, seed=cfg.seed, premium=cfg.premium)
    # an unreachable cap keeps the whole replicated sequence (all epochs)
    plan = mixture.mix_plan(docs, big, available={k: 10 ** 15 for k in FIXTURE_PREMIUM})
    return budget.budget_cut(plan, cfg.total_token_budget // 4).select("lang", "doc_id", "epoch", "draw", "total_before")


@register("step_estimate", f"""WITH {PIECES_CTE},
f AS (SELECT CAST(sum(raw_tokens) AS DOUBLE) / sum(ref_tokens) AS fertility FROM plan)
SELECT CAST(greatest(1, floor((SELECT cap FROM budget) / {128 * 8 * 2 * 4})) AS BIGINT) AS naive_steps,
       f.fertility,
       CAST(greatest(1, floor(floor((SELECT cap FROM budget) * f.fertility) / {128 * 8 * 2 * 4})) AS BIGINT) AS corrected_steps,
       CAST((SELECT max(floor(seq_id / 64)) + 1 FROM pieces) AS BIGINT) AS packed_steps
FROM f""")
def q_step_estimate(spark, d):
    """Naive step estimate, the fertility-corrected one (A22 with the
    whitespace encoder) and the steps the packed plan really fills."""
    docs = plan_docs(spark, d)
    cfg = fixture_config(docs)
    plan = mixture.mix_plan(docs, cfg)
    fert = plan.agg((F.sum("raw_tokens").cast("double") / F.sum("ref_tokens")).alias("f")).collect()[0].f
    pieces = packing.pack_pieces(plan.withColumn("n_tokens", F.col("raw_tokens")), FIXTURE_SEQ_LEN, length="n_tokens")
    steps = packing.assign_steps(pieces.select("seq_id").distinct(), _PC)
    naive = packing.estimate_steps(cfg.budget_reference_tokens, cfg.max_epochs, _PC)
    corrected = packing.estimate_steps(cfg.budget_reference_tokens, cfg.max_epochs, _PC, fertility=fert)
    return steps.agg(F.max("step").alias("packed_steps")).select(
        F.lit(naive).cast("long").alias("naive_steps"), F.lit(fert).alias("fertility"),
        F.lit(corrected).cast("long").alias("corrected_steps"), "packed_steps")


@register("cap_steps", f"""WITH {PIECES_CTE}
SELECT DISTINCT CAST(seq_id AS BIGINT) AS seq_id FROM pieces WHERE seq_id < 10 * 64""")
def q_cap_steps(spark, d):
    """The sequences of the first 10 optimizer steps."""
    seqs = fixture_pieces(spark, d).select("seq_id").distinct()
    return packing.cap_steps(seqs, 10, _PC)


@register("ref_token_share", f"""WITH {PLAN_CTE},
t AS (SELECT d.lang, c.category AS data_source, CAST(sum(d.ref_tokens) AS BIGINT) AS tokens
      FROM docs d JOIN corpus c USING (lang, doc_id) GROUP BY ALL)
SELECT lang, data_source, tokens,
       round(CAST(tokens AS DOUBLE) / CAST(sum(tokens) OVER (PARTITION BY lang) AS DOUBLE), 4) AS token_share
FROM t""")
def q_ref_token_share(spark, d):
    """Flagship (slice 0): byte-premium-adjusted reference tokens (P05) and
    their share by source within each language (A01 + A03)."""
    from ..operators import audit
    c = budget.with_ref_tokens(documents_corpus(spark, d), FIXTURE_PREMIUM)
    return audit.token_share(c.withColumn("num_tokens", F.col("ref_tokens")), dim="data_source")
