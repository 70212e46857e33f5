"""Registered queries for the remaining budget / mixture / packing operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..config import MixConfig
from ..functions.columns import WS_RUN, canonical_task, model_key, task_lang_strict
from ..operators import budget, mixture, packing
from ..sinks import writers as K
from ..sources.corpus import at_rest, documents_corpus
from ..streaming.jobs import scratch
from .catalog import CORPUS_CTE, register
from .fixture import FIXTURE_PREMIUM, FIXTURE_SEED, FIXTURE_SEQ_LEN
from .q_eval import EVAL_CTE, curve
from .q_plan import PIECES_CTE, PLAN_CTE, fixture_config, fixture_pieces, plan_docs

WL = {"en": [f"src{i}" for i in range(5)], "de": [], "es": None}
EPOCHS = {"en": 1, "de": 2, "es": 3, "fr": 2}
SCHEDULE = ((0.0, {"en": 1.0}), (0.5, {"en": 0.6, "de": 0.4}), (0.9, {"en": 0.34, "de": 0.33, "fr": 0.33}))
CELLS = {"all": {}, "en_head": {"en": [f"src{i}" for i in range(10)]},
         "no_de": {"de": []}}


def _in(cats):
    return ", ".join(f"'{c}'" for c in cats)


@register("filter_categories", f"""WITH {CORPUS_CTE}
SELECT lang, doc_id, category FROM corpus
WHERE lang NOT IN ('en', 'de') OR (lang = 'en' AND category IN ({_in(WL['en'])}))""")
def q_filter_categories(spark, d):
    return budget.filter_categories(documents_corpus(spark, d), WL).select("lang", "doc_id", "category")


@register("unknown_categories", f"""WITH {CORPUS_CTE},
wl AS (SELECT * FROM (VALUES ('en', 'src1'), ('en', 'child-wiki'), ('fr', 'src3'), ('fr', 'padding')) v(lang, category))
SELECT wl.* FROM wl ANTI JOIN (SELECT DISTINCT lang, category FROM corpus) k USING (lang, category)""")
def q_unknown_categories(spark, d):
    wl = {"en": ["src1", "child-wiki"], "fr": ["src3", "padding"]}
    return budget.unknown_categories(documents_corpus(spark, d), wl)


@register("replicate_epochs", f"""WITH {CORPUS_CTE},
n AS (SELECT * FROM (VALUES ('en', 1), ('de', 2), ('es', 3), ('fr', 2)) v(lang, n))
SELECT c.lang, c.doc_id, CAST(e.epoch AS INTEGER) AS epoch,
       md5(concat_ws('|', '{FIXTURE_SEED}', CAST(e.epoch AS VARCHAR), CAST(c.doc_id AS VARCHAR))) AS order_key
FROM corpus c JOIN n USING (lang), LATERAL (SELECT unnest(range(0, n.n)) AS epoch) e""")
def q_replicate_epochs(spark, d):
    r = budget.replicate_epochs(documents_corpus(spark, d).select("lang", "doc_id"), EPOCHS)
    return budget.epoch_order(r, FIXTURE_SEED).select("lang", "doc_id", "epoch", "order_key")


def _stage_sql() -> str:
    pts = budget.validate_schedule(SCHEDULE)
    rows = []
    for i, (f, w) in enumerate(pts):
        lo = "'-inf'" if i == 0 else f"'{f!r}'"
        hi = f"'{pts[i + 1][0]!r}'" if i + 1 < len(pts) else "'inf'"
        rows += [f"({i}, CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE), '{k}', CAST('{v!r}' AS DOUBLE))"
                 for k, v in w.items()]
    return f"stages AS (SELECT * FROM (VALUES {', '.join(rows)}) v(stage, frac_lo, frac_hi, lang, weight))"


@register("weights_at", f"""WITH {PLAN_CTE}, {_stage_sql()},
f AS (SELECT draw, CAST(total_before + ref_tokens AS DOUBLE) / (SELECT cap FROM budget) AS frac_done FROM plan)
SELECT f.draw, f.frac_done, s.stage, s.lang, s.weight FROM f JOIN stages s
ON f.frac_done >= s.frac_lo AND f.frac_done < s.frac_hi""")
def q_weights_at(spark, d):
    docs = plan_docs(spark, d)
    cfg = fixture_config(docs)
    plan = mixture.mix_plan(docs, cfg)
    fr = plan.select("draw", ((F.col("total_before") + F.col("ref_tokens"))
                              / F.lit(float(cfg.total_token_budget))).alias("frac_done"))
    return budget.weights_at(fr, budget.stage_table(spark, SCHEDULE))


def _curriculum_sql() -> str:
    from .q_plan import PLAN_CTE
    unit, _ = mixture.fluid_segments(budget.validate_schedule(SCHEDULE), 1.0)
    rows = ", ".join(
        f"('{x.key}', CAST('{x.c_lo!r}' AS DOUBLE), CAST('{x.c_hi!r}' AS DOUBLE), CAST('{x.t_lo!r}' AS DOUBLE), "
        f"CAST('{x.rate!r}' AS DOUBLE))" for x in mixture._merge(unit))
    # the static plan's CTEs, with positions from the scaled unit segments
    base = PLAN_CTE.split("rep AS (")[0]
    tail = "rep AS (" + PLAN_CTE.split("rep AS (")[1]
    tail = tail.replace("WHERE d.lang IN (SELECT lang FROM wts)", "WHERE d.lang IN (SELECT lang FROM seg)")
    tail = tail.replace(
        "pos AS (SELECT lb.*, CAST(lb.lang_before AS DOUBLE) / w.x AS position FROM lb JOIN wts w USING (lang)),",
        "pos AS (SELECT lb.*, s.t_lo * (SELECT cap FROM budget) + (lb.lang_before - s.c_lo * (SELECT cap FROM budget)) / s.rate"
        " AS position FROM lb JOIN seg s ON lb.lang = s.lang AND lb.lang_before >= s.c_lo * (SELECT cap FROM budget)"
        " AND lb.lang_before < s.c_hi * (SELECT cap FROM budget)),")
    return (f"WITH {base}seg AS (SELECT * FROM (VALUES {rows}) v(lang, c_lo, c_hi, t_lo, rate)),\n{tail}\n"
            "SELECT lang, doc_id, epoch, ref_tokens, lang_before, position, total_before, draw FROM plan")


@register("mix_plan_curriculum", _curriculum_sql())
def q_mix_plan_curriculum(spark, d):
    """M02 + M04 with a three-stage schedule: unit water-fill segments scaled
    by the budget (also checked against a sequential greedy in the tests)."""
    docs = plan_docs(spark, d)
    base = fixture_config(docs)
    cfg = MixConfig(schedule=SCHEDULE, budget_reference_tokens=base.budget_reference_tokens,
                    max_epochs=base.max_epochs, seed=base.seed, premium=base.premium)
    return mixture.mix_plan(docs, cfg).select("lang", "doc_id", "epoch", "ref_tokens", "lang_before",
                                               "position", "total_before", "draw")


def _category_plan_sql() -> str:
    from .q_plan import _plan_tail
    return f"""WITH {CORPUS_CTE},
prem AS (SELECT * FROM (VALUES {', '.join(f"('{k}', CAST('{v!r}' AS DOUBLE))" for k, v in FIXTURE_PREMIUM.items())}) v(lang, x)),
docs AS (SELECT c.lang, c.doc_id, c.category, c.num_tokens AS raw_tokens,
                CAST(floor(c.num_tokens / p.x) AS BIGINT) AS ref_tokens FROM corpus c JOIN prem p USING (lang)),
cats AS (SELECT DISTINCT category FROM docs),
wts AS (SELECT category, CAST(1.0 AS DOUBLE) / CAST((SELECT count(*) FROM cats) AS DOUBLE) AS x FROM cats),
avail AS (SELECT category, CAST(sum(ref_tokens) AS BIGINT) AS available FROM docs GROUP BY category),
budget AS (SELECT (sum(ref_tokens) // 2) * 2 AS cap FROM docs),
{_plan_tail("category", 2, FIXTURE_SEED)}
SELECT category, doc_id, epoch, ref_tokens, lang_before, total_before, draw FROM plan"""


@register("mix_by_category", _category_plan_sql())
def q_mix_by_category(spark, d):
    """The same planner keyed by category - every source of the corpus
    reweighted to an equal token share, budget = half the corpus, 2 epochs."""
    docs = plan_docs(spark, d)
    cats = sorted(r.category for r in docs.select("category").distinct().collect())  # bounded: categories
    total = docs.agg(F.sum("ref_tokens")).collect()[0][0]
    cfg = MixConfig(weights={c: 1.0 / len(cats) for c in cats}, budget_reference_tokens=int(total) // 2,
                    max_epochs=2, seed=FIXTURE_SEED, premium={})
    return mixture.mix_plan(docs, cfg, key="category").select(
        "category", "doc_id", "epoch", "ref_tokens", "lang_before", "total_before", "draw")


@register("cell_grid", f"""WITH {CORPUS_CTE},
cells AS (
  SELECT 'all' AS cell, lang, num_tokens FROM corpus
  UNION ALL SELECT 'en_head', lang, num_tokens FROM corpus WHERE lang <> 'en' OR category IN ({_in(CELLS['en_head']['en'])})
  UNION ALL SELECT 'no_de', lang, num_tokens FROM corpus WHERE lang <> 'de'),
p AS (SELECT * FROM (VALUES {', '.join(f"('{k}', CAST('{v!r}' AS DOUBLE))" for k, v in FIXTURE_PREMIUM.items())}) v(lang, x)),
a AS (SELECT cell, lang, CAST(sum(num_tokens) AS BIGINT) AS raw_tokens FROM cells GROUP BY ALL)
SELECT a.cell, a.lang, a.raw_tokens, CAST(floor(a.raw_tokens / p.x) AS BIGINT) AS available,
       CAST(100000 AS DOUBLE) / greatest(CAST(floor(a.raw_tokens / p.x) AS BIGINT), 1) AS epochs_for_budget
FROM a JOIN p USING (lang)""")
def q_cell_grid(spark, d):
    docs = documents_corpus(spark, d).withColumnRenamed("num_tokens", "raw_tokens")
    return mixture.cell_grid(docs, CELLS, FIXTURE_PREMIUM, 100_000)


@register("packed_sequences", f"""WITH {PIECES_CTE},
ids AS (SELECT lang, doc_id, list_append(list_transform(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+'),
               lambda w: ('0x' || substr(md5(w), 1, 6))::INT % 50000 + 4), 2) AS ids FROM corpus),
q AS (SELECT seq_id, seq_pos, ids[piece_start + 1:piece_start + piece_len] AS part FROM pieces JOIN ids USING (lang, doc_id))
SELECT CAST(seq_id AS BIGINT) AS seq_id, CAST(sum(len(part)) AS INTEGER) AS n_ids,
       md5(string_agg(array_to_string(part, ','), ',' ORDER BY seq_pos)) AS ids_md5 FROM q GROUP BY seq_id""")
def q_packed_sequences(spark, d):
    """T07 ids + K04: whitespace words hashed into a 50,000-id space stand in
    for a learned vocabulary; sequences are assembled, written and read back."""
    docs = documents_corpus(spark, d)
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), WS_RUN), lambda x: x != "")
    number = lambda w: F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int") % 50_000 + 4
    ids = docs.select("lang", "doc_id", F.transform(words, number).alias("ids"))
    pieces = fixture_pieces(spark, d).join(ids, ["lang", "doc_id"])
    seqs = packing.pack_sequences(pieces)
    out = scratch(spark, "sequences")
    K.write_sequences(seqs, out)
    return spark.read.parquet(out).select("seq_id", F.size("input_ids").alias("n_ids"),
                                          F.md5(F.array_join(F.col("input_ids").cast("array<string>"), ",")).alias("ids_md5"))


@register("shuffled_corpus", f"""WITH {CORPUS_CTE}
SELECT lang, doc_id, md5(concat_ws('|', '{FIXTURE_SEED}', '0', CAST(doc_id AS VARCHAR))) AS order_key,
       row_number() OVER (ORDER BY md5(concat_ws('|', '{FIXTURE_SEED}', '0', CAST(doc_id AS VARCHAR)))) - 1 AS position FROM corpus""")
def q_shuffled_corpus(spark, d):
    out = scratch(spark, "shuffled-corpus")
    K.write_shuffled(documents_corpus(spark, d).select("lang", "doc_id", "text"), out, FIXTURE_SEED)
    return at_rest(spark, out).select("lang", "doc_id", "order_key", "position")


ALIASES = {"click_eng": "click", "click_nld": "click", "click_zho": "click"}
STRICT = {"zeroshot_eng": "eng", "zeroshot_nld": "nld", "zeroshot_zho": "zho"}


@register("task_names", f"""WITH {EVAL_CTE},
t AS (SELECT DISTINCT model_key, task FROM curve)
SELECT model_key, replace(replace(model_key, '__', '/'), '/', '__') AS model_key_roundtrip, task,
       coalesce(CASE task {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items())} END, task) AS canonical,
       CASE task {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in STRICT.items())} END AS strict_lang FROM t""")
def q_task_names(spark, d):
    """P12 canonical names, P08 strict mode, P13 model key round trip."""
    t = curve(spark, d).select("model_key", "task").distinct()
    return t.select("model_key", model_key(F.replace("model_key", F.lit("__"), F.lit("/"))).alias("model_key_roundtrip"),
                    "task", canonical_task("task", ALIASES).alias("canonical"),
                    task_lang_strict("task", STRICT).alias("strict_lang"))


@register("budget_epochs_timeline", f"""WITH {PLAN_CTE}
SELECT lang, doc_id, epoch, draw, CAST(lang_before + ref_tokens AS DOUBLE) / greatest(a.available, 1) AS epochs_seen
FROM plan JOIN avail a USING (lang)""")
def q_budget_epochs_timeline(spark, d):
    """W06 on the mix plan: epochs seen per language at every draw."""
    docs = plan_docs(spark, d)
    plan = mixture.mix_plan(docs, fixture_config(docs))
    avail = {r.lang: r.available for r in budget.available_ref_tokens(
        docs.withColumnRenamed("raw_tokens", "num_tokens"), FIXTURE_PREMIUM).collect()}
    t = plan.withColumn("ref_tokens_lang_total", F.col("lang_before") + F.col("ref_tokens"))
    return budget.epochs_timeline(t, avail).select("lang", "doc_id", "epoch", "draw", "epochs_seen")

