"""Registered evaluation-analytics queries.

The driver's tables hold no harness output, so an evaluation view is derived
from ``events``: each event is one scored item of a model checkpoint —
model = ``org__model-<user_id div 50>``, revision = ``chck_<10 x day>M``,
result file = ``results_<hour div 12>.json``, language from ``props.k``,
task = ``<event_type>_<lang>``, paradigm = task + ``_p<k div 34>``, correct
when ``value < 50``. Spark then writes harness-shaped JSON and log text from
these items and the queries parse them back, so every parser runs over data
that grows with ``events``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scores as S
from ..sources import evals as E
from ..session import spread
from ..sources.corpus import table
from .catalog import register

LANG3 = ("eng", "nld", "zho")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
# Expected leaderboard tasks per language (a parameter grid); 'bonus_eng' never
# occurs, so it exercises the missing-task rules.
EXPECTED = {lg: [f"{t}_{lg}" for t in EVENT_TYPES] for lg in LANG3}
EXPECTED["eng"] = EXPECTED["eng"] + ["bonus_eng"]
BASE_MODEL = "org__model-0"


# ---------------------------------------------------------------------------
# Derived evaluation items (Spark) and the same in SQL
# ---------------------------------------------------------------------------

def eval_items(spark: SparkSession, d: str) -> DataFrame:
    e = spread(table(spark, d, "events"), "event_id")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    lang = F.element_at(F.array(*[F.lit(x) for x in LANG3]), (k % 3) + 1)
    return e.select(
        F.concat(F.lit("org__model-"), F.floor(F.col("user_id") / 50).cast("string")).alias("model_key"),
        F.concat(F.lit("chck_"), (F.dayofmonth("ts") * 10).cast("string"), F.lit("M")).alias("revision"),
        F.concat(F.lit("results_"), F.floor(F.hour("ts") / 12).cast("string"), F.lit(".json")).alias("file"),
        lang.alias("lang"), F.concat("event_type", F.lit("_"), lang).alias("task"),
        F.concat("event_type", F.lit("_"), lang, F.lit("_p"), F.floor(k / 34).cast("string")).alias("paradigm"),
        F.when(F.col("value") < 50, 1).otherwise(0).alias("correct"), "event_type", "ts", "value")


ITEMS_CTE = r"""items AS (
  SELECT 'org__model-' || CAST(floor(user_id / 50) AS BIGINT) AS model_key,
         'chck_' || CAST(day(ts) * 10 AS BIGINT) || 'M' AS revision,
         'results_' || CAST(floor(hour(ts) / 12) AS BIGINT) || '.json' AS file,
         list_element(['eng', 'nld', 'zho'], coalesce(CAST(json_extract(props, '$.k') AS INTEGER), 0) % 3 + 1) AS lang,
         coalesce(CAST(json_extract(props, '$.k') AS INTEGER), 0) AS k,
         event_type, ts, value, CASE WHEN value < 50 THEN 1 ELSE 0 END AS correct
  FROM events),
it AS (SELECT *, event_type || '_' || lang AS task,
              event_type || '_' || lang || '_p' || CAST(floor(k / 34) AS BIGINT) AS paradigm FROM items)"""


def score_rows(items: DataFrame, by: tuple[str, ...] = ("model_key", "revision", "file")) -> DataFrame:
    """Group (depth 0), subtask (depth 1) and paradigm (depth 2) rows in one
    pass: each item is exploded into its three levels, then one aggregation."""
    levels = F.array(
        F.struct(F.concat(F.lit("zeroshot_"), F.col("lang")).alias("task"),
                 F.concat(F.lit("zeroshot_"), F.col("lang")).alias("alias")),
        F.struct(F.col("task").alias("task"), F.concat(F.lit(" - "), F.col("task")).alias("alias")),
        F.struct(F.col("paradigm").alias("task"), F.concat(F.lit("  - "), F.col("paradigm")).alias("alias")))
    x = items.select(*by, "correct", F.explode(levels).alias("lv"))
    a = x.groupBy(*by, F.col("lv.task").alias("task"), F.col("lv.alias").alias("alias")).agg(
        F.avg("correct").alias("acc"), F.count(F.lit(1)).alias("n"))
    se = F.when(F.col("n") > 1, F.sqrt(F.col("acc") * (1 - F.col("acc")) / (F.col("n") - 1)))
    return a.select(*by, "task", "alias", "acc", se.alias("stderr"), "n")


def _se_sql(acc: str = "avg(correct)", n: str = "count(*)") -> str:
    return f"CASE WHEN {n} > 1 THEN sqrt({acc} * (1 - {acc}) / ({n} - 1)) END"


def _rows_sql(by: str) -> str:
    return f"""rows AS (
  SELECT {by}, 'zeroshot_' || lang AS task, 'zeroshot_' || lang AS alias, avg(correct) AS acc, {_se_sql()} AS stderr, count(*) AS n
  FROM it GROUP BY {by}, lang
  UNION ALL
  SELECT {by}, task, ' - ' || task AS alias, avg(correct), {_se_sql()}, count(*) FROM it GROUP BY {by}, task
  UNION ALL
  SELECT {by}, paradigm, '  - ' || paradigm, avg(correct), {_se_sql()}, count(*) FROM it GROUP BY {by}, paradigm)"""


def harness_json(rows: DataFrame, by: tuple[str, ...] = ("model_key", "revision", "file")) -> DataFrame:
    """K-style writer of harness result documents (one per model/revision/file;
    a document holds at most groups + tasks + paradigms entries)."""
    entry = F.struct("task", F.struct("alias", F.col("acc").alias("acc,none"),
                                      F.col("stderr").alias("acc_stderr,none")))
    return rows.groupBy(*by).agg(F.to_json(F.struct(
        F.map_from_entries(F.collect_list(entry)).alias("results"))).alias("json"))


def parsed_results(spark, d):
    js = harness_json(score_rows(eval_items(spark, d)))
    return E.parse_results(js, keep=("model_key", "revision", "file"))


def merged(spark, d):
    return E.merge_latest(parsed_results(spark, d))


def curve(spark, d):
    return S.keep_top_tasks(merged(spark, d))


EVAL_CTE = f"""{ITEMS_CTE},
{_rows_sql('model_key, revision, file')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY model_key, revision, task ORDER BY file DESC) AS rn FROM rows),
merged AS (SELECT model_key, revision, task, alias, acc, stderr, file FROM ranked WHERE rn = 1),
curve AS (
  SELECT model_key, revision,
         CASE WHEN regexp_matches(revision, '^chck_\\d+M$') THEN CAST(regexp_extract(revision, '^chck_(\\d+)M$', 1) AS INTEGER) ELSE -1 END AS rev_m,
         ltrim(task) AS task,
         CASE WHEN task LIKE '%eng%' THEN 'eng' WHEN task LIKE '%nld%' THEN 'nld' WHEN task LIKE '%zho%' THEN 'zho' END AS lang,
         CAST(length(alias) - length(ltrim(alias)) AS INTEGER) AS indent,
         length(alias) - length(ltrim(alias)) = 0 AS is_group,
         round_even(acc, 4) AS acc, round_even(coalesce(stderr, 0.0), 4) AS stderr
  FROM merged WHERE acc IS NOT NULL AND length(alias) - length(ltrim(alias)) <= 1)"""


# ---------------------------------------------------------------------------
# S04 / S05 / P07-P14 / L01 / A18
# ---------------------------------------------------------------------------

@register("eval_results", f"""WITH {ITEMS_CTE}, {_rows_sql('model_key, revision, file')}
SELECT model_key, revision, file, task, alias, acc, stderr FROM rows""")
def q_eval_results(spark, d):
    return parsed_results(spark, d)


@register("merge_latest", f"WITH {EVAL_CTE} SELECT * FROM merged")
def q_merge_latest(spark, d):
    return merged(spark, d)


@register("revision_curve_rows", f"WITH {EVAL_CTE} SELECT * FROM curve")
def q_curve(spark, d):
    return S.order_curve(curve(spark, d))


@register("revision_pivot", f"""WITH {EVAL_CTE}
SELECT model_key, revision, rev_m,
       coalesce(first(acc) FILTER (WHERE lang = 'eng'), 0.0) AS eng,
       coalesce(first(acc) FILTER (WHERE lang = 'nld'), 0.0) AS nld,
       coalesce(first(acc) FILTER (WHERE lang = 'zho'), 0.0) AS zho
FROM curve WHERE is_group GROUP BY model_key, revision, rev_m""")
def q_revision_pivot(spark, d):
    return S.revision_curve(curve(spark, d), LANG3)


# ---------------------------------------------------------------------------
# A14-A17, W07-W09, J05, J06, U02
# ---------------------------------------------------------------------------

@register("group_accuracy", f"""WITH {ITEMS_CTE},
sub AS (SELECT model_key, revision, 'zeroshot_' || lang AS "group", task, avg(correct) AS acc, count(*) AS n,
               sum(correct) AS k FROM it GROUP BY ALL)
SELECT model_key, revision, "group", CAST(sum(k) AS DOUBLE) / sum(n) AS weighted_acc, avg(acc) AS simple_mean,
       CAST(sum(n) AS BIGINT) AS n FROM sub GROUP BY ALL""")
def q_group_accuracy(spark, d):
    it = eval_items(spark, d)
    sub = it.groupBy("model_key", "revision", "lang", "task").agg(
        F.avg("correct").alias("acc"), F.count(F.lit(1)).alias("n"), F.sum("correct").alias("k"))
    sub = sub.withColumn("group", F.concat(F.lit("zeroshot_"), F.col("lang")))
    return S.group_accuracy(sub, correct="k")


@register("zero_shot_average", f"""WITH {EVAL_CTE}
SELECT model_key, revision, avg(acc) AS zeroshot_avg, count(*) AS n_groups
FROM merged WHERE starts_with(ltrim(task), 'zeroshot_') AND length(alias) - length(ltrim(alias)) <= 1
  AND acc IS NOT NULL GROUP BY ALL""")
def q_zero_shot_average(spark, d):
    """A15 on the unrounded group scores (as the evaluation logger does)."""
    return S.zero_shot_average(S.keep_top_tasks(merged(spark, d), digits=None))


def _expected_sql() -> str:
    rows = ", ".join(f"('{lg}', '{t}')" for lg, ts in EXPECTED.items() for t in ts)
    return f"expected AS (SELECT * FROM (VALUES {rows}) v(lang, task))"


LANG_AVG_CTE = f"""{EVAL_CTE}, {_expected_sql()},
keys AS (SELECT DISTINCT model_key, revision FROM curve),
grid AS (SELECT k.model_key, k.revision, e.lang, e.task FROM keys k CROSS JOIN expected e),
la AS (SELECT g.model_key, g.revision, g.lang, avg(coalesce(c.acc, 0.0)) AS lang_avg,
              count(c.acc) AS n_present, count(*) AS n_expected
       FROM grid g LEFT JOIN curve c USING (model_key, revision, lang, task) GROUP BY ALL),
ma AS (SELECT model_key, revision, sum(lang_avg) / 3.0 AS multilingual_avg, count(*) AS n_langs FROM la GROUP BY ALL)"""


def _lang_avgs(spark, d):
    return S.language_average(curve(spark, d), EXPECTED, by=("model_key", "revision"))


@register("language_average", f"WITH {LANG_AVG_CTE} SELECT * FROM la")
def q_language_average(spark, d):
    return _lang_avgs(spark, d)


@register("multilingual_average", f"WITH {LANG_AVG_CTE} SELECT * FROM ma")
def q_multilingual_average(spark, d):
    return S.multilingual_average(_lang_avgs(spark, d), LANG3, by=("model_key", "revision"))


@register("leaderboard", f"""WITH {LANG_AVG_CTE},
last AS (SELECT model_key, max(rev_m) AS rev_m FROM curve GROUP BY model_key),
fin AS (SELECT ma.model_key, ma.multilingual_avg FROM ma JOIN (SELECT DISTINCT model_key, revision, rev_m FROM curve) c
        USING (model_key, revision) JOIN last USING (model_key, rev_m))
SELECT model_key, multilingual_avg, CAST(rank() OVER (ORDER BY multilingual_avg DESC) AS INTEGER) AS rank FROM fin""")
def q_leaderboard(spark, d):
    ma = S.multilingual_average(_lang_avgs(spark, d), LANG3, by=("model_key", "revision"))
    last = latest_revision(curve(spark, d))
    fin = ma.join(last, ["model_key", "revision"]).select("model_key", "multilingual_avg")
    return S.leaderboard(fin)


def latest_revision(c: DataFrame) -> DataFrame:
    """Each model's final revision (largest revision number)."""
    return c.groupBy("model_key").agg(F.max_by("revision", "rev_m").alias("revision"))


@register("revision_gain", f"""WITH {EVAL_CTE}
SELECT *, lag(acc) OVER (PARTITION BY model_key, task ORDER BY rev_m) AS prev_acc,
       acc - lag(acc) OVER (PARTITION BY model_key, task ORDER BY rev_m) AS gain FROM curve""")
def q_revision_gain(spark, d):
    return S.revision_gain(curve(spark, d))


@register("best_revision", f"""WITH {EVAL_CTE},
r AS (SELECT *, row_number() OVER (PARTITION BY model_key, task ORDER BY acc DESC, rev_m ASC) AS rn FROM curve)
SELECT model_key, task, revision AS best_revision, rev_m, acc AS best_acc FROM r WHERE rn = 1""")
def q_best_revision(spark, d):
    return S.best_revision(curve(spark, d))


@register("missing_cells", f"""WITH {LANG_AVG_CTE}
SELECT g.* FROM grid g ANTI JOIN (SELECT DISTINCT model_key, revision, lang, task FROM curve) c
USING (model_key, revision, lang, task)""")
def q_missing_cells(spark, d):
    return S.missing_cells(curve(spark, d), EXPECTED, by=("model_key", "revision"))


@register("score_delta", f"""WITH {EVAL_CTE},
base AS (SELECT revision, task, acc AS base_acc FROM curve WHERE model_key = '{BASE_MODEL}')
SELECT c.*, b.base_acc, (c.acc - b.base_acc) * 100 AS delta_points
FROM curve c LEFT JOIN base b USING (revision, task) WHERE c.model_key <> '{BASE_MODEL}'""")
def q_score_delta(spark, d):
    return S.score_delta(curve(spark, d), BASE_MODEL)


@register("task_drift", f"""WITH {EVAL_CTE}, {_expected_sql()},
act AS (SELECT DISTINCT task FROM curve WHERE indent = 1),
exp AS (SELECT DISTINCT task FROM expected)
SELECT task, 'missing' AS drift FROM (SELECT task FROM exp EXCEPT ALL SELECT task FROM act)
UNION ALL
SELECT task, 'unexpected' AS drift FROM (SELECT task FROM act EXCEPT ALL SELECT task FROM exp)""")
def q_task_drift(spark, d):
    exp = spark.createDataFrame([(t,) for ts in EXPECTED.values() for t in ts], "task string").distinct()
    act = curve(spark, d).filter(F.col("indent") == 1).select("task").distinct()
    return S.task_drift(exp, act)


# ---------------------------------------------------------------------------
# Job logs
# ---------------------------------------------------------------------------

LANG2_SQL = "CASE lang WHEN 'eng' THEN 'en' WHEN 'nld' THEN 'nl' WHEN 'zho' THEN 'zh' END"


def jobs_table(spark, d) -> DataFrame:
    from ..functions.columns import lang2
    it = eval_items(spark, d)
    g = it.groupBy("model_key", "lang", "event_type").agg(
        F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count(F.lit(1)).alias("n"))
    return g.select("model_key", lang2("lang").alias("lang2"), F.col("event_type").alias("task"),
                    (F.length("event_type") % 4).alias("gpu"),
                    F.when(F.col("n") >= 20, 0).otherwise(1).alias("rc"),
                    (F.unix_timestamp(F.col("t1").cast("timestamp")) - F.unix_timestamp(F.col("t0").cast("timestamp"))).alias("dt"))


def job_lines(spark, d) -> DataFrame:
    j = jobs_table(spark, d)
    tag = F.concat("lang2", F.lit("/"), "task")
    start = F.concat(F.lit("[gpu"), F.col("gpu").cast("string"), F.lit("] "), tag, F.lit(" START -> finetune_"),
                     F.col("lang2"), F.lit("_"), F.col("task"), F.lit(".log"))
    end = F.concat(F.lit("[gpu"), F.col("gpu").cast("string"), F.lit("] "), tag, F.lit(" END rc="),
                   F.col("rc").cast("string"), F.lit(" dt="), F.col("dt").cast("string"), F.lit("s"))
    return j.select("model_key", F.explode(F.array(start, end)).alias("line"))


JOBS_PART = f"""jobs AS (SELECT model_key, {LANG2_SQL} AS lang, event_type AS task, CAST(length(event_type) % 4 AS INTEGER) AS gpu,
                CASE WHEN count(*) >= 20 THEN 0 ELSE 1 END AS rc,
                CAST(date_diff('second', min(ts), max(ts)) AS BIGINT) AS dt
         FROM items GROUP BY model_key, lang, event_type)"""
JOBS_CTE = f"{ITEMS_CTE},\n{JOBS_PART}"


@register("job_log", f"""WITH {JOBS_CTE}
SELECT model_key, lang, task, gpu, rc, dt, true AS started, true AS finished FROM jobs""")
def q_job_log(spark, d):
    return E.job_log(job_lines(spark, d), by=("model_key",))


@register("job_summary", f"""WITH {JOBS_CTE}
SELECT model_key, count(*) FILTER (WHERE run AND rc = 0) AS succeeded, count(*) FILTER (WHERE run) AS total,
       count(*) FILTER (WHERE NOT run) AS skipped, bool_and(coalesce(rc = 0, false)) FILTER (WHERE run) AS all_ok,
       CAST(sum(dt) FILTER (WHERE run) AS BIGINT) AS total_seconds
FROM (SELECT *, lang || '/' || task IN ('en/click', 'en/view', 'nl/click', 'nl/purchase', 'zh/signup', 'zh/error') AS run FROM jobs)
GROUP BY model_key""")
def q_job_summary(spark, d):
    jobs = E.job_log(job_lines(spark, d), by=("model_key",))
    only = ["en/click", "en/view", "nl/click", "nl/purchase", "zh/signup", "zh/error"]
    return S.job_summary(jobs, by=("model_key",), only=only)


@register("wallclock_by_class", f"""WITH {JOBS_CTE}
SELECT split_part(task, '_', 1) AS task_class, min(dt) AS min_seconds, max(dt) AS max_seconds, count(*) AS jobs
FROM jobs GROUP BY 1""")
def q_wallclock(spark, d):
    return S.wallclock_by_class(E.job_log(job_lines(spark, d), by=("model_key",)))
