"""Evaluation results, logs and dataset cards as DataFrames.

Every reader takes either paths (file layout of the evaluation harness and
training runs) or a DataFrame of already-loaded text/JSON strings, so the
same parsing runs on files and on text that Spark produced upstream.
Parsing is built-in (``from_json``, ``regexp_extract``, ``split``); there is
no per-line Python.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Harness result entry; keys contain commas, so the schema is explicit.
TASK_ENTRY = T.StructType([
    T.StructField("alias", T.StringType()),
    T.StructField("acc,none", T.DoubleType()),
    T.StructField("acc_stderr,none", T.DoubleType()),
])
RESULTS_SCHEMA = T.StructType([T.StructField("results", T.MapType(T.StringType(), TASK_ENTRY))])

FINETUNE_SCHEMA = T.StructType([
    T.StructField("epoch", T.DoubleType()), T.StructField("eval_accuracy", T.DoubleType()),
    T.StructField("eval_loss", T.DoubleType()), T.StructField("eval_runtime", T.DoubleType()),
    T.StructField("eval_samples", T.LongType()),
    T.StructField("eval_samples_per_second", T.DoubleType()),
    T.StructField("eval_steps_per_second", T.DoubleType()),
])


# ---------------------------------------------------------------------------
# Harness result JSON
# ---------------------------------------------------------------------------

def parse_results(df: DataFrame, json_col: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """Explode ``{"results": {task: {alias, "acc,none", ...}}}`` into rows
    (task, alias, acc, stderr) keeping the ``keep`` columns."""
    p = df.select(*keep, F.from_json(F.col(json_col), RESULTS_SCHEMA)["results"].alias("_r"))
    e = p.select(*keep, F.explode("_r").alias("task", "_v"))
    return e.select(*keep, "task", F.coalesce(F.col("_v.alias"), F.col("task")).alias("alias"),
                    F.col("_v").getField("acc,none").alias("acc"),
                    F.col("_v").getField("acc_stderr,none").alias("stderr"))


def eval_results(spark: SparkSession, root: str, model: str | None = None) -> DataFrame:
    """S04 on files: ``root/<revision>/<org__model>/results_*.json``, revisions
    being ``chck_*`` and ``main``. Revision,
    model key and file name come from the path (``_metadata.file_path``)."""
    glob = f"{root}/{{chck_*,main}}/{model.replace('/', '__') if model else '*'}/results_*.json"
    raw = spark.read.text(glob, wholetext=True).select(
        F.col("value").alias("json"), F.col("_metadata.file_path").alias("path"))
    raw = raw.select(
        "json",
        F.regexp_extract("path", r"/(chck_[^/]+|main)/[^/]+/results_[^/]*\.json$", 1).alias("revision"),
        F.regexp_extract("path", r"/(?:chck_[^/]+|main)/([^/]+)/results_[^/]*\.json$", 1).alias("model_key"),
        F.regexp_extract("path", r"/(results_[^/]*\.json)$", 1).alias("file"))
    return parse_results(raw, keep=("model_key", "revision", "file"))


def merge_latest(rows: DataFrame, by: tuple[str, ...] = ("model_key", "revision"),
                 file: str = "file") -> DataFrame:
    """Files in name order, a later file overwrites a task of an earlier one."""
    g = rows.groupBy(*by, "task").agg(F.max_by(F.struct("alias", "acc", "stderr", file), F.col(file)).alias("_v"))
    return g.select(*by, "task", "_v.alias", "_v.acc", "_v.stderr", F.col(f"_v.{file}").alias(file))


# ---------------------------------------------------------------------------
# Fine-tune results and dataset metadata
# ---------------------------------------------------------------------------

def parse_finetune(df: DataFrame, json_col: str = "json", path_col: str = "path",
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """``.../finetune/<lang2>/<task>/eval_results.json`` -> one row with
    (lang, task) from the path and the metrics from the JSON."""
    j = F.from_json(F.col(json_col), FINETUNE_SCHEMA)
    rx = r"/finetune/([^/]+)/([^/]+)/eval_results\.json$"
    return df.select(
        *keep,
        F.regexp_extract(path_col, rx, 1).alias("lang"), F.regexp_extract(path_col, rx, 2).alias("task"),
        j["eval_accuracy"].alias("accuracy"), j["eval_loss"].alias("loss"),
        j["eval_samples"].alias("samples"), j["eval_runtime"].alias("runtime"), j["epoch"].alias("epoch"))


def finetune_results(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.text(f"{root}/finetune/*/*/eval_results.json", wholetext=True)
    return parse_finetune(raw.select(F.col("value").alias("json"), F.col("_metadata.file_path").alias("path")))


METADATA_SCHEMA = "dataset_name string, language_code string, creation_date string, num_documents long"


def parse_metadata(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Dataset metadata JSON -> typed row (creation date as timestamp)."""
    j = F.from_json(F.col(json_col), METADATA_SCHEMA)
    return df.select(j["dataset_name"].alias("dataset_name"), j["language_code"].alias("language_code"),
                     F.to_timestamp_ntz(j["creation_date"]).alias("created"),
                     j["num_documents"].alias("num_documents"))


# ---------------------------------------------------------------------------
# Dataset cards (markdown)
# ---------------------------------------------------------------------------

def card_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Card files by language -> (lang, card), one row per file."""
    out = None
    for lang, path in paths.items():
        one = spark.read.text(path, wholetext=True).select(F.lit(lang).alias("lang"), F.col("value").alias("card"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "lang string, card string")
    return out


def card_lines(cards: DataFrame, text: str = "card", keep: tuple[str, ...] = ("lang",)) -> DataFrame:
    """Cards ``(lang, card)`` -> numbered lines (one card is one bounded document)."""
    return cards.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def _plain(line: Column) -> Column:
    """A markdown line without emphasis, list bullet and surrounding blanks."""
    return F.trim(F.regexp_replace(F.replace(line, F.lit("*")), r"^\s*-\s+", ""))


def _count(text: Column) -> Column:
    """A count with thousands separators as a long; null when it is not one."""
    return F.replace(F.trim(text), F.lit(",")).try_cast("long")


def card_totals(cards: DataFrame, text: str = "card") -> DataFrame:
    """The ``Total Tokens: N`` field of each card -> (lang, total_tokens);
    a card without it raises at run time."""
    field = _plain(F.col("line"))
    value = F.when(F.substring_index(field, ":", 1) == "Total Tokens", _count(F.substring_index(field, ":", -1)))
    found = card_lines(cards, text).groupBy("lang").agg(F.max(value).alias("n"))
    return found.select("lang", F.coalesce("n", F.raise_error(
        F.concat(F.lit("no total token count on the card of "), F.col("lang"))).cast("long")).alias("total_tokens"))


def card_categories(cards: DataFrame, text: str = "card",
                    section: str = "Tokens Per Category", stop: str = "Tokens Per Group") -> DataFrame:
    """``name: N tokens`` items of the category section (up to the next
    ``###`` heading or the group section) -> (lang, category, tokens). A card
    without the section, or with an empty one, raises at run time."""
    body = F.element_at(F.split(F.col(text), section, 2), 2)  # null when there is no such heading
    body = F.substring_index(F.substring_index(body, stop, 1), "\n###", 1)
    items = F.filter(F.transform(F.split(body, "\n"), _plain), lambda x: x.contains(" tokens") & x.contains(":"))
    pairs = F.filter(F.transform(items, lambda x: F.struct(
        F.trim(F.substring_index(x, ":", 1)).alias("category"),
        _count(F.substring_index(F.substring_index(x, ":", -1), " tokens", 1)).alias("tokens"))),
        lambda s: s["tokens"].isNotNull())
    missing = F.raise_error(F.concat(F.lit("no category counts on the card of "), F.col("lang")))
    checked = F.when(F.size(pairs) > 0, pairs).otherwise(missing)
    return cards.select("lang", F.explode(checked).alias("p")).select("lang", "p.category", "p.tokens")


def metadata_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """S11 on files: (file, json), one row per metadata file."""
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("json"))


def log_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text files of S07-S10 as (file, line_no, line), numbered from 0 per file.

    A log may be of any size: Spark reads it in blocks, and a line's number is
    the count of lines in the blocks before plus its place in its own block.
    Two passes over the files; only one row per block is gathered. A line ends
    at a line feed (a carriage return before it is dropped).
    """
    raw = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.regexp_replace("value", "\r$", "").alias("line"), F.monotonically_increasing_id().alias("id"))
    # ids of a block follow each other; the same files are cut into the same blocks and tasks every time
    blocks = raw.groupBy(F.col("file").alias("of"), F.col("start").alias("block")).agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("of").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("of", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = raw.join(F.broadcast(blocks), (F.col("file") == F.col("of")) & (F.col("start") == F.col("block")))  # a row per block
    return rows.select("file", (F.col("before") + F.col("id") - F.col("first")).alias("line_no"), "line")


# ---------------------------------------------------------------------------
# logs
# ---------------------------------------------------------------------------

STEP_RX = (r"^\[step\s+(\d+)/(\d+)\]\s+loss=([\d.eE+-]+)\s+lr=([\d.eE+-]+)\s+ref_tok=([\d,]+)"
           r"\s+frac=([\d.eE+-]+)\s+tok/s=([\d,]+)")
CKPT_RX = r"^\[checkpoint\] saving (chck_\d+M) at ([\d,]+) ref tokens"


def _num(c):
    return F.replace(c, F.lit(","), F.lit(""))


def train_log_steps(lines: DataFrame, line: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """Step lines -> (step, total_steps, loss, lr, ref_tokens, frac, tok_s); others skipped."""
    v = F.col(line)
    return lines.filter(v.rlike(STEP_RX)).select(
        *keep,
        F.regexp_extract(v, STEP_RX, 1).try_cast("long").alias("step"),
        F.regexp_extract(v, STEP_RX, 2).try_cast("long").alias("total_steps"),
        F.regexp_extract(v, STEP_RX, 3).try_cast("double").alias("loss"),
        F.regexp_extract(v, STEP_RX, 4).try_cast("double").alias("lr"),
        _num(F.regexp_extract(v, STEP_RX, 5)).try_cast("long").alias("ref_tokens"),
        F.regexp_extract(v, STEP_RX, 6).try_cast("double").alias("frac"),
        _num(F.regexp_extract(v, STEP_RX, 7)).try_cast("long").alias("tok_s"))


def train_log_checkpoints(lines: DataFrame, line: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """Checkpoint lines -> (revision, ref_tokens_at_save)."""
    v = F.col(line)
    return lines.filter(v.rlike(CKPT_RX)).select(
        *keep, F.regexp_extract(v, CKPT_RX, 1).alias("revision"),
        _num(F.regexp_extract(v, CKPT_RX, 2)).try_cast("long").alias("ref_tokens_at_save"))


def _cells(line):
    return F.transform(F.split(line, r"\|"), lambda x: F.trim(x))


def score_tables(lines: DataFrame, line: str = "line", line_no: str = "line_no",
                 by: tuple[str, ...] = ("file",), header_rx: str | None = None,
                 revision_rx: str | None = None) -> DataFrame:
    """Pipe tables of harness stdout -> (section, task, depth,
    metric, value, stderr).

    Rows are ``|task|version|filter|n-shot|metric|dir|value|±|stderr|``; a
    continuation row has an empty task cell and inherits the task above
    (forward fill with ``last(..., ignorenulls)`` in line order per file).
    ``header_rx`` (one capture group) marks a section header line whose
    value is forward-filled too (S09: ``[sweep] <rev> / zeroshot_<lang>``);
    ``revision_rx`` takes the revision from such a line into ``revision``.
    Without ``header_rx`` the section is the kind of table (groups or tasks)
    and ``title`` the ``=== title ===`` line above it (S08).
    """
    v = F.col(line)
    w = Window.partitionBy(*by).orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    d, more = lines, []

    def carried(rx: str) -> Column:
        return F.last(F.when(v.rlike(rx), F.regexp_extract(v, rx, 1)), ignorenulls=True).over(w)

    if revision_rx:
        d, more = d.withColumn("revision", carried(revision_rx)), ["revision"]
    if not header_rx:
        d, more = d.withColumn("title", carried(r"^=== (.+?) ===\s*$")), [*more, "title"]
    if header_rx:
        d = d.withColumn("section", F.last(F.when(v.rlike(header_rx), F.regexp_extract(v, header_rx, 1)),
                                           ignorenulls=True).over(w))
    else:
        d = d.withColumn("section", F.last(F.when(F.trim(v).startswith("|") & F.trim(v).contains("Groups"),
                                                  F.lit("groups")).when(F.trim(v).startswith("|") & F.trim(v).contains("Tasks"),
                                                  F.lit("tasks")), ignorenulls=True).over(w))
    c = _cells(v)
    # cells: '', task, version, filter, n-shot, metric, dir, value, '±', stderr, ''
    is_row = F.trim(v).startswith("|") & (F.size(c) >= 10) & (F.element_at(c, 8).rlike(r"^-?[\d.]+([eE][-+]?\d+)?$"))
    rows = d.filter(is_row).withColumn("_c", c).withColumn("_raw_task", F.split(v, r"\|").getItem(1))
    task_cell = F.when(F.trim(F.col("_raw_task")) != "", F.col("_raw_task"))
    rows = rows.withColumn("_task_raw", F.last(task_cell, ignorenulls=True).over(w))
    name = F.regexp_replace(F.col("_task_raw"), r"^\s*-?\s*", "")
    # depth: a subtask cell is '<spaces>- name', its depth is the number of spaces
    depth = F.when(F.col("_task_raw").rlike(r"^ *- "),
                   F.length(F.regexp_extract(F.col("_task_raw"), r"^( *)", 1))).otherwise(F.lit(0))
    return rows.select(
        *by, *more, "section", F.trim(name).alias("task"), depth.try_cast("int").alias("depth"),
        F.element_at("_c", 6).alias("metric"), F.element_at("_c", 8).try_cast("double").alias("value"),
        F.element_at("_c", 10).try_cast("double").alias("stderr"))


JOB_START_RX = r"^\[gpu(\d+)\] ([a-z]+)/([^ ]+) START"
JOB_END_RX = r"^\[gpu(\d+)\] ([a-z]+)/([^ ]+) END rc=(-?\d+) dt=(\d+)s"


def job_log(lines: DataFrame, line: str = "line", by: tuple[str, ...] = ()) -> DataFrame:
    """START / END lines -> one row per (lang, task) job with gpu, rc, dt,
    started, finished (a job without END has NULL rc)."""
    v = F.col(line)
    s = F.regexp_extract(v, JOB_START_RX, 3)
    e = F.regexp_extract(v, JOB_END_RX, 3)
    d = lines.select(
        *by,
        F.when(s != "", F.regexp_extract(v, JOB_START_RX, 2)).when(e != "", F.regexp_extract(v, JOB_END_RX, 2)).alias("lang"),
        F.when(s != "", s).when(e != "", e).alias("task"),
        F.when(s != "", F.regexp_extract(v, JOB_START_RX, 1)).when(e != "", F.regexp_extract(v, JOB_END_RX, 1)).try_cast("int").alias("gpu"),
        (s != "").alias("is_start"), (e != "").alias("is_end"),
        F.when(e != "", F.regexp_extract(v, JOB_END_RX, 4)).try_cast("int").alias("rc"),
        F.when(e != "", F.regexp_extract(v, JOB_END_RX, 5)).try_cast("long").alias("dt"))
    d = d.filter(F.col("task").isNotNull())
    return d.groupBy(*by, "lang", "task").agg(
        F.max("gpu").alias("gpu"), F.max("rc").alias("rc"), F.max("dt").alias("dt"),
        F.max(F.col("is_start").try_cast("int")).cast("boolean").alias("started"),
        F.max(F.col("is_end").try_cast("int")).cast("boolean").alias("finished"))


