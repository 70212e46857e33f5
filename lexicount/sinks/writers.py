"""Writers. Nested outputs are built with ``map_from_entries`` /
``to_json`` over bounded groups (tasks of a model, languages of a run,
categories of a language); nothing is assembled on the driver."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CURVE_COLUMNS = ("revision", "rev_M", "task", "lang", "indent", "is_group", "acc", "stderr")


def plain_float(c: Column | str) -> Column:
    """Decimal text of a value with at most 4 decimals, as Python prints it
    (0.5 -> '0.5', 0.0005 -> '0.0005', never scientific notation)."""
    s = F.format_string("%.4f", F.col(c) if isinstance(c, str) else c)
    return F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", ".0")


def write_curve(curve: DataFrame, out: str, columns: Sequence[str] = CURVE_COLUMNS) -> None:
    """Tidy CSV in the published layout (header, column order, ``True`` /
    ``False``, plain decimals), ordered rows in one file (the curve is small:
    revisions x tasks). With no rows the file is created empty (no header)."""
    text = curve.select(
        "revision", F.col("rev_m").cast("string").alias("rev_M"), "task", "lang", "indent",
        F.when(F.col("is_group"), F.lit("True")).otherwise(F.lit("False")).alias("is_group"),
        plain_float("acc").alias("acc"), plain_float("stderr").alias("stderr"), F.col("rev_m").alias("_order"))
    ordered = text.orderBy("_order", F.coalesce("lang", F.lit("")), "task").select(*columns)
    if ordered.limit(1).count() == 0:
        ordered.coalesce(1).write.mode("overwrite").option("header", False).csv(out)
        return
    ordered.coalesce(1).write.mode("overwrite").option("header", True).csv(out)


def _sorted_map(key: Column | str, value: Column | str) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    v = F.col(value) if isinstance(value, str) else value
    entries = F.collect_list(F.struct(k.alias("k"), v.alias("v")))
    by_key = F.array_sort(entries, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
    return F.map_from_entries(by_key)


def submission(zero_shot: DataFrame, finetune: DataFrame, by: str = "model_key") -> DataFrame:
    """``{task: {key: acc}}`` per model; key = task for zero-shot rows,
    the 2-letter language for fine-tune rows. Input rows (by, task, key, acc)."""
    rows = zero_shot.unionByName(finetune)
    inner = rows.groupBy(by, "task").agg(_sorted_map("key", "acc").alias("m"))
    outer = inner.groupBy(by).agg(_sorted_map("task", "m").alias("sub"))
    return outer.select(by, F.to_json("sub").alias("json"))


SUBMISSION_TYPE = "map<string,map<string,double>>"


def read_submission(df: DataFrame, json_col: str = "json", keep: Sequence[str] = ("model_key",)) -> DataFrame:
    m = df.select(*keep, F.explode(F.from_json(json_col, SUBMISSION_TYPE)).alias("task", "inner"))
    return m.select(*keep, "task", F.explode("inner").alias("key", "acc"))


def run_summary(consumption: DataFrame, steps: Column | int, wallclock: float | None = None) -> DataFrame:
    """Steps, total reference tokens, consumed and epochs per language
    (from ``consumption_summary``) as one JSON document."""
    s = F.lit(steps) if isinstance(steps, int) else steps
    agg = consumption.agg(
        F.sum("consumed").cast("long").alias("ref_tokens"),
        _sorted_map("lang", F.col("consumed").cast("long")).alias("consumed_per_lang"),
        _sorted_map("lang", "epochs").alias("epochs_per_lang"))
    return agg.select(F.to_json(F.struct(s.cast("long").alias("steps"), "ref_tokens", "consumed_per_lang",
                                         "epochs_per_lang", F.lit(wallclock).cast("double").alias("wallclock_seconds"))
                                ).alias("json"))


def availability_json(avail: DataFrame) -> DataFrame:
    """``{lang: available}`` as JSON."""
    return avail.agg(F.to_json(_sorted_map("lang", "available")).alias("json"))


def audit_report(long: DataFrame) -> DataFrame:
    """Long audit rows (lang, metric, key, value) re-nested per language:
    scalar metrics have key NULL; share/top-k metrics become maps."""
    scal = long.filter(F.col("key").isNull()).groupBy("lang").agg(_sorted_map("metric", "value").alias("scalars"))
    maps = (long.filter(F.col("key").isNotNull()).groupBy("lang", "metric")
                .agg(_sorted_map("key", "value").alias("m"))
                .groupBy("lang").agg(_sorted_map("metric", "m").alias("maps")))
    j = scal.join(maps, "lang", "full_outer")
    return j.select("lang", F.to_json(F.struct("scalars", "maps")).alias("json"))


def write_json(documents: DataFrame, out: str, json_col: str = "json") -> None:
    """JSON documents as text files, one document per line
    (columns besides ``json_col``, such as the model or language, become
    partition folders)."""
    keys = [c for c in documents.columns if c != json_col]
    w = documents.select(*keys, F.col(json_col).alias("value")).write.mode("overwrite")
    (w.partitionBy(*keys) if keys else w).text(out)


def write_sequences(seqs: DataFrame, out: str, rows_per_file: int = 1 << 16) -> None:
    """Packed sequences as Parquet, range-partitioned on ``seq_id`` so each
    file holds a contiguous block of sequences."""
    (seqs.repartitionByRange("seq_id").sortWithinPartitions("seq_id")
         .write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(out))


def write_shuffled(df: DataFrame, out: str, seed: int, id_col: str = "doc_id", partitions: int | None = None) -> None:
    """Corpus pre-shuffled on disk by the seeded key (range partitions on
    the md5 key, sorted within), so any prefix of the files is a uniform sample."""
    from ..functions.columns import order_key
    d = df.withColumn("order_key", order_key(seed, F.lit(0), id_col))
    ranged = d.repartitionByRange(partitions, "order_key") if partitions else d.repartitionByRange("order_key")
    ranged.sortWithinPartitions("order_key").write.mode("overwrite").parquet(out)


def write_vocab(vocab: DataFrame, merges: DataFrame, out: str) -> None:
    """Vocabulary (token, id) and merge table (rank, left, right) as Parquet."""
    vocab.write.mode("overwrite").parquet(f"{out}/vocab")
    merges.write.mode("overwrite").parquet(f"{out}/merges")
