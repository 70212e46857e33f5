"""Corpus scan, one dataset per language, tagged and combined."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import map_literal, whitespace_tokens
from ..session import spread

# Column names of the published corpus files -> our names.
RENAMES = {"doc-id": "doc_id", "data-source": "data_source", "age-estimate": "age_estimate",
           "num-tokens": "num_tokens"}

CORPUS_COLUMNS = ("doc_id", "lang", "category", "data_source", "script", "age_estimate",
                  "text", "num_tokens")

# Script of the fixture languages (ISO 15924).
FIXTURE_SCRIPTS = {"en": "Latn", "de": "Latn", "es": "Latn", "fr": "Latn",
                   "eng": "Latn", "nld": "Latn", "zho": "Hans"}


def _normalise(df: DataFrame) -> DataFrame:
    for old, new in RENAMES.items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def corpus_scan(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet",
                required: tuple[str, ...] = ("text",)) -> DataFrame:
    """Read one dataset per language, tag rows with ``lang`` and union them.

    Columns are pruned by Catalyst at the scan; a language whose files lack a
    required column fails early instead of yielding NULLs downstream.
    """
    parts = []
    for lang, path in paths.items():
        df = _normalise(spark.read.format(fmt).load(path))
        missing = [c for c in required if c not in df.columns]
        if missing:
            raise ValueError(f"[{lang}] missing columns {missing} in {path}")
        parts.append(df.withColumn("lang", F.lit(lang)))
    if not parts:
        raise ValueError("no corpus paths given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def at_rest(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows with ``position``, their number (from 0) at rest: files by path, rows as they lie in their file.

    The position comes from the scan itself (path and row index), whatever
    tasks read it; only one row per file is gathered for the files' offsets.
    """
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    sizes = rows.groupBy(F.col("file").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("of", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = rows.join(offsets, F.col("file") == F.col("of"))
    return rows.withColumn("position", F.col("offset") + F.col("row")).drop("file", "row", "of", "offset")


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map the driver's ``documents`` table onto the corpus schema.

    ``source`` plays both category and data source, ``num_tokens`` is the
    whitespace token count (the published corpora define it the same way). The
    table has neither script nor age: the script is that of the language, but
    for every fifth id, and of four ids one has the age 'n/a', one none.
    """
    return corpus_view(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id"))


DOCUMENTS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus_view(d: DataFrame) -> DataFrame:
    """The mapping of ``documents_corpus`` for any (batch or streaming) frame."""
    return d.select(
        "doc_id", "lang",
        F.col("source").alias("category"),
        F.col("source").alias("data_source"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("Cyrl")).otherwise(
            F.element_at(map_literal(FIXTURE_SCRIPTS, "string"), F.col("lang"))).alias("script"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("n/a")).when(F.col("doc_id") % 4 > 1, F.concat(
            (F.col("doc_id") % 4 + 3).cast("string"), F.lit("+"))).alias("age_estimate"),
        "text",
        whitespace_tokens("text").alias("num_tokens"),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
