"""Exact deduplication with streaming keyed state (operator 6, built-in functions only).

Documents are reduced to digest rows; a Structured Streaming aggregation
keeps, per digest and without expiry, the smallest document id, the locator
of its content and the group size in a RocksDB state store under the shared
checkpoint folder. Digest hits are then confirmed on the full normalised
bytes of the document the state points to; texts that only share a digest
are regrouped on the full text.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import SPACE, cut

_ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no preallocated files
}


def normalised(text: str | Column = "text") -> Column:
    """Every run of white space becomes one space; null counts as empty."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(t, F.lit("")), SPACE, " ")


def digest_rows(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """(doc_id, sha, digest, locator): the text itself goes no further."""
    return (docs.select("doc_id", F.unhex(F.sha2(normalised(docs["text"]).cast("binary"), 256)).alias("sha"),
                        F.input_file_name().alias("locator"))
            .withColumn("digest", F.expr(f"substring(sha, 1, {int(digest_bytes)})")))


def update_state(spark: SparkSession, rows_path: str, schema, state_path: str,
                 max_files_per_trigger: int = 100_000) -> DataFrame:
    """Feed all new digest files under ``rows_path`` into the keyed state; returns the state.

    Calling it again with the same ``state_path`` continues: only files not
    seen before are read. The query ends when no file is left.
    """
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(rows_path))
    keyed = stream.groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")).alias("keeper"),
        F.count(F.lit(1)).alias("n"))
    before = {k: spark.conf.get(k, None) for k in _ROCKSDB}
    for k, v in _ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        query = (keyed.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
                 .option("checkpointLocation", state_path).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return read_state(spark, state_path)


def read_state(spark: SparkSession, state_path: str) -> DataFrame:
    """(digest, keep_id, locator, n) from the newest version of the state store."""
    state = spark.read.format("statestore").load(state_path)
    keeper, n = state.schema["value"].dataType.names
    return state.select(F.col("key.digest").alias("digest"), F.col(f"value.`{keeper}`.doc_id").alias("keep_id"),
                        F.col(f"value.`{keeper}`.locator").alias("locator"), F.col(f"value.`{n}`").alias("n"))


def exact_groups(docs: DataFrame, digest_bytes: int = 32, max_files_per_trigger: int = 100_000) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white-space normalisation; the
    smallest doc_id stays. Null text counts as empty, so null, empty and no
    other text form one group. A null doc_id stays only in a group without
    any other id. Repeated rows (same id, same text) are counted in
    group_size and each is returned; an empty table gives no rows. Columns
    besides doc_id and text are ignored. ``digest_bytes`` shortens the
    digest (tests force collisions with it); results do not depend on it.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    rows = cut(digest_rows(docs, digest_bytes), "exact-rows")
    home = f"{checkpoint_dir(spark).rstrip('/')}/exact-state-{uuid.uuid4().hex[:12]}"
    state = cut(update_state(spark, rows.inputFiles()[0].rsplit("/", 1)[0], rows.schema, home,
                             max_files_per_trigger), "exact-keep") if rows.inputFiles() else None
    if state is None:
        state = rows.select("digest", F.col("doc_id").alias("keep_id"), "locator", F.lit(0).cast("long").alias("n"))
    # narrow join; both sides are plain exchanges, so a hot digest is split by AQE
    given = cut(rows.select("doc_id", "sha", "digest").join(state.select("digest", "keep_id", "n"), "digest"),
                "exact-given")
    # texts of the hits only: the one exchange that carries text
    hits = given.filter("n > 1").select("doc_id", "digest", "keep_id").distinct()
    texts = docs.select("doc_id", "text").join(
        hits.withColumnRenamed("doc_id", "hit_id"), F.col("doc_id").eqNullSafe(F.col("hit_id")))
    sha = F.unhex(F.sha2(F.col("norm").cast("binary"), 256))
    texts = cut(texts.select("doc_id", "digest", "keep_id", normalised("text").alias("norm"))
                .withColumn("sha", sha).filter(F.col("digest") == F.expr(f"substring(sha, 1, {int(digest_bytes)})")),
                "exact-texts")
    keepers = cut(texts.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest")
                  .agg(F.min("norm").alias("keeper_norm")), "exact-keepers")
    other = cut(texts.join(keepers, "digest").filter("norm <> keeper_norm").select("doc_id", "digest", "sha", "norm"),
                "exact-collisions")
    hexed = F.lower(F.hex("sha")).alias("text_sha256")
    if other.isEmpty():
        out = given.withColumnRenamed("n", "group_size")
    else:
        again = other.groupBy("digest", "sha", "norm").agg(F.min("doc_id").alias("keep2"),
                                                           F.count(F.lit(1)).alias("n2"))
        moved = again.groupBy("digest").agg(F.sum("n2").alias("gone"))
        out = (given.join(again.select("digest", "sha", "keep2", "n2"), ["digest", "sha"], "left")
               .join(moved, "digest", "left")
               .withColumn("keep_id", F.when(F.col("n2").isNotNull(), F.col("keep2")).otherwise(F.col("keep_id")))
               .withColumn("group_size", F.coalesce("n2", F.col("n") - F.coalesce("gone", F.lit(0)))))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                      F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), hexed)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of every distinct text (up to white space), with all its columns.

    The row has the smallest id of its text; the same id, or none, under
    another text is another document and stays too.
    """
    kept = exact_groups(docs).filter("kept").select(
        F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).distinct()
    sha = "exact_" + "_".join(docs.columns)
    d = docs.withColumn(sha, F.sha2(normalised(docs["text"]).cast("binary"), 256))
    d = d.join(kept, d["doc_id"].eqNullSafe(kept["kept_id"]) & (d[sha] == kept["kept_sha"]), "left_semi")
    return d.dropDuplicates([sha]).select(*docs.columns)
