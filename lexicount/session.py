"""Spark session and lineage helpers."""
from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "lexicount",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster leave ``master`` unset and size ``spark.sql.shuffle.partitions``
    for the data (AQE coalesces small partitions and splits skewed ones).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names it. Only a local master (tests, local runs), where
    driver and executors share one disk, gets a scratch folder of its own when
    it is unset; elsewhere that is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="lexicount-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut lineage with a table written into the shared checkpoint folder.

    The rows are computed once and written as Parquet (an RDD checkpoint of
    an unpersisted plan would compute it twice); reading it back gives a
    short lineage that survives executor loss, with column pruning and
    statistics for later joins.
    """
    import uuid
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by ``keys`` into as many tasks as a shuffle has.

    For a small table whose rows cost much: adaptive execution would merge its
    partitions by their bytes, and one task would do the work of all.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, F.xxhash64(*keys))  # by the keys themselves a grouped table would be left as it is


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a scan out by ``key`` into ``lexicount.scan.partitions`` tasks, if the session sets that.

    A file with a single row group is read by one task however it is split; a
    user with few such files can ask for more tasks. Without the setting the
    scan is left as it is, at every size.
    """
    n = df.sparkSession.conf.get("lexicount.scan.partitions", None)
    return df if df.isStreaming or not n else df.repartition(int(n), key)
