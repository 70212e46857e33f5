"""Small helpers shared by the operators of this subpackage."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage as cut

__all__ = ["WORD", "SPACE", "cut", "table", "byte_words", "count_words", "mix64", "fold_of", "in_order"]

#: One word / one run of white space (ASCII space and \t..\r), as every contract here uses them.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes with A-Z lower-cased (null: no words)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(col: str | Column) -> Column:
    """Number of words as a long; null and empty texts have none."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixer (two xor-shift-multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def fold_of(doc_id: str | Column) -> Column:
    """crc32 of the id as text modulo 4; fold 2 is held out from every learner."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % 4


def in_order(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``rows`` with ``pos``, their position (from 0) in the given order of the whole table.

    A range exchange deals the rows out, every task numbers its own sorted
    rows, and the totals of the tasks before it are added: no group, however
    large, is ever one task's window. The numbered rows are written, so a lost
    executor cannot deal them differently. Rows equal in the order are
    numbered as they come.
    """
    low = (1 << 33) - 1  # monotonically_increasing_id: task above, row within it below
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("pos", F.monotonically_increasing_id()), name)
    task = F.shiftright("pos", 33)
    sizes = placed.groupBy(task.alias("in_task")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("in_task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task of the exchange
    offsets = sizes.select("in_task", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset"))
    out = placed.join(F.broadcast(offsets), task == F.col("in_task"))
    return out.withColumn("pos", F.col("offset") + F.col("pos").bitwiseAND(F.lit(low))).drop("in_task", "offset")
