"""Two-level prefix sum: running totals without a single-task global window.

A plain ``Window.orderBy(...)`` without ``partitionBy`` moves every row into
one task. Here rows are split into ordered buckets (``bucket`` must be
non-decreasing in the order): (1) a running sum inside each (partition,
bucket) window runs in parallel; (2) bucket totals, at most
partitions x buckets rows, get their own running sum; (3) the bucket offsets
are joined back. AQE turns that join into a broadcast once the runtime size
of the offset table is known to be small, so the big side is not shuffled
again.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import map_literal
from ..session import cut_lineage


def numbered(rows: DataFrame, by: str, order: Sequence[str | Column], name: str, out: str = "n") -> DataFrame:
    """Add ``out``: the number (from 1) of each row among those of its ``by`` (not null) in ``order``.

    A range exchange deals the rows out, every task numbers its own sorted
    rows, and the totals of the tasks before it are added: a hot ``by`` is
    never one task's window. The numbered rows are written, so a repeated task
    cannot deal rows equal in the order differently.
    """
    placed = cut_lineage(rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
                         .withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_task", F.shiftright("_at", 33))  # task above, row within it below
    sizes = placed.groupBy(by, "_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    upto = Window.partitionBy(by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    offsets = sizes.select(by, "_task", "_first", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    placed = placed.join(F.broadcast(offsets), [by, "_task"])
    return placed.withColumn(out, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop(
        "_at", "_task", "_first", "_before")


def running_sums(df: DataFrame, values: Sequence[str], order: Sequence[str | Column],
                 bucket: str | Column, partition: Sequence[str] = (),
                 suffix: str = "_before", inclusive: bool = False,
                 keep_until: Mapping[str, float] | None = None) -> DataFrame:
    """Add ``<value><suffix>`` = sum of ``value`` over all earlier rows
    (``inclusive`` adds the current row) in ``order`` within ``partition``.

    ``order`` must be a total order (end with a unique key) for a
    deterministic result. ``keep_until`` (one partition column, first value)
    drops every bucket whose offset already exceeds the limit of its
    partition key *before* the window sorts anything - a prefix of a huge
    input costs only the bucket totals.
    """
    part = list(partition)
    b = "_ps_bucket"
    d = df.withColumn(b, bucket if isinstance(bucket, Column) else F.col(bucket))
    # bucket totals straight from the input (partial aggregation: one row per
    # (map task, bucket) is shuffled), running sum over the small table
    totals = d.groupBy(*part, b).agg(*[F.sum(F.col(v)).alias(f"_ps_tot_{v}") for v in values])
    w_b = Window.partitionBy(*part).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *part, b,
        *[F.coalesce(F.sum(f"_ps_tot_{v}").over(w_b), F.lit(0)).alias(f"_ps_off_{v}") for v in values])
    if keep_until is not None:
        if len(part) != 1:
            raise ValueError("keep_until needs exactly one partition column")
        lim = F.element_at(map_literal({k: float(v) for k, v in keep_until.items()}, "double"), F.col(part[0]))
        offsets = offsets.filter(F.col(f"_ps_off_{values[0]}") <= lim)
    # offsets: one row per bucket; AQE broadcasts it at run time when small
    d = d.join(offsets, on=[*part, b], how="inner")
    w_local = (Window.partitionBy(*part, b).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    outs = {}
    for v in values:
        inc = F.col(f"_ps_off_{v}") + F.sum(F.col(v)).over(w_local)
        outs[f"{v}{suffix}"] = inc if inclusive else inc - F.col(v)
    d = d.withColumns(outs)
    return d.drop(b, *[f"_ps_off_{v}" for v in values])
