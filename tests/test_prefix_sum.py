"""Two-level prefix sums equal a plain window."""
from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexicount.operators.prefix_sum import running_sums


def test_running_sums_equal_window(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice("abc"), i, rnd.randint(0, 50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = running_sums(df, ["v"], order=["k"], bucket=F.floor(F.col("k") / 97), partition=["g"])
    w = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("w", F.coalesce(F.sum("v").over(w), F.lit(0)))
    a = {(r.g, r.k): r.v_before for r in got.collect()}
    b = {(r.g, r.k): r.w for r in want.collect()}
    assert a == b


def test_keep_until_prunes_whole_buckets_only(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), i, rnd.randint(1, 20)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    full = {(r.g, r.k): r.v_before for r in
            running_sums(df, ["v"], order=["k"], bucket=F.floor(F.col("k") / 50), partition=["g"]).collect()}
    lim = {"a": 5000.0, "b": 100.0}
    cut = {(r.g, r.k): r.v_before for r in running_sums(
        df, ["v"], order=["k"], bucket=F.floor(F.col("k") / 50), partition=["g"], keep_until=lim).collect()}
    assert cut and all(full[key] == val for key, val in cut.items())
    # every row whose sum before it is within the limit is kept
    assert {key for key, val in full.items() if val <= lim[key[0]]} <= set(cut)
    assert len(cut) < len(full)
