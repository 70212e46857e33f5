"""Bounded samples of labelled documents for the learners."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of

HELD_OUT = 2


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, per_class: int, classes: int) -> pd.DataFrame:
    """text, y, weight of at most ``per_class`` documents of each class.

    Rows of the held-out fold and null labels or ids are left out; several
    labels of one id count as their smallest. Within a class the documents
    with the smallest id hashes are taken; weights restore the class shares.
    """
    y = (labels.select("doc_id", label.cast("int").alias("y")).filter("doc_id is not null and y is not null")
         .filter(fold_of("doc_id") != HELD_OUT).groupBy("doc_id").agg(F.min("y").alias("y")))
    counts = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # row per class
    parts = []
    for k in range(classes):
        if counts.get(k):
            parts.append(y.filter(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class))
    if not parts:
        return pd.DataFrame({"text": [], "y": [], "weight": []})
    ids = parts[0]
    for p in parts[1:]:
        ids = ids.unionByName(p)
    # at most per_class x classes ids: a bounded broadcast, and a bounded result on the driver
    got = (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y")
           .limit(2 * per_class * classes).toPandas().sort_values(["doc_id", "text"]))
    taken = got["y"].value_counts()
    got["weight"] = [counts[k] / taken[k] for k in got["y"]]
    return got
