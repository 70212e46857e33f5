"""Mixing sources to target weights by a low-discrepancy schedule (operator 9).

Points of the golden-ratio sequence are mapped through the cumulative source
targets; the k-th slot that falls to a source takes that source's k-th block
of equally many words, cut from its documents in a shuffled order repeated up
to ``cap`` times. A source's last block ends at its target to the word, and a
block that got no slot is appended, so every source reaches its target at any
size; slots grow with the corpus and are ranked in parallel. The schedule is a
fixed function of the targets, so reruns agree, and any prefix of it is close
to the target shares.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.prefix_sum import running_sums
from .common import count_words, cut, in_order

#: Multiplier of the integer golden-ratio sequence on [0, 2^32): fixed value, floor(2^32 / phi) made odd.
GOLDEN = 2654435769
_RING = 1 << 32
_CELL_BITS = 12  # at least; more for many sources
_RANK_BITS = 16  # slots of a ranking bucket


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5,
                   cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> source, source_size, target.

    Sources by code point, null last, get ``weights`` in turn. ``share`` x all
    words is dealt by weight; a target stops at ``cap`` x its source's size and
    the excess is dealt again, which is the water level computed here from
    running sums over sources ordered by cap / weight. One row per source
    passes through one task.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                        (F.row_number().over(order) - 1) % len(weights) + 1)
    s = sizes.withColumn("weight", pick).withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    everything = Window.partitionBy()
    s = s.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    s = (s.withColumn("i", F.row_number().over(by_ratio))
         .withColumn("full", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
         .withColumn("level", (F.col("total") - F.col("full")) / F.col("open")))
    first_open = F.min_by("level", F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("i"))).over(everything)
    s = s.withColumn("water", first_open)
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight")))
    return s.select("source", "source_size", target.alias("target"))


def schedule(targets: DataFrame, block_words: int = 1024) -> DataFrame:
    """slot, skey, block (0, 1, ... within the source), words (of the block).

    ``targets`` has skey, target; a target is taken in whole words (rounded).
    There are as many slots as blocks; slot i has the point frac(i / phi) in
    32-bit integers. Points meet sources through equal cells of the unit
    interval (an equi-join), four cells or more for each source.
    """
    spark = targets.sparkSession
    whole = F.floor(F.col("target") + 0.5).cast("long")
    t = targets.select("skey", whole.alias("words")).filter("words > 0")
    o = Window.orderBy("skey")  # one row per source
    t = cut(t.select("skey", "words", F.ceil(F.col("words") / block_words).alias("blocks"), F.sum("words").over(o).alias("upto"),
                     F.sum("words").over(Window.partitionBy()).alias("total")), "mix-plan")
    facts = t.agg(F.sum("blocks").alias("slots"), F.count(F.lit(1)).alias("sources")).first()
    slots = int(facts["slots"] or 0)
    bits = min(28, max(_CELL_BITS, facts["sources"].bit_length() + 2))
    t = t.withColumn("lo", F.floor((F.col("upto") - F.col("words")) / F.col("total") * _RING).cast("long"))
    t = t.withColumn("hi", F.floor(F.col("upto") / F.col("total") * _RING).cast("long"))
    shift = 32 - bits
    cells = t.filter("hi > lo").withColumn("cell", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))))
    i = F.col("id") % _RING  # i * GOLDEN modulo the ring in two halves, which stay below 2^63
    point = ((F.shiftright(i, 16) * GOLDEN % _RING) * 65536 + i.bitwiseAND(F.lit(65535)) * GOLDEN) % _RING
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point"))
    points = points.withColumn("cell", F.shiftright("point", shift))
    hit = points.join(cells, "cell").filter((F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi")))
    hit = hit.select("slot", "skey", F.lit(1).cast("long").alias("one"))
    hit = running_sums(cut(hit, "mix-slots"), ["one"], ["slot"], F.shiftright("slot", _RANK_BITS), ["skey"])
    hit = hit.select("slot", F.col("skey").alias("hkey"), F.col("one_before").alias("block"))
    size = F.least(F.lit(block_words).cast("long"), F.col("words") - F.col("block") * block_words).alias("words")
    placed = cut(hit.join(t, F.col("hkey") == F.col("skey")).filter("block < blocks").select("slot", "skey", "block", size), "mix-placed")
    # blocks without a slot, a few of a source: appended block by block, sources in turn
    given = placed.groupBy(F.col("skey").alias("gkey")).agg(F.count(F.lit(1)).alias("given"))
    late = t.join(given, F.col("skey") == F.col("gkey"), "left").withColumn("given", F.coalesce("given", F.lit(0).cast("long")))
    late = late.filter("given < blocks").withColumn("block", F.explode(F.sequence("given", F.col("blocks") - 1)))
    late = in_order(late.select("skey", "block", size), ["block", "skey"], "mix-late")
    return placed.unionByName(late.select((F.col("pos") + slots).alias("slot"), "skey", "block", "words"))


def positions(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, passes: int = 2,
              seed: str = "", *more: Column) -> tuple[DataFrame, DataFrame]:
    """(documents with ``more``, size, skey, source_size, target and the words before them in their source, sources with targets)."""
    skey = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("="), F.col("source")))
    d = cut(docs.select("doc_id", "source", skey.alias("skey"), count_words(docs["text"]).alias("size"), *more),
            "mix-sizes")
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(sizes, weights, share, float(passes)).withColumn("skey", skey), "mix-targets")
    okey = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)))
    d = d.withColumn("okey", okey)
    d = d.join(targets.select("skey", "source_size", "target"), "skey")
    d = running_sums(d, ["size"], ["okey", "doc_id", "size"], F.substring("okey", 1, 3), ["skey"])
    return cut(d, "mix-positions"), targets


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, passes: int = 2,
          block_words: int = 1024, seed: str = "", *more: Column) -> tuple[DataFrame, DataFrame]:
    """(documents with targets and words taken, pieces of the mix).

    Documents: doc_id, source, size, source_size, target, taken; one row per
    input row. Pieces: slot, source key, doc_id, pass_no, first word, words:
    the mix itself in slot order. Null or empty texts have size 0 and nothing
    taken; a null source is a source of its own, ordered last. Repeated rows
    count as separate documents. An empty table gives no rows, and no words at
    all give targets of 0. Columns besides doc_id, text, source are ignored,
    but ``more`` (named expressions) go along with the documents.
    """
    d, targets = positions(docs, weights, share, passes, seed, *more)
    plan = schedule(targets, block_words)
    upto = F.floor(F.col("target") + 0.5).cast("long")
    spans = (d.filter("size > 0").withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
             .withColumn("start", (F.col("pass_no") * F.col("source_size") + F.col("size_before")).cast("long"))
             .withColumn("stop", F.least(F.col("start") + F.col("size"), upto)).filter("start < stop"))
    spans = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words),
                                                           F.floor((F.col("stop") - 1) / block_words))))
    begin = F.greatest("start", F.col("block") * block_words)
    end = F.least("stop", (F.col("block") + 1) * block_words)
    pieces = spans.join(plan.select("slot", "skey", "block"), ["skey", "block"]).select(
        "slot", "skey", "doc_id", "size", "size_before", "pass_no", (begin - F.col("start")).alias("first_word"),
        (end - begin).cast("long").alias("n_words"))
    key = ["skey", "size_before", "doc_id", "size"]  # a document with words has its own position in its source
    taken = pieces.groupBy(*key).agg(F.sum("n_words").alias("taken"))
    taken = taken.select(*[F.col(c).alias(f"t_{c}") for c in key], "taken")
    same = (F.col("skey") == F.col("t_skey")) & (F.col("size_before") == F.col("t_size_before")) & \
        F.col("doc_id").eqNullSafe(F.col("t_doc_id")) & (F.col("size") == F.col("t_size"))
    kept = [c for c in d.columns if c not in ("okey", "skey", "size_before", "doc_id", "source", "size", "source_size", "target")]
    out = d.join(taken, same, "left").select(
        "doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *kept)
    return out, pieces


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents as often as the mix takes them (words taken / size, rounded: 0, 1 or 2 rows)."""
    sha = F.sha2(docs["text"].cast("binary"), 256)  # documents may share an id, or have none
    taken, _ = mixed(docs, (5, 2, 1), 1.5, 2, 1024, "", sha.alias("sha"))
    copies = (taken.filter("taken > 0").groupBy(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"),
                                                F.col("sha").alias("mix_sha"))
              .agg(F.max(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("mix_copies"))
              .filter("mix_copies > 0"))
    out = docs.join(copies, docs["doc_id"].eqNullSafe(copies["mix_id"]) & docs["source"].eqNullSafe(copies["mix_source"])
                    & (sha == copies["mix_sha"]))
    each = F.explode(F.sequence(F.lit(1), copies["mix_copies"]))
    return out.select(*[docs[c] for c in docs.columns], each.alias("mix_" + "_".join(docs.columns))).toDF(
        *docs.columns, "mix_" + "_".join(docs.columns)).select(*docs.columns)
