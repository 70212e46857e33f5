"""Chat formatting over reply trees (operator 5).

Messages point to the message they answer. Root-to-leaf paths come from
self-joins that double the distance they reach in every round (a thread of n
messages takes log2 n of them, over ids only), branches are ranked by score
within their tree, and each chosen path becomes one formatted conversation
with the spans of its loss mask.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

#: Template: BEGIN, then TURN role TEXT text END for each turn; every control string starts with < or [.
BEGIN, TURN, TEXT, END = "<s>", "[TURN]", "[TEXT]", "</s>"
#: Reversible escapes, in order of application; afterwards no text holds < or [.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escaped(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: str) -> str:
    for raw, safe in reversed(ESCAPES):
        text = text.replace(safe, raw)
    return text


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every node on the path from its root to each leaf, ``up`` steps above the leaf.

    ``nodes`` has tree, node, parent (unique ids; null or unknown parent: a
    root). Messages that never reach a root (cycles) are on no path.
    """
    nodes = cut(nodes.select("tree", "node", "parent"), "chat-nodes")
    ids = nodes.select(F.col("node").alias("known"))
    jump = cut(nodes.join(ids, F.col("parent") == F.col("known")).select("node", F.col("parent").alias("above")), "chat-jump")
    leaves = nodes.join(jump.select(F.col("above").alias("node")).distinct(), "node", "left_anti")
    path = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    roots = cut(nodes.join(jump.select("node"), "node", "left_anti").select(F.col("node").alias("root")), "chat-roots")
    longest = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    reach = 1
    path = cut(path, "chat-path")
    while reach < longest and not jump.isEmpty():
        up = jump.select(F.col("node").alias("from"), "above")
        more = path.join(up, F.col("node") == F.col("from")).select(
            "tree", "leaf", F.col("above").alias("node"), (F.col("up") + reach).alias("up"))
        path = cut(path.unionByName(more), "chat-path")
        jump = cut(jump.join(up.select(F.col("from"), F.col("above").alias("next")), F.col("above") == F.col("from"))
                   .select("node", F.col("next").alias("above")), "chat-jump")
        reach *= 2
    whole = path.join(roots, F.col("node") == F.col("root")).select("leaf").distinct()
    return path.join(whole, "leaf", "left_semi")


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, branch, score, formatted, spans: the best ``branches`` paths of each tree as conversations.

    ``messages``: tree, node, parent, role, text, score. A branch's score is
    the mean of its messages' scores (null counts as 0); ties go to the
    smaller leaf id. Null text or role counts as empty. ``spans`` are (start,
    length) in code points of the assistant texts inside ``formatted``. One
    conversation is one value, so its turns meet in one task. No messages
    give no rows.
    """
    messages = messages.select("tree", "node", "parent", "role", "text", "score")
    paths = leaf_paths(messages)
    scored = paths.join(messages.select("node", "score"), "node")
    rank = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    best = (scored.groupBy("tree", "leaf").agg(F.avg(F.coalesce(F.col("score"), F.lit(0.0))).alias("score"))
            .withColumn("branch", F.row_number().over(rank)).filter(F.col("branch") <= branches))
    rows = (paths.join(best.drop("tree"), "leaf").drop("tree")
            .join(messages.select("tree", "node", "role", "text"), "node"))
    role = escaped(F.coalesce(F.col("role"), F.lit("")))
    body = escaped(F.coalesce(F.col("text"), F.lit("")))
    rows = rows.withColumn("head", F.concat(F.lit(TURN), role, F.lit(TEXT))).withColumn("body", body)
    in_order = Window.partitionBy("leaf").orderBy(F.desc("up"))
    before = F.coalesce(F.sum(F.length("head") + F.length("body") + len(END)).over(
        in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", before + len(BEGIN) + F.length("head"))
    turn = F.struct((-F.col("up")).alias("pos"), F.concat("head", "body", F.lit(END)).alias("piece"),
                    F.when(F.col("role") == "assistant", F.struct(F.col("start").alias("start"),
                           F.length("body").cast("long").alias("length"))).alias("span"))
    turns = F.sort_array(F.collect_list(turn))
    out = rows.groupBy("leaf").agg(F.first("tree").alias("tree"), F.first("branch").alias("branch"),
                                   F.first("score").alias("score"), turns.alias("turns"))
    return out.select("tree", "branch", "score",
                      F.concat(F.lit(BEGIN), F.array_join(F.transform("turns", lambda t: t["piece"]), "")).alias("formatted"),
                      F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("spans"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from a formatted conversation."""
    turns = []
    for piece in formatted[len(BEGIN):].split(END)[:-1]:
        role, _, text = piece[len(TURN):].partition(TEXT)
        turns.append((unescape(role), unescape(text)))
    return turns


def read_back(formatted: DataFrame, key: str, key_type: str) -> DataFrame:
    """key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from the formatted output alone."""
    names = [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for whole, spans in zip(batch.column(1), batch.column(2), strict=True):
                whole = whole.as_py()
                turns, digest = parse(whole), hashlib.sha256()
                for role, text in turns:
                    digest.update(f"{role}\n{text}\n".encode())
                loss = "".join(unescape(whole[s["start"]:s["start"] + s["length"]]) for s in spans.as_py())
                rows.append((len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(),
                             len(whole)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    return formatted.select(key, "formatted", "spans").mapInArrow(
        run, f"{key} {key_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def threads(conversations: DataFrame) -> DataFrame:
    """Messages of plain conversations: every turn answers the one before it.

    Turns are ordered by turn (null first), then role, then text, so repeated
    turns keep a fixed order; a null conv_id is a conversation of its own.
    """
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("-"))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(tree.alias("tree"), "turn", "role", "text").withColumn("pos", F.row_number().over(order))
    node = F.concat("tree", F.lit("/"), F.col("pos").cast("string"))
    parent = F.when(F.col("pos") > 1, F.concat("tree", F.lit("/"), (F.col("pos") - 1).cast("string")))
    return rows.select("tree", node.alias("node"), parent.alias("parent"), "role", "text",
                       F.lit(None).cast("double").alias("score"))


#: A conversation whose texts hold the control strings of common templates; formatted with every table.
CONTROL = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def formatted_conversations(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """conv_id and the read-back columns of every conversation and of CONTROL; other columns are ignored."""
    more = spark.createDataFrame(CONTROL, "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(more)
    done = format_trees(cut(threads(rows), "chat-threads")).withColumn(
        "conv_id", F.when(F.col("tree") != "-", F.col("tree").cast("long")))
    return read_back(done, "conv_id", "long")
