"""Merkle manifest of a dataset (operator 11): content-addressed store, proofs by descent.

Every document is a leaf digest; the leaves of a source, by doc_id, and then
the subroots of the sources form trees of runs of three. Each level is a
written table of records digest -> children. A proof is found from the root:
requests descend by the digits of their rank, every step looks the digest up
in the level's records, takes one child and keeps the others; the kept path,
reversed, is the proof. Requests below one node travel as one row until they
part, so the upper levels, which every request passes, are small.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_order

ARITY = 3


def digest(*parts: Column) -> Column:
    """sha-256 of the concatenated parts, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def text_of(d: Column) -> Column:
    """A digest (or several in a row) as lowercase hex."""
    return F.lower(F.hex(d))


def field(c: Column) -> Column:
    """`-` for null, else byte count, colon, value (integers as decimals)."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_of(text: Column) -> Column:
    return digest(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars")), field(text))


@dataclass(frozen=True)
class Tree:
    """levels[h]: records (grp, idx, n, digest, children) of height h + 1; tops: grp, digest, height."""

    levels: list[DataFrame]
    tops: DataFrame


def grow(nodes: DataFrame, name: str) -> Tree:
    """Trees over (grp, idx, n, digest), idx 0..n-1 within each grp; one round a level for all groups at once.

    A run has at most three nodes, so no task holds more than that of a group.
    """
    levels, tops, height = [], None, 0
    while True:
        done = nodes.filter("n = 1").select("grp", "digest", F.lit(height).alias("height"))
        tops = done if tops is None else tops.unionByName(done)
        open_nodes = nodes.filter("n > 1")
        if open_nodes.isEmpty():
            return Tree(levels, cut(tops, f"{name}-tops"))
        run = F.floor(F.col("idx") / ARITY)
        made = open_nodes.groupBy("grp", run.alias("run")).agg(
            F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("kids"))
        kids = F.transform("kids", lambda k: k["digest"])
        made = made.select("grp", F.col("run").alias("idx"), F.ceil(F.col("n") / ARITY).alias("n"), kids.alias("children"))
        made = made.select("grp", "idx", "n", digest(F.array_join(F.transform("children", text_of), "")).alias("digest"),
                           "children")
        levels.append(cut(made, f"{name}-level"))
        nodes = levels[-1].select("grp", "idx", "n", "digest")
        height += 1


@dataclass(frozen=True)
class Manifest:
    """leaves: the given rows with grp and rank; sources: grp, spos, subroot, height; root: hex, one value."""

    leaves: DataFrame
    sources: DataFrame
    tree: Tree
    top: Tree
    root: str | None


def build(leaves: DataFrame) -> Manifest:
    """Manifest over rows with source, doc_id, leaf (other columns are kept with the leaves)."""
    rows = in_order(leaves, [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")],
                    "merkle-order")
    per_source = rows.groupBy("source").agg(F.min("pos").alias("grp"), F.count(F.lit(1)).alias("n"))
    sources = cut(in_order(cut(per_source, "merkle-sources"), ["grp"], "merkle-source-order")
                  .select(F.col("source").alias("of"), "grp", "n", F.col("pos").alias("spos")), "merkle-sources")
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("of")))
    rows = cut(rows.withColumn("rank", F.col("pos") - F.col("grp")).drop("pos", "of", "spos"), "merkle-leaves")
    tree = grow(rows.select("grp", F.col("rank").alias("idx"), "n", F.col("leaf").alias("digest")), "merkle-tree")
    subroots = cut(sources.select("grp", "spos").join(
        tree.tops.select("grp", F.col("digest").alias("subroot"), "height"), "grp"), "merkle-subroots")
    count = subroots.count()
    top = grow(subroots.select(F.lit(0).cast("long").alias("grp"), F.col("spos").alias("idx"),
                               F.lit(count).cast("long").alias("n"), F.col("subroot").alias("digest")), "merkle-top")
    first = top.tops.select(text_of(F.col("digest")).alias("root")).first()  # one row: there is one root
    return Manifest(rows.drop("n"), subroots, tree, top, first["root"] if first else None)


def _path_type() -> str:
    return "array<struct<before:binary,after:binary>>"


def _joined(kids: Column) -> Column:
    """The digests of an array, one after the other."""
    return F.aggregate(kids, F.lit(b"").cast("binary"), lambda a, k: F.concat(a, k))


def _segment(children: Column, digit: Column) -> Column:
    """What a step leaves unselected: the digests before and after the child."""
    digit = digit.cast("int")
    return F.struct(_joined(F.slice(children, F.lit(1), digit)).alias("before"),
                    _joined(F.slice(children, digit + 2, F.lit(ARITY))).alias("after"))


def _step(front: DataFrame, level: DataFrame) -> DataFrame:
    """One level down: every row of the frontier becomes its children, each with the others on its path."""
    keep = [c for c in front.columns if c not in ("idx", "digest", "path")]
    # equal digests have equal children: one record of each
    store = level.select(F.col("digest").alias("address"), "children").dropDuplicates(["address"])
    d = front.join(store, F.col("digest") == F.col("address"))
    d = d.select(*keep, "idx", "path", "children", F.posexplode("children").alias("digit", "child"))
    return d.select(*keep, (F.col("idx") * ARITY + F.col("digit")).alias("idx"), F.col("child").alias("digest"),
                    F.concat("path", F.array(_segment(F.col("children"), F.col("digit")))).alias("path"))


def prove(m: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """The leaves (all, or those with a (grp, rank) in ``wanted``) with subroot and their proof.

    ``proof`` is an array of (before, after) from the leaf up to the root: the
    digests left and right of the path's node in its run.
    """
    front = m.top.tops.select(F.lit(0).cast("long").alias("idx"), "digest",
                              F.array().cast(_path_type()).alias("path"))
    for level in reversed(m.top.levels):
        front = _step(front, level)
    roots = front.select(F.col("idx").alias("spos"), F.col("path")).join(m.sources, "spos")
    roots = cut(roots.select("grp", "subroot", "height", "path"), "merkle-descent")
    front = None
    leaves = m.leaves if wanted is None else m.leaves.join(wanted.select("grp", "rank"), ["grp", "rank"], "left_semi")
    parents: DataFrame | None = None
    for h in range(len(m.tree.levels), 0, -1):
        start = roots.filter(F.col("height") == h).select(
            "grp", "subroot", F.lit(0).cast("long").alias("idx"), F.col("subroot").alias("digest"), "path")
        front = start if front is None else front.unionByName(start)
        if h == 1:
            store = m.tree.levels[0].select(F.col("digest").alias("address"), "children").dropDuplicates(["address"])
            parents = front.join(store, F.col("digest") == F.col("address")).select(
                "grp", "subroot", "idx", "path", "children")
            break
        front = _step(front, m.tree.levels[h - 1])
        if wanted is not None:
            ways = leaves.select("grp", F.floor(F.col("rank") / ARITY ** (h - 1)).alias("idx")).distinct()
            front = front.join(ways, ["grp", "idx"], "left_semi")
        if h % 4 == 0:
            front = cut(front, "merkle-descent")
    lone = roots.filter("height = 0").select("grp", "subroot", F.lit(0).cast("long").alias("idx"), "path",
                                             F.lit(None).cast("array<binary>").alias("children"))
    parents = lone if parents is None else parents.unionByName(lone)
    parents = cut(parents.withColumnRenamed("idx", "run"), "merkle-parents")
    d = leaves.withColumn("run", F.floor(F.col("rank") / ARITY)).join(parents, ["grp", "run"])
    last = F.when(F.col("children").isNull(), F.array().cast(_path_type())).otherwise(
        F.array(_segment(F.col("children"), F.col("rank") % ARITY)).cast(_path_type()))
    return d.withColumn("proof", F.reverse(F.concat("path", last))).drop("run", "path", "children")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf (hex) and a proof lead to, as hex."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(
        F.concat(text_of(s["before"]), h, text_of(s["after"])).cast("binary"), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per input row.

    Null fields are hashed as `-`; a null doc_id comes first in its source and
    is never tampered with; rows that share source and doc_id follow by leaf
    digest; equal rows are separate leaves. A null source is the first
    source. An empty table gives no rows. Columns besides doc_id, source,
    lang, n_chars and text are not hashed.
    """
    d = docs.select("doc_id", "source", "lang", "n_chars", "text")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    bad = leaf_of(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    rows = cut(d.select("doc_id", "source", leaf_of(F.col("text")).alias("leaf"), F.when(changed, bad).alias("tampered")),
               "merkle-digests")
    m = build(rows)
    out = prove(m)
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(text_of(s["before"]), text_of(s["after"]))), "")
    root = F.lit(m.root).cast("string")
    out = out.select("doc_id", text_of(F.col("leaf")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"),
                     root.alias("root"), F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
                     folded(text_of(F.coalesce("tampered", "leaf")), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
