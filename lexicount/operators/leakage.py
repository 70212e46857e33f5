"""Benchmark leakage screen (is a probe a substring of a doc?).

Candidate pairs are found on ids alone; text is fetched once for the
candidates and verified with ``instr``:

* ``leakage_hits`` (spaced text): a probe contained in a document has all its
  *interior* word n-grams (its first and last words may be cut mid-word) among
  the document's. Documents emit (id, n-gram) only for n-grams some probe has;
  each probe is looked up by its rarest one, and a probe with an n-gram that
  no document has is settled at once.
* ``leakage_hits_char`` (unspaced text, and probes without an interior
  n-gram): an automaton over the probes runs once over each text and emits
  only hits; probes are dealt into blocks of bounded size, one pass each.
* ``leakage_hits_nested``: a nested-loop join, block by block.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import WS_RUN
from ..session import cut_lineage


def _words(c):
    return F.filter(F.split(F.coalesce(c, F.lit("")), WS_RUN), lambda x: x != "")


def _word_hashes(words):
    """xxhash64 of each word (computed once per document)."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _ngram_hashes(wh, n: int, first: int = 1, last_excl_tail: int = 0):
    """Hash of every word n-gram (from the word hashes ``wh``) starting at
    1-based ``first`` and ending at least ``last_excl_tail`` words before the end."""
    hi = F.size(wh) - n + 1 - last_excl_tail
    idx = F.sequence(F.lit(first), F.greatest(hi, F.lit(first)))
    grams = F.transform(idx, lambda i: F.xxhash64(*[F.element_at(wh, i + j) for j in range(n)]))
    return F.when(hi >= first, grams).otherwise(F.array().cast("array<bigint>"))


def prepare_probes(probes: DataFrame, max_probe: int | None = None, text: str = "text",
                   probe_id: str = "item_id", set_col: str | None = None, set_name: str = "benchmark"
                   ) -> DataFrame:
    """Probe table ``(set, probe_id, probe)``; ``max_probe`` cuts probes to a
    prefix (None keeps the whole text). Empty probes are dropped."""
    p = F.col(text) if max_probe is None else F.substring(F.col(text), 1, max_probe)
    s = F.col(set_col) if set_col else F.lit(set_name)
    return (probes.select(s.alias("set"), F.col(probe_id).alias("probe_id"), p.alias("probe"))
                  .filter(F.coalesce(F.length("probe"), F.lit(0)) > 0))


def _context(before: int = 30, after: int = 30, match_cap: int = 100):
    pos = F.col("match_pos")
    start = F.greatest(pos - before, F.lit(1))
    ln = (pos - start) + F.least(F.length("probe"), F.lit(match_cap)) + after
    return F.substring(F.col("text"), start, ln)


def _finish(pairs: DataFrame, display: int) -> DataFrame:
    return pairs.select(
        "set", "probe_id", F.substring("probe", 1, display).alias("probe_head"), "doc_id", "lang",
        F.col("data_source").alias("doc_src"), F.col("category").alias("doc_cat"),
        "match_pos", _context().alias("context"))


def leakage_hits_nested(docs: DataFrame, probes: DataFrame, display: int = 80, block_chars: int = 1 << 22) -> DataFrame:
    """J02 + J03 via broadcast nested-loop joins with blocks of probes of bounded size: every pair is tested."""
    d = docs.select("doc_id", "lang", "data_source", "category", "text")
    out: DataFrame | None = None
    n = n_blocks(probes, block_chars)
    for b in range(n):
        j = d.join(F.broadcast(_block(probes, b, n)), F.instr(F.col("text"), F.col("probe")) > 0, "inner")
        hits = _finish(j.withColumn("match_pos", F.instr(F.col("text"), F.col("probe"))), display)
        out = hits if out is None else out.unionByName(hits)
    return out


_DOC = ["doc_id", "lang", "data_source", "category", "text"]


def _verified(docs: DataFrame, probes: DataFrame, cand: DataFrame, display: int) -> DataFrame:
    """Hits among candidate pairs (doc_id, probe_id, set): the texts of candidates are joined in once."""
    p = cand.join(probes.select("set", "probe_id", "probe"), ["set", "probe_id"])
    hit = docs.select(*_DOC).join(p, "doc_id").withColumn("match_pos", F.instr(F.col("text"), F.col("probe")))
    return _finish(hit.filter(F.col("match_pos") > 0), display)


def probe_grams(probes: DataFrame, ngram: int) -> tuple[DataFrame, DataFrame]:
    """((set, probe_id, _anchor) of all interior n-grams, (set, probe_id, probe) of probes that have none)."""
    pw = probes.withColumn("_w", _word_hashes(_words(F.col("probe"))))
    # interior n-grams: start at word 2, end before the last word
    pw = pw.withColumn("_anchors", F.array_distinct(_ngram_hashes(F.col("_w"), ngram, first=2, last_excl_tail=1)))
    keys = pw.filter(F.size("_anchors") > 0).select("set", "probe_id", F.explode("_anchors").alias("_anchor"))
    return keys, pw.filter(F.size("_anchors") == 0).select("set", "probe_id", "probe")


def document_grams(docs: DataFrame, keys: DataFrame, ngram: int) -> DataFrame:
    """(doc_id, _anchor) of the documents' word n-grams that some probe has; written."""
    # words are computed once per document; the n-gram lambda only indexes them
    words = docs.select("doc_id", _word_hashes(_words(F.col("text"))).alias("_dw"))
    grams = words.select("doc_id", F.explode(F.array_distinct(_ngram_hashes(F.col("_dw"), ngram))).alias("_anchor"))
    return cut_lineage(grams.join(keys.select("_anchor").distinct(), "_anchor", "left_semi"), "leakage-grams")


def _by_rarest(docs: DataFrame, probes: DataFrame, keys: DataFrame, short: DataFrame, grams: DataFrame, seen: DataFrame,
               display: int) -> DataFrame:
    """Hits through every probe's least seen n-gram, and of the probes without one."""
    rare = keys.join(seen, "_anchor", "left").groupBy("set", "probe_id").agg(
        F.min_by("_anchor", F.coalesce("_df", F.lit(0))).alias("_anchor"))
    cand = grams.join(rare, "_anchor").select("doc_id", "set", "probe_id").distinct()
    out = _verified(docs, probes, cand, display)
    if not short.isEmpty():
        out = out.unionByName(leakage_hits_char(docs, short, display=display))
    return out


def leakage_hits(docs: DataFrame, probes: DataFrame, ngram: int = 3, display: int = 80) -> DataFrame:
    """J02 + J03 by each probe's rarest interior word n-gram (see module doc). Output: set, probe_id,
    probe_head, doc_id, lang, doc_src, doc_cat, match_pos, context."""
    keys, short = probe_grams(probes, ngram)
    grams = document_grams(docs, keys, ngram)
    seen = grams.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_df"))
    return _by_rarest(docs, probes, keys, short, grams, seen, display)


@dataclass(frozen=True)
class ProbeIndex:
    """Probes and their n-grams as written tables, and the document frequencies of the batches screened so far."""

    probes: DataFrame
    keys: DataFrame
    short: DataFrame
    home: str
    ngram: int

    @classmethod
    def build(cls, probes: DataFrame, home: str, ngram: int = 3) -> ProbeIndex:
        keys, short = probe_grams(probes, ngram)
        tables = []
        for name, rows in (("probes", probes), ("grams", keys), ("short", short)):
            rows.write.mode("overwrite").parquet(f"{home}/{name}")
            tables.append(probes.sparkSession.read.parquet(f"{home}/{name}"))
        return cls(*tables, home, ngram)

    def screen(self, docs: DataFrame, batch_id: int, display: int = 80) -> DataFrame:
        """Hits of a batch; its document frequencies go into the index (replaying a batch replaces them)."""
        spark = docs.sparkSession
        grams = document_grams(docs, self.keys, self.ngram)
        (grams.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_n")).write.mode("overwrite")
              .parquet(f"{self.home}/seen/batch_id={batch_id}"))
        seen = spark.read.parquet(f"{self.home}/seen").filter(F.col("batch_id") <= batch_id)
        return _by_rarest(docs, self.probes, self.keys, self.short, grams,
                          seen.groupBy("_anchor").agg(F.sum("_n").alias("_df")), display)


def n_blocks(probes: DataFrame, block_chars: int) -> int:
    """Number of blocks of about ``block_chars`` characters that the probes fill (one at least)."""
    total = probes.agg(F.sum(F.length("probe"))).first()[0] or 0
    return max(1, -(-total // block_chars))


def _block(probes: DataFrame, b: int, n: int) -> DataFrame:
    """Block ``b`` of ``n``: equal probes share a block."""
    p = probes.select("set", "probe_id", "probe")
    return p if n == 1 else p.filter(F.pmod(F.xxhash64("probe"), F.lit(n)) == b)


def share_block(probes: DataFrame, b: int, n: int) -> tuple[Broadcast, T.StructType]:
    """The probes of a block (text -> its (set, probe_id) pairs) on every executor, and the types of set and probe_id."""
    rows = _block(probes, b, n)
    texts: dict[str, list[tuple]] = {}
    for r in rows.collect():  # a block is of bounded size
        texts.setdefault(r.probe, []).append((r.set, r.probe_id))
    return probes.sparkSession.sparkContext.broadcast(texts), rows.select("set", "probe_id").schema


@lru_cache(maxsize=2)
def _automaton(shared: Broadcast):
    """Automaton of a block, built once per Python worker."""
    import ahocorasick
    machine = ahocorasick.Automaton()
    for probe, ids in shared.value.items():
        machine.add_word(probe, (probe, ids))
    if shared.value:
        machine.make_automaton()
    return machine


def hit_schema(docs: DataFrame, ids: T.StructType) -> T.StructType:
    kinds = {f.name: f.dataType for f in docs.select("doc_id", "lang", "data_source", "category").schema}
    text = T.StringType()
    return T.StructType([
        T.StructField("set", ids["set"].dataType), T.StructField("probe_id", ids["probe_id"].dataType),
        T.StructField("probe_head", text), T.StructField("doc_id", kinds["doc_id"]), T.StructField("lang", kinds["lang"]),
        T.StructField("doc_src", kinds["data_source"]), T.StructField("doc_cat", kinds["category"]),
        T.StructField("match_pos", T.IntegerType()), T.StructField("context", text)])


def scanner(shared: Broadcast, names: Sequence[str], display: int = 80, before: int = 30, after: int = 30, match_cap: int = 100
            ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow function over (doc_id, lang, data_source, category, text): the first hit of every probe in every text."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(shared)
        for batch in batches:
            row, found = [], []
            for i, text in enumerate(batch.column(4).to_pylist()):
                if not text or not shared.value:
                    continue
                first: dict[str, tuple[int, list[tuple]]] = {}
                for end, (probe, ids) in machine.iter(text):
                    if probe not in first:
                        first[probe] = (end - len(probe) + 2, ids)
                for probe, (pos, ids) in first.items():
                    start = max(pos - before, 1)
                    context = text[start - 1:pos - 1 + min(len(probe), match_cap) + after]
                    row += [i] * len(ids)
                    found += [(s, p, probe[:display], pos, context) for s, p in ids]
            at = pa.array(row, pa.int64())
            doc_id, lang, source, category = (batch.column(c).take(at) for c in range(4))
            s, p, head, pos, context = ([f[i] for f in found] for i in range(5))
            yield pa.RecordBatch.from_arrays(
                [pa.array(s), pa.array(p), pa.array(head, pa.string()), doc_id, lang, source, category,
                 pa.array(pos, pa.int32()), pa.array(context, pa.string())], names=list(names)) if found else _none(batch, names)
    return scan


def _none(batch: pa.RecordBatch, names: Sequence[str]) -> pa.RecordBatch:
    empty = pa.array([], pa.string())
    cols = [empty, empty, empty, *(batch.column(c).slice(0, 0) for c in range(4)), pa.array([], pa.int32()), empty]
    return pa.RecordBatch.from_arrays(cols, names=list(names))


def leakage_hits_char(docs: DataFrame, probes: DataFrame, display: int = 80, block_chars: int = 1 << 22) -> DataFrame:
    """J02 + J03 for text without word separators (e.g. Chinese) and for probes of any length.

    An Aho-Corasick automaton over a block of probes (about ``block_chars``
    characters, a bounded broadcast) reads every text once and emits hits
    only, context included: nothing is shuffled. The texts are read once for
    every block.
    """
    n = n_blocks(probes, block_chars)
    out: DataFrame | None = None
    for b in range(n):
        shared, ids = share_block(probes, b, n)
        schema = hit_schema(docs, ids)
        hits = docs.select(*_DOC).mapInArrow(scanner(shared, schema.names, display), schema)
        out = hits if out is None else out.unionByName(hits)
    return out


def leakage_summary(hits: DataFrame, probes: DataFrame, n_examples: int = 3) -> DataFrame:
    """Per set: probes screened, probes hit, (probe, doc) pairs and the
    first examples (by probe_id, doc_id). Sets without hits get zeros."""
    p = probes.groupBy("set").agg(F.count_distinct("probe_id").alias("probes"))
    h = hits.groupBy("set").agg(F.count_distinct("probe_id").alias("hits_total"),
                                F.count(F.lit(1)).alias("hit_pairs"))
    w = Window.partitionBy("set").orderBy("probe_id", "doc_id")
    ex = (hits.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n_examples)
              .groupBy("set").agg(F.sort_array(F.collect_list(F.struct(
                  F.col("_rn").alias("n"), F.col("probe_head").alias("probe"),
                  F.col("doc_src"), F.col("doc_cat"), F.col("context")))).alias("examples")))
    out = p.join(h, "set", "left").join(ex, "set", "left")
    return out.select("set", "probes", F.coalesce("hits_total", F.lit(0)).alias("hits_total"),
                      F.coalesce("hit_pairs", F.lit(0)).alias("hit_pairs"),
                      F.coalesce("examples", F.array()).alias("examples"))
