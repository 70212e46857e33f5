"""Registered leakage queries: benchmark items screened against documents."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import leakage
from ..sources.corpus import documents_corpus, table
from .catalog import CORPUS_CTE, register

LEAK_CTE = f"""{CORPUS_CTE},
probes AS (SELECT 'benchmark' AS set, item_id AS probe_id, text AS probe FROM benchmark
           WHERE coalesce(length(text), 0) > 0),
hits AS (SELECT p.set, p.probe_id, substring(p.probe, 1, 80) AS probe_head, c.doc_id, c.lang,
                c.data_source AS doc_src, c.category AS doc_cat,
                CAST(instr(c.text, p.probe) AS INTEGER) AS match_pos,
                substring(c.text, greatest(instr(c.text, p.probe) - 30, 1),
                          (instr(c.text, p.probe) - greatest(instr(c.text, p.probe) - 30, 1))
                          + least(length(p.probe), 100) + 30) AS context
         FROM corpus c JOIN probes p ON instr(c.text, p.probe) > 0)"""


def _inputs(spark, d):
    docs = documents_corpus(spark, d)
    probes = leakage.prepare_probes(table(spark, d, "benchmark"))
    return docs, probes


@register("leakage_hits", f"WITH {LEAK_CTE} SELECT * FROM hits")
def q_leakage_hits(spark, d):
    docs, probes = _inputs(spark, d)
    return leakage.leakage_hits(docs, probes)


@register("leakage_hits_nested", f"WITH {LEAK_CTE} SELECT * FROM hits")
def q_leakage_hits_nested(spark, d):
    docs, probes = _inputs(spark, d)
    return leakage.leakage_hits_nested(docs, probes)


@register("leakage_summary", f"""WITH {LEAK_CTE}
SELECT p.set, count(DISTINCT p.probe_id) AS probes,
       (SELECT count(DISTINCT probe_id) FROM hits) AS hits_total,
       (SELECT count(*) FROM hits) AS hit_pairs,
       (SELECT coalesce(string_agg(probe_head || '@' || doc_src || '/' || doc_cat || '/' || context, '|'
                                   ORDER BY probe_id, doc_id), '')
        FROM (SELECT * FROM hits ORDER BY probe_id, doc_id LIMIT 3)) AS examples
FROM probes p GROUP BY p.set""")
def q_leakage_summary(spark, d):
    docs, probes = _inputs(spark, d)
    out = leakage.leakage_summary(leakage.leakage_hits(docs, probes), probes)
    one = lambda e: F.concat(e["probe"], F.lit("@"), e["doc_src"], F.lit("/"), e["doc_cat"], F.lit("/"), e["context"])
    return out.withColumn("examples", F.array_join(F.transform("examples", one), "|"))


@register("leakage_hits_char", f"WITH {LEAK_CTE} SELECT * FROM hits")
def q_leakage_hits_char(spark, d):
    """The character-anchored plan (for unspaced scripts) on the same data."""
    docs, probes = _inputs(spark, d)
    return leakage.leakage_hits_char(docs, probes)
