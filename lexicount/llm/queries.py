"""Registered queries of this subpackage and their SQL oracles (DuckDB dialect)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.catalog import crc32_sql
from . import chat, exact, fingerprint, langid, merkle, minhash, mixing, pieces, quality, suffix, toxicity, trie, vectors
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


QUERIES["op6_exact_dedup"] = op6_exact_dedup
ORACLE["op6_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = mixing.mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


QUERIES["op9_mixing"] = op9_mixing
ORACLE["op9_mixing"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
           FROM documents),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
             2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM z),
l AS (SELECT *, row_number() OVER o AS i,
             (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
t AS (SELECT source, source_size, coalesce(least(cap, weight * (SELECT min_by(level, i) FROM l WHERE level * weight < cap)),
                                           cap) AS target FROM l),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT p.doc_id, p.size, t.source_size, t.target,
       CAST(greatest(0, least(p.size, floor(t.target + 0.5) - p.before))
            + greatest(0, least(p.size, floor(t.target + 0.5) - t.source_size - p.before)) AS BIGINT) AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source"""


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.load_vocabulary(pieces.MODEL_PATH))


QUERIES["op8_sentencepiece"] = op8_sentencepiece


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


QUERIES["op2_toxicity"] = op2_toxicity


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.grade_texts(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


QUERIES["op3_quality"] = op3_quality


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), minhash.Params(shingle=2))


QUERIES["op1_minhash"] = op1_minhash
ORACLE["op1_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 1 THEN ws
             ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END)) AS g FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, other) AS (SELECT a, b FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT node, least(node, min(other)) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id,
       coalesce(m.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = w.doc_id"""


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_conversations(spark, table(spark, sf_dir, "conversations"))


QUERIES["op5_chat"] = op5_chat
ORACLE["op5_chat"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0
           FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'),
                            (-7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))
              + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) + 16 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES["op7_vectors"] = op7_vectors
ORACLE["op7_vectors"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0
    AND len(list_filter(embedding, lambda z: z <> 0)) > 0),
n AS (SELECT *, sqrt(list_dot_product(x, x)) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id < b.vec_id
      WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.93),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, other) AS (SELECT a, b FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT node, least(node, min(other)) AS component_id FROM r GROUP BY node),
c AS (SELECT a AS node, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(m.component_id, vec_id) AS component_id,
       coalesce(m.component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN m ON m.node = vec_id LEFT JOIN c ON c.node = vec_id"""


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


QUERIES["op10_language"] = op10_language


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_bytes(table(spark, sf_dir, "documents"))


QUERIES["op4_suffix"] = op4_suffix


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES["op13_fingerprints"] = op13_fingerprints


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES["op11_manifest"] = op11_manifest
ORACLE["op11_manifest"] = r"""
WITH RECURSIVE f AS (SELECT doc_id, source, text, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
    || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM documents),
d AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN CRC % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))
         END AS tampered FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM d),
t(source, h, l) AS (SELECT source, 0, list(leaf ORDER BY rank) FROM r GROUP BY source
    UNION ALL SELECT source, h + 1, list_transform(range(0, len(l), 3), lambda i: sha256(array_to_string(l[i + 1:i + 3], '')))
    FROM t WHERE len(l) > 1),
s AS (SELECT source, l[1] AS subroot, h AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spos FROM t WHERE len(l) = 1),
u(h, l) AS (SELECT 0, list(subroot ORDER BY spos) FROM s
    UNION ALL SELECT h + 1, list_transform(range(0, len(l), 3), lambda i: sha256(array_to_string(l[i + 1:i + 3], '')))
    FROM u WHERE len(l) > 1),
top AS (SELECT l[1] AS root FROM u WHERE len(l) = 1),
steps AS (
    SELECT r.source, r.rank, t.h AS step, r.rank // CAST(pow(3, t.h) AS BIGINT) AS i, t.l
    FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source WHERE len(t.l) > 1
    UNION ALL
    SELECT r.source, r.rank, 1000 + u.h, s.spos // CAST(pow(3, u.h) AS BIGINT), u.l
    FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source JOIN u ON len(u.l) > 1),
parts AS (SELECT source, rank, step, array_to_string(l[i - i % 3 + 1:i], '') AS before,
                 array_to_string(l[i + 2:i - i % 3 + 3], '') AS after FROM steps),
p AS (SELECT source, rank, string_agg(before || after, '' ORDER BY step) AS siblings,
             list({'b': before, 'a': after} ORDER BY step) AS path FROM parts GROUP BY source, rank),
w(source, rank, k, h, path) AS (SELECT r.source, r.rank, 0, coalesce(r.tampered, r.leaf), p.path
    FROM r LEFT JOIN p ON r.source IS NOT DISTINCT FROM p.source AND r.rank = p.rank
    UNION ALL SELECT source, rank, k + 1, sha256(path[k + 1].b || h || path[k + 1].a), path FROM w WHERE k < len(path))
SELECT r.doc_id, r.leaf, s.subroot, top.root, sha256(coalesce(p.siblings, '')) AS proof_sha256, w.h AS folded_root,
       w.h = top.root AS verified
FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source JOIN top ON true
LEFT JOIN p ON r.source IS NOT DISTINCT FROM p.source AND r.rank = p.rank
JOIN w ON r.source IS NOT DISTINCT FROM w.source AND r.rank = w.rank AND w.k = coalesce(len(w.path), 0)""".replace(
    "CRC", crc32_sql("CAST(doc_id AS VARCHAR)"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


QUERIES["op12_prefix_trie"] = op12_prefix_trie
ORACLE["op12_prefix_trie"] = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, strlen(r) || ':' || r || x AS body FROM t),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(body)) AS at FROM o),
c AS (SELECT conv_id AS c, count(*) AS n, CRC % 4 AS h, conv_id - conv_id % 20 AS donor FROM s GROUP BY conv_id),
k AS (SELECT a.*, least(a.h, coalesce(b.n, 0)) AS lent FROM c a LEFT JOIN c b ON a.donor = b.c),
b AS (SELECT k.c, s.at AS d, s.x, s.body FROM k JOIN s ON s.conv_id = k.donor AND s.at <= k.h
      UNION ALL SELECT k.c, k.lent + s.at - k.h, s.x, s.body FROM k JOIN s ON s.conv_id = k.c AND s.at > k.h),
p AS (SELECT c, d, len(regexp_extract_all(x, '[^ 	-
]+')) AS words,
             sha256(string_agg(strlen(body) || ':' || body, '' ) OVER (PARTITION BY c ORDER BY d)) AS key FROM b
      UNION ALL SELECT c, 0, 0, 'root' FROM c),
e AS (SELECT p.*, q.key AS up, p.d = max(p.d) OVER (PARTITION BY p.c) AS is_end FROM p LEFT JOIN p q ON q.c = p.c AND q.d = p.d - 1),
n AS (SELECT key, min(c) AS conv_id, any_value(d) AS depth, any_value(up) AS up, count(*) AS n_convs,
             (count(*) - 1) * any_value(words) AS saved,
             sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (is_end), '')) AS ends_sha256 FROM e GROUP BY key),
m AS (SELECT up AS key, count(*) AS n_children FROM n GROUP BY up),
f AS (SELECT n.*, coalesce(m.n_children, 0) AS n_children FROM n LEFT JOIN m USING (key)),
z AS (SELECT p.key, sum(f.saved) AS saved_tokens, count(*) FILTER (f.n_children = 0) AS n_leaves
      FROM f JOIN p ON p.c = f.conv_id AND p.d <= f.depth GROUP BY p.key)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, g.conv_id AS parent_conv_id, f.n_convs, f.n_children, z.n_leaves,
       CAST(z.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN z USING (key) LEFT JOIN f g ON g.key = f.up""".replace("CRC", crc32_sql("CAST(conv_id AS VARCHAR)"))
