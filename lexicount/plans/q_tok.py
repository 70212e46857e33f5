"""Registered tokenizer queries."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import SPECIAL_TOKENS, WHITE_SPACE
from ..operators import budget, tokenizer
from ..session import checkpoint_dir, cut_lineage
from ..sinks import writers
from ..sources.corpus import documents_corpus
from .catalog import CORPUS_CTE, register
from .fixture import FIXTURE_PREMIUM, FIXTURE_SEED

SAMPLE_CHARS = 100_000   # per language
N_MERGES = 256         # merges of the queries that SQL repeats one by one
VOCAB_SIZE = 32_768    # the default vocabulary
UNIGRAM_SIZE = 1000    # pieces of the unigram queries, learned from all candidates


def sample(spark, d):
    return budget.char_budget_sample(documents_corpus(spark, d), SAMPLE_CHARS, FIXTURE_SEED)


@register("tokenizer_sample", f"""WITH {CORPUS_CTE},
s AS (SELECT lang, doc_id, CAST(length(text) AS BIGINT) AS n_chars,
             md5(concat_ws('|', '{FIXTURE_SEED}', '0', CAST(doc_id AS VARCHAR))) AS order_key FROM corpus
      WHERE coalesce(text, '') <> ''),
r AS (SELECT *, CAST(coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY order_key, doc_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_chars_before FROM s)
SELECT lang, doc_id, n_chars, n_chars_before FROM r WHERE n_chars_before < {SAMPLE_CHARS}""")
def q_tokenizer_sample(spark, d):
    return sample(spark, d).select("lang", "doc_id", "n_chars", "n_chars_before")


# RE2 has no lookahead: the sentinel U+E000 is put before the last whitespace
# of every run that precedes a non-space, which splits runs exactly where the
# pattern's "\s+(?!\S)" alternative does; the sentinel tokens are dropped.
RE2_PATTERN = r"""''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^WS\p{L}\p{N}]+|[WS]+""".replace("WS", WHITE_SPACE)
PRETOKEN_SQL = (r"""WITH d AS (
  SELECT regexp_replace(text, '([WS]+)([WS])([^WS])', '\1' || chr(57344) || '\2\3', 'g') AS t
  FROM documents WHERE coalesce(text, '') <> ''),
p AS (SELECT unnest(regexp_extract_all(t, 'PATTERN')) AS pretoken FROM d)
SELECT pretoken, count(*) AS count FROM p WHERE pretoken <> chr(57344) GROUP BY pretoken"""
                .replace("WS", WHITE_SPACE).replace("PATTERN", RE2_PATTERN))


@register("pretoken_counts", PRETOKEN_SQL)
def q_pretoken_counts(spark, d):
    return tokenizer.pretoken_counts(documents_corpus(spark, d))


# the sequential rule on all distinct pre-tokens: symbol i is the character 300 + i, a merge replaces two characters
_S0 = 300
BPE_SQL = f"""WITH RECURSIVE p AS ({PRETOKEN_SQL}),
w AS (SELECT pretoken AS o, count AS c, array_to_string(list_transform(range(0, strlen(pretoken)), lambda i:
             chr(('0x' || substr(hex(encode(pretoken)), CAST(2 * i + 1 AS INT), 2))::INT + {_S0 + len(SPECIAL_TOKENS)})), '') AS w
      FROM p),
t(k, o, w, c, a, b, n) AS (SELECT 0, o, w, c, 0, 0, 0::BIGINT FROM w WHERE length(w) > 1
  UNION ALL
  SELECT k + 1, o, replace(t.w, chr(best.a) || chr(best.b), chr({_S0 + len(SPECIAL_TOKENS) + 256} + k)), t.c, best.a, best.b, best.n
  FROM t, (SELECT ord(x) AS a, ord(substr(x, 2)) AS b, CAST(sum(c) AS BIGINT) AS n
           FROM (SELECT unnest(list_transform(range(1, length(w)), lambda i: substr(w, CAST(i AS INT), 2))) AS x, c FROM t)
           GROUP BY x ORDER BY sum(c) DESC, a, b LIMIT 1) best
  WHERE k < {N_MERGES})
"""


def learned(spark, d):
    """The first N_MERGES merges learned from every document."""
    counts = tokenizer.pretoken_counts(documents_corpus(spark, d))
    merges, _ = tokenizer.learn_bpe(counts, vocab_size=len(SPECIAL_TOKENS) + 256 + N_MERGES)
    return merges


@register("bpe_merges", BPE_SQL + """SELECT CAST(k - 1 AS INT) AS rank, CAST(any_value(a) - 300 AS INT) AS left,
       CAST(any_value(b) - 300 AS INT) AS right, any_value(n) AS count FROM t WHERE k > 0 GROUP BY k""")
def q_bpe_merges(spark, d):
    _, mtab = tokenizer.vocab_table(spark, learned(spark, d))
    return mtab


@register("bpe_vocab_specials", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{t}', false)" for i, t in enumerate(SPECIAL_TOKENS)) + ") v(id, token, missing)")
def q_bpe_vocab_specials(spark, d):
    """T06 / K07 on a vocabulary of the default size, learned from every document, written and read back."""
    counts = tokenizer.pretoken_counts(documents_corpus(spark, d))
    merges, _ = tokenizer.learn_bpe(counts, vocab_size=VOCAB_SIZE)
    vocab, mtab = tokenizer.vocab_table(spark, merges)
    path = f"{checkpoint_dir(spark).rstrip('/')}/vocab-{uuid.uuid4().hex[:12]}"
    writers.write_vocab(vocab, mtab, path)
    vocab = tokenizer.require_specials(spark.read.parquet(f"{path}/vocab"))
    missing = tokenizer.check_specials(vocab)
    return vocab.filter("special").join(missing.withColumn("missing", F.lit(True)), "token", "left") \
        .select("id", "token", F.coalesce("missing", F.lit(False)).alias("missing"))


_PREMIUM_ROWS = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in FIXTURE_PREMIUM.items())
# tokens of a pre-token: the characters left of its word after the last merge; a single byte is one token
FERTILITY_SQL = BPE_SQL + f""", {CORPUS_CTE},
prem(lang, x) AS (VALUES {_PREMIUM_ROWS}),
l AS (SELECT lang, unnest(regexp_extract_all(regexp_replace(text, '([WS]+)([WS])([^WS])', '\\1' || chr(57344) || '\\2\\3', 'g'),
             '{RE2_PATTERN}')) AS o FROM documents WHERE coalesce(text, '') <> ''),
f AS (SELECT o, length(w) AS m FROM t WHERE k = (SELECT max(k) FROM t)),
n AS (SELECT lang, CAST(sum(coalesce(m, 1)) AS BIGINT) AS tokenizer_tokens FROM l LEFT JOIN f USING (o) WHERE o <> chr(57344) GROUP BY lang),
r AS (SELECT lang, CAST(sum(floor(num_tokens / x)) AS BIGINT) AS reference_tokens FROM corpus JOIN prem USING (lang) GROUP BY lang)
SELECT lang, tokenizer_tokens, reference_tokens, CAST(tokenizer_tokens AS DOUBLE) / reference_tokens AS fertility FROM n JOIN r USING (lang)
""".replace("WS", WHITE_SPACE)


@register("token_fertility", FERTILITY_SQL)
def q_token_fertility(spark, d):
    docs = budget.with_ref_tokens(documents_corpus(spark, d), FIXTURE_PREMIUM)
    return tokenizer.token_fertility(tokenizer.encode(docs, learned(spark, d)))


@register("unigram_vocab")
def q_unigram_vocab(spark, d):
    """T04 on every document and from every candidate: UNIGRAM_SIZE pieces, specials included (rows-only)."""
    return tokenizer.learn_unigram(documents_corpus(spark, d), UNIGRAM_SIZE)


@register("unigram_invariants", f"""WITH w AS (SELECT DISTINCT unnest(string_split_regex(nfc_normalize(text), '[{WHITE_SPACE}]+')) AS w
  FROM documents WHERE coalesce(text, '') <> ''),
c AS (SELECT count(DISTINCT ch) AS n FROM (SELECT unnest(string_split(w, '')) AS ch FROM w WHERE w <> '') WHERE ch <> '▁')
SELECT {UNIGRAM_SIZE} AS n_pieces, {len(SPECIAL_TOKENS)} AS n_specials, n + 1 AS n_characters, 1.0::DOUBLE AS mass,
       true AS distinct_pieces, true AS unknown_is_least, (SELECT count(*) FROM documents) AS round_trips FROM c""")
def q_unigram_invariants(spark, d):
    """What must hold of a learned vocabulary, and every document read back from its pieces."""
    vocab = cut_lineage(q_unigram_vocab(spark, d), "unigram-vocab")
    plain = ~F.col("piece").isin(list(SPECIAL_TOKENS))
    facts = vocab.agg(
        F.count(F.lit(1)).cast("int").alias("n_pieces"), F.count_if(~plain).cast("int").alias("n_specials"),
        F.count_if(plain & (F.length("piece") == 1)).alias("n_characters"),
        F.round(F.sum(F.when(plain, F.exp("logprob"))), 9).alias("mass"),
        (F.count_distinct("piece") == F.count(F.lit(1))).alias("distinct_pieces"),
        (F.min(F.when(F.col("piece") == "<unk>", F.col("logprob"))) < F.min(F.when(plain, F.col("logprob")))).alias("unknown_is_least"))
    rows = [tuple(r) for r in vocab.collect()]  # the vocabulary
    words = F.array_join(F.filter(F.split(tokenizer.nfkc("text"), f"[{WHITE_SPACE}]+"), lambda w: w != ""), " ")
    docs = documents_corpus(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = tokenizer.encode(docs, tokenizer.UnigramEncoder(rows), pattern=None)
    pieces = F.array(*[F.lit(p) for _, p, _ in sorted(rows)])
    back = F.trim(F.replace(F.array_join(F.transform("ids", lambda i: F.get(pieces, i)), ""), F.lit("▁"), F.lit(" ")))
    good = ids.filter(back == words).agg(F.count(F.lit(1)).alias("round_trips"))
    return facts.withColumn("one", F.lit(1)).join(good.withColumn("one", F.lit(1)), "one").drop("one")
