"""Corpus audit: profiles, shares, top-k, duplicates, samples, order bias.

Input is a corpus DataFrame (see ``sources.corpus``). All aggregates are
two-phase (partial aggregation before the shuffle); share denominators come
from a window over the already aggregated (small) table, never from a second
scan of the corpus.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import REGISTER_GROUP_ORDER, REGISTER_GROUPS
from ..functions.columns import map_literal, text_head


def _share(num: Column, den: Column, digits: int | None) -> Column:
    s = num.cast("double") / den.cast("double")
    return F.round(s, digits) if digits is not None else s


def corpus_profile(df: DataFrame, by: Sequence[str] = ("lang",)) -> DataFrame:
    """Documents, raw tokens and characters per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.coalesce(F.col("num_tokens"), F.lit(0))).cast("long").alias("total_raw_tokens"),
        F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("total_chars"),
    )


def length_stats(df: DataFrame, by: Sequence[str] = ("lang",), exact: bool = True,
                 accuracy: int = 10000) -> DataFrame:
    """Document length (chars): integer mean, median, p95, max.

    ``exact`` uses the exact ``percentile`` (sorts each group); at scale pass
    ``exact=False`` for the bounded-memory ``percentile_approx`` sketch.
    """
    n = F.coalesce(F.length("text"), F.lit(0))
    if exact:
        med, p95 = F.percentile(n, 0.5), F.percentile(n, 0.95)
    else:
        med = F.percentile_approx(n, 0.5, accuracy).cast("double")
        p95 = F.percentile_approx(n, 0.95, accuracy).cast("double")
    return df.groupBy(*by).agg(
        F.floor(F.avg(n)).cast("long").alias("doc_chars_mean"),
        med.alias("doc_chars_median"),
        p95.alias("doc_chars_p95"),
        F.max(n).cast("long").alias("doc_chars_max"),
    )


def _dim_totals(df: DataFrame, by: Sequence[str], dim: str) -> DataFrame:
    return df.groupBy(*by, dim).agg(
        F.sum(F.coalesce(F.col("num_tokens"), F.lit(0))).cast("long").alias("tokens"),
        F.count(F.lit(1)).alias("docs"))


def token_share(df: DataFrame, by: Sequence[str] = ("lang",), dim: str = "category",
                digits: int | None = 4) -> DataFrame:
    """Tokens and token share of each ``dim`` value within ``by``."""
    t = _dim_totals(df, by, dim)
    w = Window.partitionBy(*by)
    return t.select(*by, dim, "tokens",
                    _share(F.col("tokens"), F.sum("tokens").over(w), digits).alias("token_share"))


def doc_share(df: DataFrame, by: Sequence[str] = ("lang",), dim: str = "category",
              digits: int | None = 4) -> DataFrame:
    """Documents and document share of each ``dim`` value within ``by``."""
    t = _dim_totals(df, by, dim)
    w = Window.partitionBy(*by)
    return t.select(*by, dim, "docs",
                    _share(F.col("docs"), F.sum("docs").over(w), digits).alias("doc_share"))


def top_k(df: DataFrame, by: Sequence[str], metric: str, k: int,
          tie: Sequence[str] = ()) -> DataFrame:
    """Top ``k`` rows per group by ``metric`` desc, deterministic tie-break
    on ``tie`` ascending. ``row_number <= k`` lets Spark apply a per-partition
    group limit before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.col(metric).desc(), *[F.col(c).asc() for c in tie])
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_sources(df: DataFrame, k: int = 20, by: Sequence[str] = ("lang",),
                dim: str = "data_source", digits: int | None = 4) -> DataFrame:
    """Top-k sources by tokens; the share is of the full corpus total."""
    return top_k(token_share(df, by, dim, digits), by, "tokens", k, tie=(dim,))


def top_doc_share(df: DataFrame, k: int = 10, by: Sequence[str] = ("lang",),
                  dim: str = "age_estimate", digits: int | None = 4) -> DataFrame:
    """Top-k values of ``dim`` by document share (default: age estimate)."""
    return top_k(doc_share(df, by, dim, digits), by, "docs", k, tie=(dim,))


def age_coverage(df: DataFrame, by: Sequence[str] = ("lang",), missing: str = "n/a",
                 digits: int | None = 4) -> DataFrame:
    """Labelled coverage = 1 - share of documents whose age is ``missing``."""
    miss = F.sum(F.when(F.coalesce(F.col("age_estimate"), F.lit(missing)) == missing, 1)
                 .otherwise(0))
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"), miss.alias("n_missing"))
    cov = F.lit(1.0) - F.col("n_missing").cast("double") / F.col("n_docs").cast("double")
    return out.withColumn("age_coverage", F.round(cov, digits) if digits is not None else cov)


def prefix_dup_rate(df: DataFrame, n: int | None = 300, by: Sequence[str] = ("lang",),
                    approx: bool = False, digits: int | None = 4) -> DataFrame:
    """1 - distinct(md5(first n chars)) / docs. ``n=None`` hashes the whole
    text (exact-duplicate rate). ``approx`` uses HyperLogLog instead of an exact
    distinct (bounded memory per group)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    h = F.md5(F.substring(t, 1, n) if n is not None else t)
    distinct = F.approx_count_distinct(h) if approx else F.count_distinct(h)
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"), distinct.alias("unique_hashes"))
    rate = F.lit(1.0) - F.col("unique_hashes").cast("double") / F.col("n_docs").cast("double")
    return out.withColumn("dup_rate", F.round(rate, digits) if digits is not None else rate)


def register_rollup(df: DataFrame, groups: Mapping[str, str] | None = None,
                    order: Sequence[str] = REGISTER_GROUP_ORDER,
                    by: Sequence[str] = ("lang",)) -> DataFrame:
    """J10 + A10: category -> register group, tokens per group; groups with
    zero tokens are still listed (conditional sums, then unpivot; no grid join).
    Categories outside the map land in 'Other'."""
    gmap = map_literal(groups or REGISTER_GROUPS, "string")
    g = F.coalesce(F.element_at(gmap, F.col("category")), F.lit("Other"))
    tok = F.coalesce(F.col("num_tokens"), F.lit(0))
    names = list(order) + ["Other"]
    aggs = [F.sum(F.when(g == name, tok).otherwise(0)).cast("long").alias(f"g{i}")
            for i, name in enumerate(names)]
    wide = df.groupBy(*by).agg(*aggs)
    stack = ", ".join(f"'{name}', g{i}" for i, name in enumerate(names))
    return wide.selectExpr(*by, f"stack({len(names)}, {stack}) as (register_group, tokens)")


def register_comparability(df: DataFrame, classes: Mapping[str, Column],
                           by: Sequence[str] = ("lang",), digits: int | None = 4) -> DataFrame:
    """Token share of each register class (a predicate on the row) per group."""
    tok = F.coalesce(F.col("num_tokens"), F.lit(0))
    aggs = [F.sum(tok).alias("_total")]
    aggs += [F.sum(F.when(pred, tok).otherwise(0)).alias(f"_c{i}") for i, pred in enumerate(classes.values())]
    wide = df.groupBy(*by).agg(*aggs)
    return wide.select(*by, *[_share(F.col(f"_c{i}"), F.col("_total"), digits).alias(name)
                              for i, name in enumerate(classes)])


def default_register_classes() -> dict[str, Column]:
    """Classes used by the published comparability table."""
    c = F.col("category")
    return {"child_genre_share": c.startswith("child-"),
            "subtitle_share": c.contains("subtitles"),
            "educational_share": c == "educational"}


def whitespace_ratio(df: DataFrame, by: Sequence[str] = ("lang",), field: str = "num_tokens",
                     ws: str = "ws_tokens") -> DataFrame:
    """Σ token field / Σ whitespace tokens and whitespace tokens per document."""
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.coalesce(F.col(field), F.lit(0))).cast("long").alias("raw_token_field_sum"),
        F.sum(F.col(ws)).cast("long").alias("empirical_whitespace_tokens"))
    return out.withColumns({
        "raw_to_ws_ratio": F.col("raw_token_field_sum").cast("double")
        / F.col("empirical_whitespace_tokens").cast("double"),
        "ws_per_doc_mean": F.floor(F.col("empirical_whitespace_tokens") / F.col("n_docs")).cast("long"),
    })


def prefix_sample(df: DataFrame, k: int, order: Sequence[str] = ("doc_id",),
                  by: Sequence[str] | None = None) -> DataFrame:
    """The first ``k`` rows in a stable at-rest order (per group when ``by``)."""
    if by:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")
    return df.orderBy(*order).limit(k)


def order_bias(df: DataFrame, k: int, dim: str = "category", by: Sequence[str] = ("lang",),
               order: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Document share of each ``dim`` value in the first ``k`` rows (at-rest
    order) against the whole corpus, plus the total variation distance.

    The head comes from a group-limited ``row_number`` (each map task keeps at
    most ``k`` rows per group before the shuffle); both sides are then small
    aggregates, joined on (group, dim).
    """
    head = prefix_sample(df, k, order, by)
    all_c = df.groupBy(*by, dim).agg(F.count(F.lit(1)).alias("docs_all"))
    head_c = head.groupBy(*by, dim).agg(F.count(F.lit(1)).alias("docs_head"))
    t = all_c.join(head_c, on=[*by, dim], how="left").fillna(0, subset=["docs_head"])
    wb = Window.partitionBy(*by)
    t = t.withColumns({
        "share_all": F.col("docs_all") / F.sum("docs_all").over(wb),
        "share_head": F.col("docs_head") / F.sum("docs_head").over(wb)})
    return t.withColumn(
        "tv_distance", F.sum(F.abs(F.col("share_head") - F.col("share_all"))).over(wb) / 2)


def category_samples(df: DataFrame, n: int = 2, seed: int = 12, by: Sequence[str] = ("lang",),
                     dim: str = "category", head_chars: int = 200) -> DataFrame:
    """``n`` sample documents per category, chosen by a seeded hash order.
    ``row_number <= n`` is planned with a group limit before the shuffle."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string")))
    w = Window.partitionBy(*by, dim).orderBy(key, F.col("doc_id"))
    return (df.withColumn("sample_no", F.row_number().over(w))
              .filter(F.col("sample_no") <= n)
              .select(*by, dim, "sample_no", "doc_id",
                      F.col("data_source").alias("src"), F.col("age_estimate").alias("age"),
                      F.coalesce(F.length("text"), F.lit(0)).alias("len"),
                      text_head("text", head_chars).alias("head")))


def reconcile_counts(computed: DataFrame, published: DataFrame, keys: Sequence[str],
                     value: str = "tokens") -> DataFrame:
    """Full outer join of computed and published counts with diff flags."""
    c = computed.select(*keys, F.col(value).alias("computed"))
    p = published.select(*keys, F.col(value).alias("published"))
    j = c.join(p, on=list(keys), how="full_outer")
    return j.withColumns({
        "diff": F.col("computed") - F.col("published"),
        "matches": F.col("computed").eqNullSafe(F.col("published")),
        "status": F.when(F.col("published").isNull(), "missing_in_card")
                   .when(F.col("computed").isNull(), "missing_in_corpus")
                   .when(F.col("computed") == F.col("published"), "match").otherwise("differs")})
