"""Budget core: weights, schedules, category filters, availability, caps.

Weights, schedules, premiums and whitelists are parameters (a handful of
values); they travel as literal columns or tiny broadcast tables. Document
data is never collected.
"""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import key_bucket, map_literal, order_key, token_count
from .prefix_sum import running_sums


# ---------------------------------------------------------------------------
# Weights and schedules
# ---------------------------------------------------------------------------

def normalize(weights: Mapping[str, float]) -> dict[str, float]:
    """M01 on a parameter dict: shares of the positive weights (fsum, so the
    order of the keys does not matter); zero weights fall out, a negative or
    missing total is a parameter error."""
    used = {key: float(w) for key, w in weights.items() if w}
    wrong = sorted(key for key, w in used.items() if not w > 0)
    if wrong or not used:
        raise ValueError(f"no mixture can be dealt from {sorted(weights)}: "
                         + (f"weights below zero for {wrong}" if wrong else "every weight is zero"))
    whole = math.fsum(used.values())
    return {key: w / whole for key, w in used.items()}


def normalize_weights(df: DataFrame, by: Sequence[str] = (), key: str = "lang",
                      weight: str = "weight") -> DataFrame:
    """M01 on a weights table ``(by..., key, weight)``: zeros dropped, each group
    divided by its sum; a group whose sum is <= 0 raises at run time."""
    w = Window.partitionBy(*by)
    total = F.sum(weight).over(w)
    out = df.withColumn("_total", total)
    out = out.withColumn("_ok", F.when(F.col("_total") > 0, F.lit(True))
                         .otherwise(F.raise_error(F.lit("a group of mixture weights adds up to nothing"))))
    return (out.filter(F.col("_ok") & (F.col(weight) > 0))
               .withColumn(weight, F.col(weight) / F.col("_total")).drop("_total", "_ok"))


def validate_schedule(schedule: Sequence[tuple[float, Mapping[str, float]]]) -> list:
    fr = [f for f, _ in schedule]
    if len(set(fr)) != len(fr):
        raise ValueError(f"schedule fractions must be unique, got {fr}")
    return sorted(((float(f), normalize(w)) for f, w in schedule), key=lambda x: x[0])


def stage_table(spark: SparkSession, schedule: Sequence[tuple[float, Mapping[str, float]]],
                key: str = "lang") -> DataFrame:
    """Schedule as ``(stage, frac_lo, frac_hi, key, weight)`` with normalised
    weights; the first stage starts at -inf and the last ends at +inf, so
    fractions before the first / after the last map to the first / last stage."""
    pts = validate_schedule(schedule)
    rows = []
    for i, (f, w) in enumerate(pts):
        lo = float("-inf") if i == 0 else f
        hi = pts[i + 1][0] if i + 1 < len(pts) else float("inf")
        rows += [(i, lo, hi, k, v) for k, v in w.items()]
    return spark.createDataFrame(rows, f"stage int, frac_lo double, frac_hi double, {key} string, weight double")


def weights_at(fractions: DataFrame, schedule_df: DataFrame, frac: str = "frac_done") -> DataFrame:
    """Weights active at each progress fraction (range join on the
    tiny, broadcast stage table: ``frac_lo <= f < frac_hi``)."""
    s = F.broadcast(schedule_df)
    cond = (F.col(frac) >= s["frac_lo"]) & (F.col(frac) < s["frac_hi"])
    return fractions.join(s, cond, "inner").drop("frac_lo", "frac_hi")


# ---------------------------------------------------------------------------
# P01 / P02 / J01 / P05 / A12
# ---------------------------------------------------------------------------

def whitelist_predicate(whitelist: Mapping[str, Sequence[str] | None], lang: str = "lang",
                        category: str = "category") -> Column:
    """P01 as a pushed-down predicate. A language with no list keeps
    everything; an empty list keeps nothing."""
    listed = {k: list(v) for k, v in whitelist.items() if v is not None}
    if not listed:
        return F.lit(True)
    pred = ~F.col(lang).isin(list(listed))
    for lg, cats in listed.items():
        sel = (F.col(lang) == lg) & F.col(category).isin(cats) if cats else F.lit(False)
        pred = pred | sel
    return pred


def filter_categories(df: DataFrame, whitelist: Mapping[str, Sequence[str] | None]) -> DataFrame:
    """Category whitelist per language (filter reaches the Parquet scan)."""
    return df.filter(whitelist_predicate(whitelist))


def unknown_categories(df: DataFrame, whitelist: Mapping[str, Sequence[str] | None]) -> DataFrame:
    """Whitelisted (lang, category) pairs that do not occur in the
    corpus (anti join against the distinct pairs)."""
    spark = df.sparkSession
    pairs = [(lg, c) for lg, cats in whitelist.items() if cats for c in cats]
    wl = spark.createDataFrame(pairs, "lang string, category string")
    known = df.select("lang", "category").distinct()
    return wl.join(known, ["lang", "category"], "left_anti")


def validate_whitelist(df: DataFrame, whitelist: Mapping[str, Sequence[str] | None]) -> None:
    """Raise when a whitelist names unknown categories; the message lists
    the known ones (both lists are bounded by the whitelist / category count)."""
    bad = unknown_categories(df, whitelist).collect()
    if bad:
        langs = sorted({r.lang for r in bad})
        known = {lg: sorted(r.category for r in df.filter(F.col("lang") == lg)
                            .select("category").distinct().collect()) for lg in langs}
        lines = [f"{r.lang}: no category {r.category!r} (there are {', '.join(map(str, known[r.lang]))})" for r in bad]
        raise ValueError("whitelist does not fit the corpus; " + "; ".join(lines))


def with_premium(df: DataFrame, premium: Mapping[str, float], lang: str = "lang") -> DataFrame:
    """Premium lookup per language; an unknown language raises at run time.
    The premium table is a parameter, so the lookup is a literal map (no join)."""
    p = F.element_at(map_literal(premium, "double"), F.col(lang))
    checked = F.when(p.isNotNull(), p).otherwise(
        F.raise_error(F.concat(F.lit("no byte premium for language "), F.col(lang).cast("string"))))
    return df.withColumn("premium", checked)


def with_ref_tokens(df: DataFrame, premium: Mapping[str, float], raw: str = "num_tokens",
                    lang: str = "lang") -> DataFrame:
    """P04 + J01 + P05: ``ref_tokens = floor(coalesce(raw, 0) / premium[lang])``."""
    d = with_premium(df, premium, lang)
    return d.withColumn("ref_tokens", F.floor(token_count(raw) / F.col("premium")).cast("long")).drop("premium")


def available_ref_tokens(df: DataFrame, premium: Mapping[str, float],
                         whitelist: Mapping[str, Sequence[str] | None] | None = None,
                         raw: str = "num_tokens") -> DataFrame:
    """Available reference tokens per language = floor(Σ raw / premium),
    Σ over whitelisted categories when the list is non-empty, else all.
    (Truncates once per language; an empty list means "all" here.)"""
    wl = {k: v for k, v in (whitelist or {}).items() if v}
    d = df.filter(whitelist_predicate(wl)) if wl else df
    agg = d.groupBy("lang").agg(F.sum(token_count(raw)).cast("long").alias("raw_tokens"))
    agg = with_premium(agg, premium)
    return agg.select("lang", "raw_tokens",
                      F.floor(F.col("raw_tokens") / F.col("premium")).cast("long").alias("available"))


def available_from_cards(totals: DataFrame, categories: DataFrame, premium: Mapping[str, float],
                         whitelist: Mapping[str, Sequence[str] | None] | None = None) -> DataFrame:
    """A12 from dataset cards (S02 totals, S03 categories): a language with a
    non-empty whitelist sums its listed categories, others use the card
    total; available = floor(raw / premium). A listed category that the card
    does not have raises at run time."""
    spark = totals.sparkSession
    wl = {k: list(v) for k, v in (whitelist or {}).items() if v}
    pairs = [(lg, c) for lg, cats in wl.items() for c in cats]
    listed = spark.createDataFrame(pairs or [("", "")], "lang string, category string").filter(F.col("lang") != "")
    j = listed.join(categories.select("lang", "category", "tokens"), ["lang", "category"], "left")
    j = j.withColumn("tokens", F.when(F.col("tokens").isNotNull(), F.col("tokens")).otherwise(F.raise_error(
        F.concat(F.lit("unknown category "), F.col("category"), F.lit(" for "), F.col("lang")))))
    filtered = j.groupBy("lang").agg(F.sum("tokens").cast("long").alias("raw_tokens"))
    whole = totals.filter(~F.col("lang").isin(list(wl) or [""])).select(
        "lang", F.col("total_tokens").alias("raw_tokens"))
    raw = with_premium(filtered.unionByName(whole), premium)
    return raw.select("lang", "raw_tokens", F.floor(F.col("raw_tokens") / F.col("premium")).cast("long").alias("available"))


# ---------------------------------------------------------------------------
# J08 / W02 / W03 / W01 / L04 / M03 / A13 / W06
# ---------------------------------------------------------------------------

def replicate_epochs(df: DataFrame, epochs: int | Column | Mapping[str, int], lang: str = "lang") -> DataFrame:
    """One row per (document, epoch). ``epochs`` may differ per language
    (a dict), so only the epochs a plan can reach are generated."""
    if isinstance(epochs, Mapping):
        n = F.element_at(map_literal({k: int(v) for k, v in epochs.items()}, "int"), F.col(lang))
    elif isinstance(epochs, int):
        n = F.lit(epochs)
    else:
        n = epochs
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), n - 1)))


def epoch_order(df: DataFrame, seed: int, epoch: str = "epoch", doc_id: str = "doc_id") -> DataFrame:
    """Seeded per-epoch shuffle key (deterministic, partition independent)."""
    return df.withColumn("order_key", order_key(seed, epoch, doc_id))


def char_budget_sample(df: DataFrame, chars: int, seed: int, by: Sequence[str] = ("lang",)) -> DataFrame:
    """W03 + P03 (T01 when unioned over languages): per group, shuffled
    non-empty documents until Σ chars >= target, the crossing document kept.
    Only ids, keys and lengths are ordered and summed (two-level, bucketed by
    the hash key, buckets past the target dropped before they are sorted);
    texts are joined to the chosen ids. ``by`` + ``doc_id`` name a document."""
    d = df.filter(F.coalesce(F.col("text"), F.lit("")) != "")
    key = [*by, "doc_id"]
    narrow = d.select(*key, order_key(seed, F.lit(0), "doc_id").alias("order_key"),
                      F.length("text").cast("long").alias("n_chars"))
    picked = running_sums(narrow, ["n_chars"], order=["order_key", "doc_id"],
                          bucket=key_bucket("order_key", 3), partition=by).filter(F.col("n_chars_before") < chars)
    return d.drop("order_key", "n_chars", "n_chars_before").join(picked, key)


def running_consumption(seq: DataFrame, total_budget: int, key: str = "lang", order: str = "draw",
                        bucket_rows: int = 1 << 16) -> DataFrame:
    """Inclusive running reference-token total per key and overall along
    the draw order, and ``frac_done`` = total / total_budget. A plan from
    ``mix_plan`` already carries the exclusive sums; other sequences get them
    from two-level prefix sums (buckets of ``bucket_rows`` draws)."""
    d = seq
    if "lang_before" not in d.columns or "total_before" not in d.columns:
        b = F.floor(F.col(order) / F.lit(bucket_rows))
        d = running_sums(d, ["ref_tokens"], order=[order], bucket=b, partition=[key], suffix="_lang_before")
        d = d.withColumnRenamed("ref_tokens_lang_before", "lang_before")
        d = running_sums(d, ["ref_tokens"], order=[order], bucket=b, suffix="_total_before")
        d = d.withColumnRenamed("ref_tokens_total_before", "total_before")
    return d.withColumns({
        "lang_total": F.col("lang_before") + F.col("ref_tokens"),
        "total": F.col("total_before") + F.col("ref_tokens"),
        "frac_done": (F.col("total_before") + F.col("ref_tokens")) / F.lit(float(max(1, total_budget)))})


def budget_cut(seq: DataFrame, cap: int, before: str = "total_before") -> DataFrame:
    """Keep rows drawn while the running total was below ``cap`` (the
    check precedes the draw, so the crossing row is kept)."""
    return seq.filter(F.col(before) < F.lit(cap))


def consumption_summary(plan: DataFrame, available: DataFrame, by: str = "lang") -> DataFrame:
    """A13 / K03 input: consumed per language, epochs = consumed / max(1, available)."""
    c = plan.groupBy(by).agg(F.sum("ref_tokens").cast("long").alias("consumed"),
                             F.count(F.lit(1)).alias("docs"))
    j = available.select(by, "available").join(c, by, "left").fillna(0, subset=["consumed", "docs"])
    return j.withColumn("epochs", F.col("consumed") / F.greatest(F.col("available"), F.lit(1)))


def epochs_timeline(consumption: DataFrame, available: Mapping[str, int], lang: str = "lang") -> DataFrame:
    """Epochs seen per language at every plan row (running total / available)."""
    a = F.element_at(map_literal({k: int(v) for k, v in available.items()}, "long"), F.col(lang))
    return consumption.withColumn("epochs_seen", F.col("ref_tokens_lang_total") / F.greatest(a, F.lit(1)))
