"""Published numbers reproduced from the published dataset-card counts."""
from __future__ import annotations

import pytest

from lexicount.config import BYTE_PREMIUM
from lexicount.operators import budget
from lexicount.sources import evals as E

# Category token counts and totals as published on the dataset cards.
CARDS = {
    "eng": (98_878_321, {"child-available-speech": 9_102_166, "child-books": 26_748_028,
                         "child-directed-speech": 27_712_538, "child-wiki": 14_609_286,
                         "padding-opensubtitles": 19_699_367, "padding-wikipedia": 1_006_936}),
    "nld": (109_885_564, {"child-books": 4_576_823, "child-directed-speech": 3_304_756, "child-news": 3_177_743,
                          "child-wiki": 9_673_449, "educational": 19_146_045,
                          "padding-opensubtitles": 69_035_414, "subtitles": 971_334}),
    "zho": (137_835_046, {"child-available-speech": 7_403_441, "child-books": 15_976_688,
                          "child-directed-speech": 9_636_590, "child-wiki": 24_975, "educational": 13_465_351,
                          "subtitles": 91_328_001}),
}
# The quality-filter whitelist of the third run.
WHITELIST = {
    "eng": ["child-directed-speech", "child-books", "child-wiki", "child-available-speech"],
    "nld": ["child-directed-speech", "child-books", "child-wiki", "child-news", "subtitles", "educational"],
    "zho": ["child-directed-speech", "child-books", "child-wiki", "child-available-speech", "educational"],
}


def _cards(spark):
    rows = []
    for lang, (total, cats) in CARDS.items():
        lines = [f"- **Total Tokens:** {total:,}", "", "### Tokens Per Category", ""]
        lines += [f"- **{c}:** {n:,} tokens" for c, n in sorted(cats.items())]
        lines += ["", "### Tokens Per Group", "", "- **Transcription:** 1 tokens"]
        rows.append((lang, "\n".join(lines)))
    return spark.createDataFrame(rows, "lang string, card string")


def test_available_reference_tokens_match_published(spark):
    cards = _cards(spark)
    totals, cats = E.card_totals(cards), E.card_categories(cards)
    full = {r.lang: r.available for r in budget.available_from_cards(totals, cats, BYTE_PREMIUM).collect()}
    assert full == {"eng": 98_878_321, "nld": 104_493_093, "zho": 147_265_013}
    v3 = {r.lang: (r.raw_tokens, r.available) for r in
          budget.available_from_cards(totals, cats, BYTE_PREMIUM, WHITELIST).collect()}
    assert v3 == {"eng": (78_172_018, 78_172_018), "nld": (40_850_150, 38_845_489),
                  "zho": (46_507_045, 49_688_818)}
    # A13 with the published consumption of that run
    consumed = {"eng": 166_704_226, "nld": 166_651_832, "zho": 166_648_981}
    epochs = {k: consumed[k] / max(1, v3[k][1]) for k in consumed}
    assert epochs == pytest.approx({"eng": 2.1325306710132517, "nld": 4.2901205851727084,
                                    "zho": 3.3538527923928476}, abs=1e-12)


def test_unknown_whitelisted_category_raises(spark):
    cards = _cards(spark)
    with pytest.raises(Exception):
        budget.available_from_cards(E.card_totals(cards), E.card_categories(cards), BYTE_PREMIUM,
                                    {"eng": ["no-such-category"]}).collect()


# The per-group totals printed on the same dataset cards.
GROUPS = {
    "eng": {"Transcription": 36_814_704, "Education": 0, "Books, Wiki, News": 41_357_314,
            "Subtitles": 0, "Padding": 20_706_303},
    "nld": {"Transcription": 3_304_756, "Education": 19_146_045, "Books, Wiki, News": 17_428_015,
            "Subtitles": 971_334, "Padding": 69_035_414},
    "zho": {"Transcription": 17_040_031, "Education": 13_465_351, "Books, Wiki, News": 16_001_663,
            "Subtitles": 91_328_001, "Padding": 0},
}


def test_register_rollup_matches_published_groups(spark):
    from lexicount.operators import audit
    rows = [(lang, cat, n) for lang, (_, cats) in CARDS.items() for cat, n in cats.items()]
    df = spark.createDataFrame(rows, "lang string, category string, num_tokens long")
    got = {}
    for r in audit.register_rollup(df).collect():
        got.setdefault(r.lang, {})[r.register_group] = r.tokens
    for lang, groups in GROUPS.items():
        assert {g: got[lang][g] for g in groups} == groups
        assert got[lang]["Other"] == 0  # every published category has a group


# The third run's submitted scores (one zero-shot task renamed).
SUBMISSION = {
    "blimp_filtered": {"blimp_filtered": 0.6243006263048017},
    "hellaswag_en_mubench": {"hellaswag_en_mubench": 0.26437417072091995},
    "multiblimp_eng": {"multiblimp_eng": 0.8090909090909091},
    "winogrande_en_mubench": {"winogrande_en_mubench": 0.49381698268755153},
    "xstorycloze_en_mubench": {"xstorycloze_en_mubench": 0.49303405572755415},
    "blimp_nl": {"blimp_nl": 0.7326666666666667},
    "hellaswag_nl_mubench": {"hellaswag_nl_mubench": 0.26437417072091995},
    "multiblimp_nld": {"multiblimp_nld": 0.8953238953238953},
    "winogrande_nl_mubench": {"winogrande_nl_mubench": 0.4830997526793075},
    "xcomps_nl": {"xcomps_nl": 0.5178173719376392},
    "xstorycloze_nl_mubench": {"xstorycloze_nl_mubench": 0.4791021671826625},
    "hellaswag_zh_mubench": {"hellaswag_zh_mubench": 0.26393188854489164},
    "winogrande_zh_mubench": {"winogrande_zh_mubench": 0.5045342126957956},
    "xcomps_zh": {"xcomps_zh": 0.5260996659242761},
    "xstorycloze_zh_mubench": {"xstorycloze_zh_mubench": 0.47523219814241485},
    "zhoblimp": {"zhoblimp": 0.6493220338983051},
    "arc": {"en": 0.234375, "nl": 0.2388392835855484, "zh": 0.25},
    "belebele": {"en": 0.203125, "nl": 0.203125, "zh": 0.2265625},
    "bmlama": {"en": 0.1362847238779068, "nl": 0.1380208283662796, "zh": 0.1137152761220932},
    "mnli": {"en": 0.4722222089767456, "nl": 0.4704861044883728, "zh": 0.5063657164573669},
    "sib200": {"en": 0.6041666865348816, "nl": 0.6614583134651184, "zh": 0.7239583134651184},
    "truthfulqa": {"en": 0.25, "nl": 0.25, "zh": 0.171875},
    "xnli": {"en": 0.4702621102333069, "zh": 0.45766130089759827},
    "include": {"nl": 0.359375, "zh": 0.25},
}
# Zero-shot tasks scored per language.
ZERO_SHOT = {
    "eng": ["blimp_filtered", "multiblimp_eng", "winogrande_en_mubench", "xstorycloze_en_mubench",
            "hellaswag_en_mubench"],
    "nld": ["blimp_nl", "multiblimp_nld", "winogrande_nl_mubench", "xcomps_nl", "hellaswag_nl_mubench",
            "xstorycloze_nl_mubench"],
    "zho": ["zhoblimp", "winogrande_zh_mubench", "xcomps_zh", "hellaswag_zh_mubench", "xstorycloze_zh_mubench"],
}


def test_leaderboard_averages_match_published(spark):
    import json

    from pyspark.sql import functions as F

    from lexicount.config import EXPECTED_FINETUNE, LANG_3_TO_2
    from lexicount.functions.columns import map_literal
    from lexicount.operators import scores as S
    from lexicount.sinks import writers as K

    rows = K.read_submission(spark.createDataFrame([("v3", json.dumps(SUBMISSION))], "model_key string, json string"))
    zs_lang = {t: lg for lg, ts in ZERO_SHOT.items() for t in ts}
    to3 = {v: k for k, v in LANG_3_TO_2.items()}
    is_zs = F.col("key") == F.col("task")
    sc = rows.select(
        "model_key",
        F.when(is_zs, F.element_at(map_literal(zs_lang, "string"), F.col("task")))
         .otherwise(F.element_at(map_literal(to3, "string"), F.col("key"))).alias("lang"),
        F.when(is_zs, F.col("task")).otherwise(F.concat(F.lit("ft:"), F.col("task"))).alias("task"),
        (F.col("acc") * 100).alias("acc"))
    expected = {lg: ZERO_SHOT[lg] + [f"ft:{t}" for t in EXPECTED_FINETUNE[LANG_3_TO_2[lg]]] for lg in ZERO_SHOT}
    la = S.language_average(sc, expected)
    got = {r.lang: (round(r.lang_avg, 3), r.n_expected) for r in la.collect()}
    assert got == {"eng": (42.125, 12), "nld": (43.798, 13), "zho": (39.379, 13)}
    ma = S.multilingual_average(la, ["eng", "nld", "zho"]).collect()[0]
    assert round(ma.multilingual_avg, 3) == 41.767
