"""Readers on small files shaped like harness / trainer output (own fixtures)."""
from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import functions as F

from lexicount.functions.columns import milestone_name, revision_to_int, task_lang
from lexicount.operators import scores as S
from lexicount.sinks import writers as K
from lexicount.sources import evals as E


def _tmp():
    return tempfile.mkdtemp(prefix="lexicount-test-", dir="/tmp")


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_eval_results_latest_wins_and_top_tasks(spark):
    root = _tmp()
    a = {"results": {"zeroshot_eng": {"alias": "zeroshot_eng", "acc,none": 0.5, "acc_stderr,none": 0.01},
                     "blimp_eng": {"alias": " - blimp_eng", "acc,none": 0.6, "acc_stderr,none": None},
                     "blimp_eng_p1": {"alias": "  - blimp_eng_p1", "acc,none": 0.7, "acc_stderr,none": 0.02},
                     "no_acc": {"alias": " - no_acc"}}}
    b = {"results": {"blimp_eng": {"alias": " - blimp_eng", "acc,none": 0.65, "acc_stderr,none": 0.03}}}
    _write(f"{root}/chck_10M/org__m/results_2024-01-01.json", json.dumps(a))
    _write(f"{root}/chck_10M/org__m/results_2024-01-02.json", json.dumps(b))
    _write(f"{root}/chck_2M/org__m/results_x.json", json.dumps(a))
    rows = E.merge_latest(E.eval_results(spark, root, "org/m"))
    curve = S.keep_top_tasks(rows)
    got = {(r.revision, r.task): (r.acc, r.stderr, r.indent, r.is_group, r.lang, r.rev_m) for r in curve.collect()}
    assert got[("chck_10M", "blimp_eng")] == (0.65, 0.03, 1, False, "eng", 10)
    assert got[("chck_2M", "blimp_eng")][1] == 0.0       # NULL stderr -> 0
    assert ("chck_10M", "blimp_eng_p1") not in got       # depth 2 dropped
    assert ("chck_10M", "no_acc") not in got             # no accuracy
    ordered = [r.rev_m for r in S.order_curve(curve).collect()]
    assert ordered == sorted(ordered)
    out = f"{_tmp()}/curve"
    K.write_curve(curve.withColumn("model_key", F.lit("m")), out)
    txt = open([os.path.join(out, f) for f in os.listdir(out) if f.endswith(".csv")][0]).read()
    assert txt.splitlines()[0] == "revision,rev_M,task,lang,indent,is_group,acc,stderr"
    assert "chck_2M,2,blimp_eng,eng,1,False,0.6,0.0" in txt.splitlines()
    empty = f"{_tmp()}/empty"
    K.write_curve(curve.filter("false"), empty)
    files = [f for f in os.listdir(empty) if f.endswith(".csv")]
    assert all(open(os.path.join(empty, f)).read() == "" for f in files)


def test_column_rules(spark):
    df = spark.createDataFrame([(t,) for t in ["blimp_nl", "xcomps_zh", "zhoblimp", "arc_challenge",
                                              "zeroshot_nld", "blimp_filtered"]], "task string")
    got = {r.task: r.lang for r in df.select("task", task_lang(F.col("task")).alias("lang")).collect()}
    assert got == {"blimp_nl": None, "xcomps_zh": None, "zhoblimp": "zho", "arc_challenge": "eng",
                   "zeroshot_nld": "nld", "blimp_filtered": None}
    r = spark.createDataFrame([("chck_10M",), ("main",), ("chck_1M_x",)], "rev string").select(
        revision_to_int("rev").alias("n")).collect()
    assert [x.n for x in r] == [10, -1, -1]
    m = spark.createDataFrame([(10_000,), (100_000,), (1_000_001,)], "m long").select(
        milestone_name("m").alias("n")).collect()
    assert [x.n for x in m] == ["chck_1M", "chck_1M", "chck_2M"]


def test_train_log_and_job_log(spark):
    lines = spark.createDataFrame([(x,) for x in [
        "[step    100/7550] loss=5.1234  lr=4.99e-04  ref_tok=1,234,567  frac=0.012  tok/s=98,750",
        "[checkpoint] saving chck_1M at 1,000,123 ref tokens",
        "some unrelated line",
        "[gpu0] en/arc START -> logs/finetune_en_arc.log",
        "[gpu0] en/arc END rc=0 dt=61s",
        "[gpu1] zh/include START -> logs/finetune_zh_include.log",
    ]], "line string")
    st = E.train_log_steps(lines).collect()
    assert len(st) == 1 and st[0].step == 100 and st[0].ref_tokens == 1_234_567 and st[0].tok_s == 98_750
    ck = E.train_log_checkpoints(lines).collect()
    assert (ck[0].revision, ck[0].ref_tokens_at_save) == ("chck_1M", 1_000_123)
    jobs = {(r.lang, r.task): r for r in E.job_log(lines).collect()}
    assert jobs[("en", "arc")].rc == 0 and jobs[("en", "arc")].dt == 61 and jobs[("en", "arc")].finished
    assert jobs[("zh", "include")].rc is None and not jobs[("zh", "include")].finished
    summ = S.job_summary(E.job_log(lines)).collect()[0]
    assert (summ.succeeded, summ.total, summ.all_ok) == (1, 2, False)


def test_score_table_recovery(spark):
    text = """|    Tasks     |Version|Filter|n-shot| Metric |   |Value |   |Stderr|
|--------------|------:|------|-----:|--------|---|-----:|---|-----:|
|zeroshot_eng  |      1|none  |     0|acc     |↑  |0.5766|±  |0.0040|
| - arc_easy   |      1|none  |     0|acc     |↑  |0.4200|±  |0.0101|
|              |       |none  |     0|acc_norm|↑  |0.3900|±  |0.0100|
|  - sub_one   |      1|none  |     0|acc     |↑  |0.5000|±  |   N/A|"""
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(text.splitlines())], "line_no int, line string") \
        .withColumn("file", F.lit("f"))
    got = [(r.task, r.depth, r.metric, r.value, r.stderr) for r in
           E.score_tables(lines).orderBy("task", "metric").collect()]
    assert ("arc_easy", 1, "acc_norm", 0.39, 0.01) in got
    assert ("zeroshot_eng", 0, "acc", 0.5766, 0.004) in got
    assert ("sub_one", 2, "acc", 0.5, None) in got


def test_cards_and_finetune(spark):
    card = """### Dataset Summary

- **Total Tokens:** 98,878,321

### Tokens Per Category

- **child-books:** 26,748,028 tokens
- **padding-wikipedia:** 1,006,936 tokens

### Tokens Per Group

- **Transcription:** 36,814,704 tokens
"""
    cards = spark.createDataFrame([("eng", card)], "lang string, card string")
    assert E.card_totals(cards).collect()[0].total_tokens == 98_878_321
    cats = {r.category: r.tokens for r in E.card_categories(cards).collect()}
    assert cats == {"child-books": 26_748_028, "padding-wikipedia": 1_006_936}
    root = _tmp()
    _write(f"{root}/finetune/en/arc/eval_results.json", json.dumps(
        {"epoch": 10.0, "eval_accuracy": 0.25, "eval_loss": 1.4, "eval_runtime": 3.2, "eval_samples": 100,
         "eval_samples_per_second": 31.0, "eval_steps_per_second": 1.0}))
    ft = E.finetune_results(spark, root).collect()[0]
    assert (ft.lang, ft.task, ft.accuracy, ft.samples) == ("en", "arc", 0.25, 100)


def test_averages_and_coverage(spark):
    rows = [("m1", "r", "eng", "a_eng", 0.5), ("m1", "r", "eng", "b_eng", 0.7), ("m1", "r", "nld", "a_nld", 0.4),
            ("m2", "r", "eng", "a_eng", 0.9)]
    sc = spark.createDataFrame(rows, "model_key string, revision string, lang string, task string, acc double")
    exp = {"eng": ["a_eng", "b_eng"], "nld": ["a_nld"], "zho": ["a_zho"]}
    la = S.language_average(sc, exp)
    got = {(r.model_key, r.lang): r.lang_avg for r in la.collect()}
    assert got[("m2", "eng")] == 0.45 and got[("m1", "zho")] == 0.0
    ma = {r.model_key: r.multilingual_avg for r in S.multilingual_average(la, ["eng", "nld", "zho"]).collect()}
    assert abs(ma["m1"] - (0.6 + 0.4 + 0.0) / 3) < 1e-12
    miss = {(r.model_key, r.task) for r in S.missing_cells(sc, exp).collect()}
    assert ("m2", "b_eng") in miss and ("m1", "a_zho") in miss and ("m1", "a_eng") not in miss
    lb = {r.model_key: r.rank for r in S.leaderboard(
        spark.createDataFrame([("m1", 0.3), ("m2", 0.5)], "model_key string, multilingual_avg double")).collect()}
    assert lb == {"m2": 1, "m1": 2}


def test_corpus_scan_and_writers(spark):
    from lexicount.operators import tokenizer
    from lexicount.sources.corpus import corpus_scan
    root = _tmp()
    spark.createDataFrame([("a", "x y", "cat1", 2)], "`doc-id` string, text string, category string, `num-tokens` long") \
        .write.parquet(f"{root}/eng")
    spark.createDataFrame([("b", "z", "cat2")], "`doc-id` string, text string, category string") \
        .write.parquet(f"{root}/nld")
    df = corpus_scan(spark, {"eng": f"{root}/eng", "nld": f"{root}/nld"})
    got = sorted((r.lang, r.doc_id, r.num_tokens) for r in df.collect())
    assert got == [("eng", "a", 2), ("nld", "b", None)]
    av = spark.createDataFrame([("eng", 10), ("nld", 5)], "lang string, available long")
    assert json.loads(K.availability_json(av).collect()[0].json) == {"eng": 10, "nld": 5}
    vocab, merges = tokenizer.vocab_table(spark, [(0, 104, 105, 7)])
    K.write_vocab(vocab, merges, f"{root}/tok")
    assert spark.read.parquet(f"{root}/tok/merges").count() == 1
    assert spark.read.parquet(f"{root}/tok/vocab").count() == 4 + 256 + 1


def test_json_documents_and_text_readers(spark, tmp_path):
    from pyspark.errors import PySparkException
    from lexicount.sinks.writers import write_json
    from lexicount.sources import evals
    docs = spark.createDataFrame([("eng", '{"a":1}'), ("nld", '{"b":2}')], "lang string, json string")
    write_json(docs, str(tmp_path / "json"))
    assert sorted(map(tuple, spark.read.text(str(tmp_path / "json")).collect())) == [('{"a":1}', "eng"), ('{"b":2}', "nld")]
    (tmp_path / "a.log").write_text("one\ntwo\n")
    (tmp_path / "b.log").write_text("three")
    got = {(r.file.rsplit("/", 1)[1], r.line_no, r.line) for r in evals.log_lines(spark, str(tmp_path / "*.log")).collect()}
    assert {("a.log", 0, "one"), ("a.log", 1, "two"), ("b.log", 0, "three")} <= got
    (tmp_path / "card.md").write_text("**Total Tokens:** 1,234\n### Tokens Per Category\n- **books:** 1,000 tokens (81%)\n"
                                      "- **wiki:** 234 tokens\n### Tokens Per Group\n- **other:** 9 tokens\n")
    cards = evals.card_files(spark, {"eng": str(tmp_path / "card.md")})
    assert evals.card_totals(cards).first().total_tokens == 1234
    got = {(r.category, r.tokens) for r in evals.card_categories(cards).collect()}
    assert got == {("wiki", 234), ("books", 1000)}
    import pytest
    with pytest.raises(PySparkException):
        evals.card_categories(spark.createDataFrame([("x", "no section")], "lang string, card string")).collect()


def test_one_log_is_read_by_several_tasks(spark, tmp_path):
    """Line numbers of logs cut into blocks equal those of the whole text; so do tables parsed across the cuts."""
    from lexicount.sources import evals
    lines = [f"line {i} " + "x" * (i % 37) + ("\r" if i % 5 == 0 else "") for i in range(4000)]
    lines[1999:2003] = ["=== part two ===", "|Tasks|Version|Filter|n-shot|Metric|   |Value|   |Stderr|",
                        "|a_eng|1|none|0|acc|↑|0.5|±|0.1|", "||1|none|0|acc_norm|↑|0.25|±|0.2|"]
    (tmp_path / "long.log").write_bytes("\n".join(lines).encode())
    (tmp_path / "short.log").write_bytes(b"one\n\nthree\n")
    (tmp_path / "empty.log").write_bytes(b"")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = evals.log_lines(spark, str(tmp_path / "*.log"))
        assert got.rdd.getNumPartitions() > 10
        by_file = {}
        for r in sorted(got.collect(), key=lambda r: (r.file, r.line_no)):
            by_file.setdefault(r.file.rsplit("/", 1)[1], []).append((r.line_no, r.line))
        table = evals.score_tables(got).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert by_file == {"long.log": [(i, x.removesuffix("\r")) for i, x in enumerate(lines)],
                       "short.log": [(0, "one"), (1, ""), (2, "three")]}
    assert sorted((r.title, r.section, r.task, r.metric, r.value) for r in table) == [
        ("part two", "tasks", "a_eng", "acc", 0.5), ("part two", "tasks", "a_eng", "acc_norm", 0.25)]
