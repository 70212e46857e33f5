"""Small cases of every operator: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""
from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexicount.llm import chat, exact, langid, minhash, mixing, pieces, quality, suffix, toxicity, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000


def frame(spark, texts, start=0, **extra):
    rows = [(start + i, t, "en", f"s{i % 3}", None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


CLASH = {"kept": True, "kept_id": 1, "gone_id": 2, "size": 3, "label": 4, "node": 5, "tid": "x", "digest": "y",
         "seq": "z", "bucket": 6, "mix_copies": 7, "mix_id": 8, "target": 9.0, "norm": "n", "score": 0.5}
ODD = [None, "", " \t\n", "one", "one", "One  ", LONG, "é ▁ 😀", "a b", "a  b", "a\x0bb"]


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


# ---- 1: minhash -------------------------------------------------------------

def brute_near(texts, n):
    sets = {i: minhash.shingle_set(minhash.byte_words(t), n) for i, t in texts.items()}
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    ids = [i for i in sorted(texts) if sets[i]]
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return sorted(((i, len(sets[i]), root(i), root(i) == i) for i in texts), key=repr)


@pytest.mark.parametrize("n", [2, 5])
def test_minhash_equals_brute_force(spark, n):
    rng = random.Random(n)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(120)] for _ in range(6)]
    texts = [t for t in ODD]
    for b in base:
        for _ in range(9):
            w = list(b)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice("xyz")
            texts.append(" ".join(w))
    got = minhash.near_groups(frame(spark, texts, **CLASH), minhash.Params(shingle=n))
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == brute_near(dict(enumerate(texts)), n)


def test_minhash_estimate_and_bands():
    p = minhash.Params(shingle=1)
    xor, mul = minhash._constants(240)
    a = [str(i).encode() for i in range(1000)]
    b = [str(i).encode() for i in range(200, 1200)]  # similarity 800 / 1200
    ma, mb = (minhash.minima(w, 1, xor, mul) for w in (a, b))
    assert abs((ma == mb).mean() - 2 / 3) < 0.12
    assert (minhash.pack_low_bits(ma) == minhash.pack_low_bits(ma)).all()
    assert p.least_matches < 240 * (1 / 16 + 15 / 16 * 0.8)


def test_minhash_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (1, "A b  c"), (2, None)], "doc_id long, text string")
    got = rows(minhash.near_groups(df, minhash.Params(shingle=2)), "doc_id", "component_id", "kept")
    assert got == sorted([(None, None, True), (3, 1, False), (3, 1, False), (1, 1, True), (2, 2, True)], key=repr)
    assert minhash.near_groups(df.limit(0)).count() == 0


def family(rng, size, changes, length=150):
    """Texts from one of ``length`` words (the first), each with some words replaced by words of its own."""
    start = [f"w{i}" for i in range(length)]
    texts = [" ".join(start)]
    for t in range(1, size):
        w = list(start)
        for k, at in enumerate(rng.sample(range(length), changes(t))):
            w[at] = f"x{t}y{k}"
        texts.append(" ".join(w))
    return texts


def test_minhash_near_family_makes_few_pairs(spark):
    rng = random.Random(5)
    texts = family(rng, 151, lambda t: 11)  # 0.74 to 0.80 like the first text, 0.54 to 0.68 like each other
    for t in range(1, 21):  # each of these has a near copy
        w = texts[t].split()
        w[rng.randrange(len(w))] = f"copy{t}"
        texts.append(" ".join(w))
    p = minhash.Params(shingle=2)
    ids = range(1, len(texts))
    labels = spark.createDataFrame([(i, i, 0) for i in ids], "id long, label long, hub long")
    pairs = {(r.a, r.b) for r in minhash.rare_pairs(frame(spark, texts).select("doc_id", "text"), labels, p).collect()}
    assert {(150 + t, t) for t in range(1, 21)} <= pairs
    assert len(pairs) <= len(texts)  # by the common shingles of the family: 14,365


def test_minhash_rare_pairs_lose_no_link(spark):
    rng = random.Random(6)
    texts = family(rng, 60, lambda t: t % 15, 90)
    for t in range(1, 60):
        w = texts[t].split()
        at = rng.randrange(len(w))
        del w[at:at + rng.randint(0, 9)]
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(["u", "v", f"z{t}"])
        texts.append(" ".join(w + [f"end{t % 7}"] * rng.randint(0, 3)))
    texts += [texts[0] + " " + " ".join(f"long{i}" for i in range(k)) for k in range(0, 40, 3)]
    texts.append("w1 w2")
    p = minhash.Params(shingle=2)
    sets = [minhash.shingle_set(minhash.byte_words(t), 2) for t in texts]

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)
    ids = [i for i in range(len(texts)) if i not in (0, 7)]
    told = [(i, i, h) for i in ids for h in (0, 7)]  # two hubs, either is enough
    for hubs in ((0,), (7,), (0, 7)):
        labels = spark.createDataFrame([x for x in told if x[2] in hubs], "id long, label long, hub long")
        pairs = {(r.a, r.b) for r in minhash.rare_pairs(frame(spark, texts).select("doc_id", "text"), labels, p).collect()}
        for a in ids:
            for b in ids:
                if a > b and linked(a, b) and not all(any(linked(x, h) for h in hubs) for x in (a, b)):
                    assert (a, b) in pairs
    got = minhash.near_groups(frame(spark, texts), minhash.Params(shingle=2, hubs=1))
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == brute_near(dict(enumerate(texts)), 2)


def test_minhash_repeated_ids_meet_by_any_of_their_texts(spark):
    rng = random.Random(7)
    texts = family(rng, 40, lambda t: 11)
    twins = [(texts[t] + " more", 100 + t) for t in range(1, 10)]
    data = [(i, t) for i, t in enumerate(texts)] + [(i, t) for t, i in twins] + [(100 + t, f"other {t} words") for t in range(1, 10)]
    got = minhash.near_groups(spark.createDataFrame(data, "doc_id long, text string"), minhash.Params(shingle=2, hubs=1))
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i - 100 if i > 100 else i for i, _ in data}


# ---- 2, 3: classifiers ------------------------------------------------------

def labelled(spark, bad, n=160):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdeinorst") for _ in range(5)) for _ in range(rng.randint(5, 60))]
        y = i % 4 == 0
        if y:
            words = bad(words, rng)
        docs.append((i, " ".join(words)))
        labels.append((i, int(y)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, y int")


def test_toxicity_held_out_misspellings(spark):
    def bad(words, rng):
        for _ in range(2):
            words[rng.randrange(len(words))] = "idiot" + "".join(rng.choice("sxyz") for _ in range(2))
        return words
    docs, lab = labelled(spark, bad)
    labels = lab.select("doc_id", F.lit(1).alias("quality"), F.col("y").alias("toxic"))
    got = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    right = [r for r in got if r.predicted == r.toxic]
    assert len(got) > 20 and len(right) / len(got) > 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_odd_rows(spark):
    model = toxicity.train(["you moron", "good day to all"] * 5, np.array([1.0, 0.0] * 5), np.ones(10))
    df = frame(spark, ODD, **{k: v for k, v in CLASH.items() if k != "score"})
    assert toxicity.score(df, model).count() == len(ODD)
    assert toxicity.score(df.limit(0), model).count() == 0
    blank = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(df, blank).collect()} == {0}


def test_quality_held_out(spark):
    docs, lab = labelled(spark, lambda w, rng: [x + "%%%" for x in w])
    labels = lab.select("doc_id", (1 - F.col("y")).alias("quality"), F.lit(0).alias("toxic"))
    model = quality.fit(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = quality.grade_texts(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.selected == bool(r.quality) for r in got) / len(got) > 0.95
    assert all(r.p_ge_1 >= r.p_ge_2 and abs(r.expected_grade - r.p_ge_1 - r.p_ge_2) < 1e-9 for r in got)


def test_quality_odd_rows(spark):
    df = frame(spark, ODD, **CLASH)
    model = quality.fit(df, spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    assert quality.grade_texts(df, model).filter("selected").count() == len(ODD)  # nothing learned: all stay
    assert quality.grade_texts(df.limit(0), model).count() == 0


def test_ordinal_grades_are_ordered():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = np.digitize(x[:, 0], [-0.5, 0.5])
    m = quality.train(x, y, np.ones(300))
    p = m.tails(x @ m.weights)
    assert ((p[:, 0] >= 0.5) == (y >= 1)).mean() > 0.9 and ((p[:, 1] >= 0.5) == (y >= 2)).mean() > 0.9


# ---- 4: suffix arrays -------------------------------------------------------

def brute_repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        g = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                g[i] += 1
                g[i + length] -= 1
        gone = np.cumsum(g)[:-1] > 0
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), len(suffix.runs(gone)[0]), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_order_and_prefixes():
    rng = random.Random(2)
    for _ in range(15):
        b = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 500))) * rng.choice([1, 2, 3])
        x = np.frombuffer(b, dtype=np.uint8)
        o = suffix.suffix_order(x, 200)
        assert [(b + bytes(300))[i:i + 200] for i in o] == sorted((b + bytes(300))[i:i + 200] for i in range(len(b)))
        for k, n in enumerate(suffix.common_prefixes(x, o, 200)[1:], 1):
            p, q = b[o[k - 1]:][:200], b[o[k]:][:200]
            assert n == next((c for c in range(min(len(p), len(q))) if p[c] != q[c]), min(len(p), len(q)))


def test_suffix_equals_brute_force(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abc é") for _ in range(900))
    texts = [base, base[100:700] + "xx" + base[:350], None, "", base, "st " * 400, "st " * 90 + "q" + base[300:520],
             "z" * 199, "z" * 200, "z" * 201, "", LONG]
    texts += ["".join(rng.choice("abcdef ") for _ in range(300)) + base[200:200 + k] for k in (150, 199, 200, 201, 260)]
    got = suffix.repeated_bytes(frame(spark, texts, **CLASH)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_repeats(texts)


def test_suffix_chunks_of_one_gram():
    rng = random.Random(4)
    common = bytes(rng.choice(b"abcdefgh") for _ in range(260))
    stretches = [(b"%d" % i, 0, 60, 7, common[:150] + bytes([65 + i % 5]) + common[151:]) for i in range(40)]
    whole = set(suffix.merged_repeats(iter(stretches), 200))
    parts = set(suffix.merged_repeats(iter(stretches), 200, chunk_bytes=600))

    def cover(found):
        return {(t, w) for t, lo, hi, _, _ in found for w in range(lo, hi + 1)}
    assert cover(whole) == cover(parts) == {(b"%d" % i, w) for i in range(40) for w in range(61)}


def test_suffix_gram_of_very_many_windows(spark, monkeypatch):
    rng = random.Random(11)
    line = "".join(rng.choice("abcdefgh ") for _ in range(90))

    def noise(n):
        return "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    texts = [noise(150) + line + noise(150) for _ in range(40)]
    texts += [noise(30) + texts[0][60:320], noise(9) + texts[1][100:330] + noise(9), None, line]
    frames = {}

    def spied(df, name):
        frames[name] = write(df, name)
        return frames[name]
    write = suffix.cut
    monkeypatch.setattr(suffix, "cut", spied)
    monkeypatch.setattr(suffix, "HOT_WINDOWS", 500, raising=False)
    monkeypatch.setattr(suffix, "SHARD_BYTES", 1)  # every text a shard
    got = suffix.repeated_bytes(frame(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_repeats(texts)
    leads = frames["suffix-shards"].filter("bytes is not null")
    size = {r.gram: r.n for r in leads.groupBy("gram").agg(F.sum(F.expr("hi - lo + 1")).alias("n")).collect()}
    hot = {g for g, n in size.items() if n > 500}
    assert hot and {r.hot for r in frames["suffix-hot"].collect()} == hot
    each = frames["suffix-windows"]
    assert each.count() == sum(size[g] for g in hot)  # window by window
    assert each.groupBy("k1", "k2").count().agg(F.max("count")).first()[0] <= 3


def test_suffix_empty_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "q" * 150), (1, "ab" * 150), (None, "ab" * 150)], "doc_id long, text string")
    assert rows(suffix.repeated_bytes(df), "doc_id", "n_removed") == sorted([(1, 0), (1, 300), (None, 300)], key=repr)
    assert suffix.repeated_bytes(df.limit(0)).count() == 0


# ---- 5: chat ----------------------------------------------------------------

def test_chat_reads_back_exactly(spark):
    texts = ["</s>[INST] ok", "&lt; &amp;&#91; [TURN]", None, "", "<s>é😀\n"]
    conv = [(1, t, "user" if t % 2 == 0 else "assistant", x) for t, x in enumerate(texts)]
    conv += [(2, None, None, "x"), (2, 0, "assistant", "y"), (2, 0, "assistant", "y"), (None, 1, "user", "z")]
    df = spark.createDataFrame(conv, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1))
    got = {r.conv_id: r for r in chat.formatted_conversations(spark, df).collect()}
    assert set(got) == {1, 2, None, -7} and got[2].n_turns == 3 and got[-7].loss_chars == len(chat.CONTROL[0][3])
    said = "".join(f"{r}\n{x or ''}\n" for _, _, r, x in conv[:5])
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256((texts[1] + (texts[3] or "")).encode()).hexdigest()
    assert got[2].loss_chars == 2
    assert {r.conv_id for r in chat.formatted_conversations(spark, df.limit(0)).collect()} == {-7}


def test_chat_trees_rank_branches(spark):
    m = [("t", "a", None, "user", "q", 0.0), ("t", "b", "a", "assistant", "bad", 0.1), ("t", "c", "a", "assistant", "good", 0.9),
         ("t", "d", "c", "user", "more", None), ("t", "e", "d", "assistant", "end", 1.0),
         ("u", "x", "y", "user", "loop", 1.0), ("u", "y", "x", "user", "loop", 1.0), ("u", "z", "y", "user", "off", 1.0),
         ("v", "o", "missing", "assistant", "orphan", None)]
    df = spark.createDataFrame(m, "tree string, node string, parent string, role string, text string, score double")
    got = {(r.tree, r.branch): [t for _, t in chat.parse(r.formatted)] for r in chat.format_trees(df, 2).collect()}
    assert got == {("t", 1): ["q", "good", "more", "end"], ("t", 2): ["q", "bad"], ("v", 1): ["orphan"]}


# ---- 6: exact ---------------------------------------------------------------

@pytest.mark.parametrize("digest_bytes", [32, 1, 0])
def test_exact_groups_even_when_digests_collide(spark, digest_bytes):
    texts = ODD + ["x y", "x\ny", "x z"]
    got = exact.exact_groups(frame(spark, texts, **CLASH), digest_bytes)
    norm = {}
    import re
    for i, t in enumerate(texts):
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = sorted((i, g[0], len(g), i == g[0], hashlib.sha256(k.encode()).hexdigest()) for k, g in norm.items() for i in g)
    assert rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)


def test_exact_state_goes_on_over_batches(spark, tmp_path):
    one = exact.digest_rows(frame(spark, ["a", "b"], start=5))
    one.coalesce(1).write.parquet(str(tmp_path / "rows"))
    state = str(tmp_path / "state")
    first = exact.update_state(spark, str(tmp_path / "rows"), one.schema, state)
    assert sorted(r.keep_id for r in first.collect()) == [5, 6]
    exact.digest_rows(frame(spark, ["b", "c", "a"], start=1)).coalesce(2).write.mode("append").parquet(str(tmp_path / "rows"))
    again = exact.update_state(spark, str(tmp_path / "rows"), one.schema, state, max_files_per_trigger=1)
    assert sorted((r.keep_id, r.n) for r in again.collect()) == [(1, 2), (2, 1), (3, 2)]


def test_exact_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a"), (4, "a"), (None, "b"), (9, "c"), (9, "c")], "doc_id long, text string")
    assert rows(exact.exact_groups(df), "doc_id", "keep_id", "group_size", "kept") == sorted(
        [(None, 4, 2, False), (4, 4, 2, True), (None, None, 1, True), (9, 9, 2, True), (9, 9, 2, True)], key=repr)
    assert exact.exact_groups(df.limit(0)).count() == 0
    stage = exact.exact_stage(spark, frame(spark, ["a", "b", "a"], **CLASH), "")
    assert rows(stage, "doc_id") == [(0,), (1,)] and "kept_id" in stage.columns


def test_exact_stage_keeps_every_distinct_text(spark):
    data = [(None, "a b"), (None, "c"), (None, "c"), (7, "d"), (7, "e"), (7, "e"), (3, "d"), (9, "a  b"), (8, None), (None, "f")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("kept_sha", F.lit("x"))
    stage = exact.exact_stage(spark, df, "")
    assert stage.columns == df.columns
    assert rows(stage, "doc_id", "text") == sorted(
        [(9, "a  b"), (None, "c"), (3, "d"), (7, "e"), (8, None), (None, "f")], key=repr)


# ---- 7: vectors -------------------------------------------------------------

def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows_, base = [], rng.normal(size=(6, 16))
    for i in range(240):
        v = base[i % 6] + rng.normal(size=16) * rng.choice([0.02, 0.2, 0.3, 1.0])
        rows_.append((i, v.tolist(), i % 2))
    rows_ += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [], 1),
              (905, rows_[0][1], None), (906, rows_[0][1], 0), (907, rows_[0][1][:8], 0), (None, rows_[0][1], 0)]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1))
    x = {i: (np.array(v), lab) for i, v, lab in rows_ if i is not None and lab is not None and v and None not in v}
    x = {i: (v, lab) for i, (v, lab) in x.items() if np.isfinite(v).all() and v.any()}
    near = {i: set() for i, *_ in rows_}
    for a in x:
        for b in x:
            (va, la), (vb, lb) = x[a], x[b]
            if a < b and la == lb and len(va) == len(vb) and va @ vb / (np.linalg.norm(va) * np.linalg.norm(vb)) >= 0.93:
                near[a].add(b), near[b].add(a)
    comp = {}
    for i in sorted(k for k in near if k is not None):
        if i not in comp:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in comp:
                    comp[j] = i
                    todo += near[j]
    want = sorted([(i, len(near[i]), comp.get(i), i is None or comp[i] == i) for i, *_ in rows_], key=repr)
    assert sum(len(v) for v in near.values()) > 100
    for p in (vectors.Params(), vectors.Params(block=16)):
        assert rows(vectors.near_vectors(df, p), "vec_id", "n_links", "component_id", "kept") == want
    assert vectors.near_vectors(df.limit(0)).count() == 0


# ---- 8: pieces --------------------------------------------------------------

def brute_viterbi(voc, scores, word):
    best = [(0.0, [])] + [None] * len(word)
    for i in range(len(word)):
        for j in range(i + 1, len(word) + 1):
            if best[i] and word[i:j] in voc:
                s = best[i][0] + scores[word[i:j]]
                if best[j] is None or s > best[j][0] + 1e-12:
                    best[j] = (s, best[i][1] + [voc[word[i:j]]])
    return best[-1]


def test_pieces_viterbi_and_bytes():
    rng = random.Random(6)
    bytes_ = [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]
    words = list("▁abc") + sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(40)}) + ["▁ab", "▁a"]
    table = [("<unk>", 0.0, "other"), *bytes_, *[(w, -rng.random() * 10, "normal") for w in words]]
    voc = pieces.vocabulary(table)
    ids = {w: 257 + i for i, w in enumerate(words)}
    scores = {w: table[i][1] for w, i in ids.items()}
    for _ in range(200):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        got = pieces.encode_texts(voc, [w])[0].tolist()
        assert abs(sum(voc.scores[got]) - brute_viterbi(ids, scores, "▁" + w)[0]) < 1e-9
    odd = ["", None, " ", "  a b ", "\n\t", "▁", "a▁b ▁▁", "日本 😀", "\x00", "a" * 3000, "zz▁"]
    flat, n = pieces.encode_texts(voc, odd)
    edge = np.concatenate([[0], np.cumsum(n)])
    assert [pieces.decode_ids(voc, flat[a:b].tolist()) for a, b in zip(edge, edge[1:])] == [t or "" for t in odd]


def test_pieces_public_vocabulary_round_trip(spark):
    voc = pieces.load_vocabulary(pieces.MODEL_PATH)
    df = frame(spark, ODD, **CLASH)
    got = pieces.encode(df, voc)
    assert got.filter("exact").count() == len(ODD) and pieces.encode(df.limit(0), voc).count() == 0
    back = {r.doc_id: r.text for r in pieces.decode(got, voc).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}


# ---- 9: mixing --------------------------------------------------------------

def test_mixing_targets_and_pieces(spark):
    rng = random.Random(8)
    data = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", "B", "é", None, "a"])) for i in range(400)]
    data += [(None, "x y", "a"), (3, None, "zz"), (5, "dup row", "b"), (5, "dup row", "b")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("size", F.lit(7)).withColumn("skey", F.lit(1))
    out, parts = mixing.mixed(df)
    got = out.collect()
    assert len(got) == len(data) and all(r.taken <= 2 * r.size for r in got)
    size = Counter()
    for _, t, s in data:
        size[s] += len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, list(order)
    left = 1.5 * sum(size.values())
    while open_:  # deal by weight, stop at the cap, deal the excess again
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 2 * size[s]]
        for s in over or open_:
            target[s] = 2.0 * size[s] if over else share[s]
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in over] if over else []
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in order)
    assert parts.agg(F.sum("n_words")).first()[0] == sum(taken.values())
    assert rows(mixing.mixed(df)[0], "doc_id", "taken") == rows(out, "doc_id", "taken")
    assert mixing.mixed(df.limit(0))[0].count() == 0
    stage = mixing.mixing_stage(spark, frame(spark, ODD, **CLASH), "")
    assert stage.columns == frame(spark, ODD, **CLASH).columns


def test_mixing_stage_reaches_small_targets_in_a_large_corpus(spark):
    # 14 million words: a block of the 1 << 17 slots has 161 words, more than the target of the small source
    data = [(i, "w " * 30_000, "big") for i in range(470)] + [(1000 + i, "t " * 2, "tiny") for i in range(20)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = Counter(r.source for r in mixing.mixing_stage(spark, df, "").collect())
    target = {r.source: r.target for r in mixing.source_targets(
        spark.createDataFrame([("big", 470 * 30_000), ("tiny", 40)], "source string, source_size long")).collect()}
    assert abs(got["tiny"] * 2 - target["tiny"]) <= 2 and abs(got["big"] * 30_000 - target["big"]) <= 30_000


def test_every_source_reaches_its_target_at_any_size(spark):
    # one source of 14 million words beside many below a block: sizes from 1 to 40 words
    data = [(i, "w " * 30_000, "big") for i in range(470)] + [(1000 + i, "t " * (i + 1), f"tiny{i}") for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    out, parts = mixing.mixed(df)
    got = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(got) == 41 and all(abs(r.taken - r.target) <= 0.5 for r in got)
    assert all(r.taken <= 2 * r.size for r in out.collect())
    # any prefix of the schedule is near the shares: the big source after half of the slots
    plan = mixing.schedule(spark.createDataFrame([("a", 700_000.0), ("b", 200_000.0), ("c", 100_000.0)], "skey string, target double"), 100)
    half = Counter(r.skey for r in plan.filter("slot < 5000").collect())
    assert abs(half["a"] - 3500) <= 8 and abs(half["b"] - 1000) <= 8 and abs(half["c"] - 500) <= 8
    slots = [r.slot for r in plan.collect()]
    assert len(slots) == len(set(slots)) and plan.agg(F.sum("words")).first()[0] == 1_000_000


def test_mixing_stage_counts_rows_of_one_id_apart(spark):
    data = [(i, f"x{i} y z", "a") for i in range(150)] + [(None, f"x{i} y z", "b") for i in range(250)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = Counter(r.source for r in mixing.mixing_stage(spark, df, "").collect())
    target = {r.source: r.target for r in mixing.source_targets(
        spark.createDataFrame([("a", 450), ("b", 750)], "source string, source_size long")).collect()}
    assert all(abs(3 * got[s] - target[s]) <= 3 for s in target)


# ---- 10: language -----------------------------------------------------------

def test_language_evidence(spark):
    docs = spark.createDataFrame([(i, ("the and of " if i % 2 else "der und die ") * 20, "en" if i % 2 else "de")
                                  for i in range(20)] + [(None, "x", "en"), (99, None, None)], "doc_id long, text string, lang string")
    pages = [(i, f"http://h{i % 2}.example.{'com' if i % 2 else 'de'}/x",
              f"<html lang='{'en' if i % 2 else 'de'}'><p>{'the and of' if i % 2 else 'der und die'}</p><script>der</script>") for i in range(30)]
    pages += [(100, "http://h0.example.de/", None), (101, None, ""), (102, "http://h1.example.com", "<html lang=en>"), (102, "http://h1.example.com", "<html lang=en>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("q", F.lit(1)).withColumn("host_k", F.lit("c"))
    got = langid.identify(df, docs).collect()
    lang = {r.page_id: r.lang for r in got}
    assert len(got) == len(pages) and all(lang[i] == ("en" if i % 2 else "de") for i in range(30))
    assert lang[100] == "de" and lang[102] == "en" and all(0 < r.p <= 1 for r in got)
    assert langid.identify(df.limit(0), docs).count() == 0
    assert {r.lang for r in langid.identify(df, docs.limit(0)).collect()} == {None}
