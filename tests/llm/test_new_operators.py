"""Small cases of operators 11 to 13 against plain Python."""
from __future__ import annotations

import hashlib
import random
import re
import struct
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexicount.llm import fingerprint, langid, merkle, trie

DOCS = "doc_id long, source string, lang string, n_chars long, text string"
CLASH = {"leaf": "x", "pos": 1, "grp": 2, "rank": 3, "proof": "p", "key": "k", "block": 4, "at": 5, "item": 6, "sig": "s",
         "term": 7, "c": 8, "d": 9, "p1": 10, "words": 11}


def with_clashes(df):
    for name, value in CLASH.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    return df


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- 11: manifest -----------------------------------------------------------

def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(levels, i):
    """(before, after) of node i and of its ancestors."""
    path = []
    for nodes in levels[:-1]:
        run = i - i % 3
        path.append((nodes[run:i], nodes[i + 1:run + 3]))
        i //= 3
    return path


def brute_manifest(docs):
    def leaf(d, text):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d[0], d[1], d[2], d[3], text)])
    groups = {}
    for d in docs:
        groups.setdefault(d[1], []).append((d, leaf(d, d[4])))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = [levels_of([h for _, h in groups[s]]) for s in order]
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for i, s in enumerate(order):
        for j, (d, h) in enumerate(groups[s]):
            path = siblings(trees[i], j) + siblings(top, i)
            now = h
            if d[0] is not None and crc32(str(d[0]).encode()) % 2 == 0 and d[4] is not None:
                now = leaf(d, d[4].replace("\n", ""))
            for before, after in path:
                now = sha(*before, now, *after)
            proof = sha(*[x for before, after in path for x in (*before, *after)])
            out.append((d[0], h, trees[i][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 3, 4, 95])
def test_manifest_equals_brute_force(spark, n):
    rng = random.Random(n)
    sources = ["b", "a", None, "é", "B", ""]
    docs = [(i, rng.choice(sources[:1 + n // 4]), "en", i, f"line\nof {i}\n" if i % 2 else f"plain {i}") for i in range(n)]
    if n > 4:
        docs += [(None, "a", None, None, None), (None, "a", None, None, None), (500, "alone", "x", 1, ""), (7, "b", "en", 7, "other"),
                 (600, None, "de", 0, "ü\n😀"), (3, "b", "en", 3, "line\n" * 5000), (3, "b", "en", 3, "line\n" * 5000)]
    df = with_clashes(spark.createDataFrame(docs, DOCS))
    assert rows(merkle.manifest(df)) == brute_manifest(docs)


def test_manifest_of_nothing_and_proofs_of_some(spark):
    df = spark.createDataFrame([(i, f"s{i % 4}", None, None, str(i)) for i in range(60)], DOCS)
    assert merkle.manifest(df.limit(0)).count() == 0
    leaves = df.select("doc_id", "source", merkle.leaf_of(F.col("text")).alias("leaf"))
    m = merkle.build(leaves)
    every = merkle.prove(m)
    asked = m.leaves.filter("doc_id % 7 = 3").select("grp", "rank")
    some = merkle.prove(m, asked)
    cols = ["doc_id", "grp", "rank", "subroot", "proof"]
    assert rows(some.select(*cols)) == rows(every.filter("doc_id % 7 = 3").select(*cols)) and some.count() == 9
    assert some.filter(merkle.folded(merkle.text_of(F.col("leaf")), F.col("proof")) != F.lit(m.root)).count() == 0


# ---- 12: trie ---------------------------------------------------------------

def brute_trie(turns):
    convs = {}
    for c, t, r, x in turns:
        if c is not None:
            body = (r or "", x or "")
            key = hashlib.sha256(f"{len(body[0].encode())}:{body[0]}{body[1]}".encode()).digest()
            convs.setdefault(c, []).append((t is not None, t or 0, key, body))
    own = {c: [x[3] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in own.items():
        h = crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + v[h:]
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, who in members.items():
        own_saved = (len(who) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own_saved
            leaves[p[:d]] += not kids[p]
    out = []
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(built[c]) == len(p))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), kids[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


CONV = "conv_id long, turn long, role string, text string"


def test_trie_equals_brute_force(spark):
    rng = random.Random(4)
    data = []
    for c in [*range(0, 90), -7, -20, 400, 405]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 8])):
            data.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "ok then", "", None, "a b  c"])))
    data += [(None, 0, "user", "nobody"), (21, None, "user", "first"), (22, 3, "user", "tie b"), (22, 3, "user", "tie a"),
             (22, 3, "user", "tie a"), (41, 9, "user", "long " * 20_000)]
    df = with_clashes(spark.createDataFrame(data, CONV))
    assert rows(trie.trie(df)) == brute_trie(data)
    assert trie.trie(df.limit(0)).count() == 0
    assert trie.trie(spark.createDataFrame([(None, 1, "user", "x")], CONV)).count() == 0


def test_trie_with_one_hot_conversation_and_turnless_ones(spark):
    data = [(c, t, "user", f"t{t}") for c in range(200) for t in range(4)]
    data += [(1000 + c, 0, "user", "only") for c in range(1, 15)]  # own turns go, there is no conversation 1000
    assert rows(trie.trie(spark.createDataFrame(data, CONV))) == brute_trie(data)


def test_trie_shards_bands_and_strides_do_not_change_sums(spark, monkeypatch):
    data = [(20 * c, t, "user", f"w{t % 5} x" if t < 6 + c else f"own {c}") for c in range(6) for t in range(40)]
    want = brute_trie(data)
    monkeypatch.setattr(trie, "STRIDE", 4)
    monkeypatch.setattr(trie.accumulated, "__defaults__", (16, 7))
    assert rows(trie.trie(spark.createDataFrame(data, CONV))) == want


def test_digest_collisions_are_found_and_avoided(spark, monkeypatch):
    data = [(c, t, "user", f"text {(c * 7 + t) % 11}") for c in range(0, 60) for t in range(3)]
    real, seeds = trie.prefixes, []

    def colliding(rows, seed):
        seeds.append(seed)
        out = real(rows, seed)
        return out if seed else out.withColumn("p1", F.col("p1") % 3).withColumn("p2", F.lit(5).cast("long"))
    monkeypatch.setattr(trie, "prefixes", colliding)
    assert rows(trie.trie(spark.createDataFrame(data, CONV))) == brute_trie(data) and seeds == [0, 1]


def test_perfect_hash_is_minimal_and_knows_foreign_keys():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-2**62, 2**62, size=(2, 5000))
    table = trie.PerfectHash(a[:4000], b[:4000])
    assert sorted(table.slots(a[:4000], b[:4000]).tolist()) == list(range(4000))
    assert (table.slots(a[4000:], b[4000:]) == -1).all() and (table.slots(a[:10], b[10:20]) == -1).all()
    assert len(trie.PerfectHash(a[:0], b[:0]).slots(a[:3], b[:3])) == 3


# ---- 13: fingerprints -------------------------------------------------------

GAMMA = fingerprint.gamma_quantiles()
LOG_GAMMA = np.log(GAMMA)


def h64(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed=seed)


def brute_signature(text, k):
    terms = Counter(w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w)
    best = [None] * k
    for word, w in terms.items():
        term = h64(word.encode())
        seed = h64(struct.pack("<Q", term))
        for i in range(k):
            h = h64(struct.pack("<q", i), seed)
            r, log_c, b = GAMMA[h & 4095], LOG_GAMMA[(h >> 12) & 4095], (((h >> 24) & 0xFFFFFF) + 0.5) * 2.0 ** -24
            t = int(np.floor(np.log(w) / r + b))
            bid = int(np.floor((log_c - r * (t - b + 1) + 40) * (1 << 24))) << 32 | ((term ^ (t << 7)) & 0xFFFFFFFF)
            best[i] = bid if best[i] is None else min(best[i], bid)
    return [x & 0xFFFF for x in best] if terms else None


def brute_fingerprints(docs, k):
    def key(d):
        return (-d[0] if d[0] is not None else float("inf"),
                hashlib.sha256(f"{'-' if d[0] is None else d[0]}:{d[1]}".encode()).digest())
    docs = sorted(((i, t or "") for i, t in docs), key=key)
    sigs = [brute_signature(t, k) for _, t in docs]

    def like(x, y):
        return float(x is None and y is None) if x is None or y is None else sum(a == b for a, b in zip(x, y, strict=True)) / k

    def text_of(s):
        return "" if s is None else "".join("%04x" % x for i in range(0, k, 4) for x in reversed(s[i:i + 4]))
    out = []
    for j, (i, t) in enumerate(docs):
        nxt, half = (j + 1) % len(docs), len(t) // 2
        edited = t[:len(t) - half] + docs[nxt][1][:half]
        e = brute_signature(edited, k)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text_of(sigs[j]), text_of(e), like(sigs[j], e),
                    like(sigs[j], sigs[nxt])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [64, 2])
def test_fingerprints_equal_brute_force(spark, block):
    docs = [(1, "a b c d e f g h"), (2, "A b c d e f g x"), (2, "A b c d e f g x"), (2, "A b c d e f g x"), (3, None), (4, ""),
            (None, "É ü 😀 word word word word"), (5, "the the the the cat"), (9, "  "), (9, "q"), (11, "z " * 30_000)]
    docs += [(100 + i, " ".join("abcdefghijkl"[(i * j) % 12] * 3 for j in range(i % 17))) for i in range(60)]
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string"))
    p = fingerprint.Params(samples=16, block=block)
    assert rows(fingerprint.edited_fingerprints(df, p)) == brute_fingerprints(docs, 16)


def test_fingerprints_of_few_rows(spark):
    for docs in ([], [(5, "one two three")], [(None, None)], [(5, "same"), (5, "same")]):
        df = spark.createDataFrame(docs, "doc_id long, text string")
        assert rows(fingerprint.edited_fingerprints(df)) == brute_fingerprints(docs, 48)


def test_collision_rate_is_the_generalised_jaccard_similarity(spark):
    """Mean likeness of pairs with known weighted overlap, and independence of the samples."""
    rng = random.Random(9)
    p = fingerprint.Params(samples=64)
    data, want = [], []
    for i in range(120):
        base = Counter({f"w{rng.randint(0, 10**6)}": rng.choice([1, 1, 2, 3, 7]) for _ in range(60)})
        other = Counter({w: max(1, n + rng.choice([0, 0, 2, -1])) for w, n in base.items() if rng.random() < 0.7})
        other.update({f"v{rng.randint(0, 10**6)}": 1 for _ in range(15)})
        want.append(sum((base & other).values()) / sum((base | other).values()))
        data += [(i, 0, " ".join(base.elements())), (i, 1, " ".join(other.elements()))]
    sig = fingerprint.fingerprints(spark.createDataFrame(data, "i long, side int, body string"), "body", p)
    both = sig.filter("side = 0").select("i", F.col("sig").alias("a")).join(sig.filter("side = 1").select("i", F.col("sig").alias("b")), "i")
    got = {r.i: r.x for r in both.select("i", fingerprint.likeness(F.col("a"), F.col("b"), p).alias("x")).collect()}
    error = np.array([got[i] - want[i] for i in range(120)])
    assert abs(error.mean()) < 0.02 and error.std() < 1.3 * 0.5 / np.sqrt(64)


# ---- 10: languages beyond a block, broken markup ----------------------------

def test_seventy_languages(spark):
    def words(i):
        return " ".join(f"{chr(0x4e00 + 40 * i + j)}{chr(0x4e00 + 40 * i + (j * 3) % 17)}" for j in range(12))
    names = [f"l{i:02}" for i in range(70)]
    docs = spark.createDataFrame([(10 * i + j, names[i], words(i)) for i in range(70) for j in range(6)],
                                 "doc_id long, lang string, text string")
    pages = spark.createDataFrame([(i, f"http://h{i}.example/", f"<html><p>{words(i)}</p></html>") for i in range(70)]
                                  + [(100, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in langid.identify(pages, docs).collect()}
    assert len(got) == 71 and all(got[i].lang == names[i] == got[i].text_lang for i in range(70))
    assert all(0 < r.p <= 1 + 1e-9 for r in got.values())


def test_tie_goes_to_the_first_language(spark):
    docs = spark.createDataFrame([(i, "b" if i % 2 else "a", "same words here") for i in range(40)], "doc_id long, lang string, text string")
    pages = spark.createDataFrame([(1, "http://x.y/", "")], "page_id long, url string, html string")
    assert langid.identify(pages, docs.limit(0)).first().lang is None
    table = np.zeros((2, 1 << langid.BITS), dtype=np.float32)
    row = langid.with_block(langid.page_evidence(pages), table, langid.Params()).first()
    assert list(row.ev) == [0.0, 0.0]


def test_markup_is_removed_like_by_the_pattern_and_in_linear_time():
    import time
    pattern = re.compile(r"<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
    rng = random.Random(2)
    bits = ["<script", "<SCRIPT>", "</script >", "</Script>", "<!--", "-->", "<p a='>'>", "</p>", ">", "<", "text", "<style x>", "</style>",
            "<nav>", "</nav>", "<navy>", " ", "é"]
    for _ in range(3000):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert langid.without_markup(page) == pattern.sub(" ", page), page
    start = time.time()
    for broken in ("<script" * 150_000, "<!--" * 250_000, "<html lang" * 100_000, "<nav>" * 200_000 + "</nav", "</script " * 100_000):
        langid.visible_text(broken), langid.declared_language(broken)
    assert time.time() - start < 20
