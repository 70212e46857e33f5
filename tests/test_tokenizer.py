"""Batched Spark BPE learner == sequential BPE; encoder round trip; specials."""
from __future__ import annotations

import math
from collections import Counter

import pytest

from lexicount.operators import tokenizer, unigram
from lexicount.operators.bpe import merge_symbols

TEXT = ("the cat sat on the mat. the cats sat on the mats! a cat, a mat; the hat. "
        "über die Straße, ça va? 東京 2024 the the that this thin thing things ") * 3


def sequential_bpe(counts: dict[str, int], n_merges: int, off: int = 4, min_count: int = 2):
    words = {tuple(off + b for b in w.encode()): c for w, c in counts.items()}
    merges, nxt = [], off + 256
    for _ in range(n_merges):
        pc = Counter()
        for w, c in words.items():
            for a, b in zip(w, w[1:]):
                pc[(a, b)] += c
        cand = [(c, p) for p, c in pc.items() if c >= min_count]
        if not cand:
            break
        c, (a, b) = min(cand, key=lambda x: (-x[0], x[1]))
        merges.append((a, b, c))
        nw = {}
        for w, cnt in words.items():
            out, i = [], 0
            while i < len(w):
                if i < len(w) - 1 and (w[i], w[i + 1]) == (a, b):
                    out.append(nxt)
                    i += 2
                else:
                    out.append(w[i])
                    i += 1
            nw[tuple(out)] = nw.get(tuple(out), 0) + cnt
        words = nw
        nxt += 1
    return merges


def test_learn_bpe_is_exact(spark):
    df = spark.createDataFrame([(TEXT,)], "text string")
    counts = tokenizer.pretoken_counts(df)
    local = {r.pretoken: r["count"] for r in counts.collect()}
    merges, rounds = tokenizer.learn_bpe(counts, vocab_size=4 + 256 + 40)
    want = sequential_bpe(local, 40)
    assert [(a, b, c) for _, a, b, c in merges] == want
    assert rounds <= len(merges)


def test_encode_round_trip_and_specials(spark):
    df = spark.createDataFrame([(TEXT,), ("",), (None,)], "text string")
    merges, _ = tokenizer.learn_bpe(tokenizer.pretoken_counts(df), vocab_size=4 + 256 + 30)
    vocab, mtab = tokenizer.vocab_table(spark, merges)
    assert tokenizer.check_specials(vocab).count() == 0
    tok = {r.id: r.token for r in vocab.collect()}
    rows = tokenizer.encode(df, merges).collect()
    ids = rows[0].ids
    assert len(ids) < len(TEXT.encode())
    assert bytes.fromhex("".join(tok[i] for i in ids)).decode() == TEXT
    assert rows[1].ids == [] and rows[2].ids == []
    assert mtab.count() == len(merges)


def test_unigram_vocab(spark):
    df = spark.createDataFrame([(TEXT,), ("ｆｕｌｌ ｗｉｄｔｈ",)], "text string")
    vocab = tokenizer.learn_unigram(df, vocab_size=80).collect()
    pieces = [r.piece for r in vocab]
    assert pieces[:4] == list(tokenizer.SPECIAL_TOKENS)
    assert len(pieces) <= 80
    assert "▁the" in pieces            # frequent word survives pruning
    assert "ｆ" not in "".join(pieces)       # NFKC folded full-width letters
    assert all(r.logprob <= 0 for r in vocab[4:])
    assert abs(sum(math.exp(r.logprob) for r in vocab[4:]) - 1) < 1e-9
    assert vocab[3].piece == "<unk>" and vocab[3].logprob < min(r.logprob for r in vocab[4:])
    enc = tokenizer.UnigramEncoder([tuple(r) for r in vocab])
    ids = enc.encode("the mat\u2003thinЖ")
    assert "".join(pieces[i] for i in ids).replace("▁", " ") == " the mat thin<unk>" and enc.encode("") == []


def test_seeds_are_repeated_branching_substrings(spark):
    words = spark.createDataFrame([("▁abcab", 3), ("▁abd", 1), ("▁zz", 1)], "word string, count long")
    got = {r.piece: r.freq for r in unigram.seed_pieces(words, 16, 100).collect()}
    text = [("▁abcab", 3), ("▁abd", 1), ("▁zz", 1)]
    every = Counter()
    for w, c in text:
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                every[w[i:j]] += c
    want = {p: c for p, c in every.items() if len(p) == 1 or (c > 1 and not any(
        q[:-1] == p and n == c for q, n in every.items()))}
    assert got == want and got["ab"] == 7 and "bc" not in got


def test_expected_counts_and_losses_by_enumeration():
    lp = {"a": -1.0, "b": -1.5, "ab": -1.2, "ba": -2.0, "aba": -2.5}

    def splits(w):
        if not w:
            yield []
        for i in range(1, len(w) + 1):
            if w[:i] in lp:
                yield from ([w[:i], *rest] for rest in splits(w[i:]))
    for word in ("abab", "aabba", "ba", "c"):
        every = [(s, math.exp(sum(lp[p] for p in s))) for s in splits(word)]
        z = sum(x for _, x in every)
        want = Counter()
        for s, x in every:
            for p in s:
                want[p] += x / z
        got = unigram.expected_counts(word, lp, 3)
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)
        best = max(every, key=lambda x: x[1])[0] if every else None
        assert unigram.best_segmentation(word, lp, 3) == best
    uses = {"a": 5.0, "b": 4.0, "ab": 3.0, "ba": 0.0, "aba": 2.0}
    got = unigram.losses(lp, uses)
    assert got["ba"] == 0.0 and set(got) == {"ab", "ba", "aba"}
    now = 3 / 14 * math.log(3 / 14)
    then = 3 / 14 * (math.log(8 / 17) + math.log(7 / 17))
    assert abs(got["ab"] - (now - then)) < 1e-12


def test_pruning_keeps_the_pieces_that_matter(spark):
    """A piece that two others spell as well goes first; characters always stay."""
    df = spark.createDataFrame([("lantern " * 50 + "lant ern " * 3 + "xyz",)], "text string")
    vocab = {r.piece for r in tokenizer.learn_unigram(df, vocab_size=4 + 11 + 3).collect()}
    assert "▁lantern" in vocab and set("lanternxyz▁") <= vocab


def test_unicode_white_space_is_one_definition(spark):
    """Learning (Java) and encoding (Python) cut the same pre-tokens at U+00A0, U+2003 and U+3000."""
    import regex
    from lexicount.config import BYTE_LEVEL_PATTERN
    text = "x!\u3000y \u3000b\u00a0 c\u2003\u2003d 1\n\n e"
    df = spark.createDataFrame([(text,)], "text string")
    got = [r.pretoken for r in tokenizer.pretokens(df).collect()]
    assert got == regex.findall(BYTE_LEVEL_PATTERN, text) == regex.findall(
        r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", text)


def test_unigram_refuses_a_vocabulary_below_the_characters(spark):
    import pytest
    df = spark.createDataFrame([("the quick brown fox jumps over the lazy dog",)], "text string")
    with pytest.raises(ValueError, match="distinct characters"):
        tokenizer.learn_unigram(df, vocab_size=20)


def test_every_pair_can_be_merged(spark):
    counts = spark.createDataFrame([("abcd", 1)], "pretoken string, count long")
    merges, _ = tokenizer.learn_bpe(counts, vocab_size=1000)
    assert len(merges) == 3


@pytest.mark.parametrize("limits", [{}, {"pairs_per_round": 8}, {"pairs_per_round": 40, "max_runs": 12}, {"max_runs": 1}])
def test_rounds_change_with_the_limits_but_not_the_merges(spark, limits):
    df = spark.createDataFrame([(TEXT,), ("aaaa aaaaaaa aa banana bananas nana",)], "text string")
    counts = tokenizer.pretoken_counts(df)
    local = {r.pretoken: r["count"] for r in counts.collect()}
    n = 6 if limits == {"max_runs": 1} else 60  # no run fits: one merge a round
    merges, rounds = tokenizer.learn_bpe(counts, vocab_size=4 + 256 + n, **limits)
    assert [(a, b, c) for _, a, b, c in merges] == sequential_bpe(local, n, min_count=1)
    assert rounds == 1 if not limits else 1 < rounds <= n


def test_a_round_makes_many_merges(spark):
    """A vocabulary of thousands takes a few rounds, and the threshold of a round is never undercut."""
    import random
    rng = random.Random(3)
    words = ["".join(rng.choice(["ba", "ke", "lo", "mi", "tun", "ser"]) for _ in range(rng.randint(1, 5))) for _ in range(1500)]
    counts = spark.createDataFrame([(w, 1 + 3000 // (i + 1)) for i, w in enumerate(dict.fromkeys(words))], "pretoken string, count long")
    merges, rounds = tokenizer.learn_bpe(counts, vocab_size=4 + 256 + 700, pairs_per_round=300)
    assert len(merges) == 700 and rounds <= 20
    assert all(x[3] >= y[3] for x, y in zip(merges, merges[1:], strict=False))


def test_merge_of_a_long_pretoken_is_fast():
    import time
    table = {(1, 1): (0, 2), (2, 2): (1, 3), (3, 3): (2, 4)}
    start = time.time()
    assert tokenizer.BpeEncoder([]).encode("") == [] and merge_symbols([1] * 5, table) == [3, 1]
    assert len(merge_symbols([1] * 200_001, table)) == 25_001
    assert time.time() - start < 10


class Words:
    """An encoder of whole texts: the length of each word."""

    def encode(self, text):
        return [len(w) for w in text.split()]


class Carrier:
    """An encoder whose result carries the ids."""

    def encode(self, piece):
        return type("Encoded", (), {"ids": list(piece.encode())})()


def test_any_encoder_can_be_used(spark):
    df = spark.createDataFrame([("ab cde",), ("",), (None,)], "text string")
    assert [r.ids for r in tokenizer.encode(df, Words(), pattern=None).collect()] == [[2, 3], [], []]
    assert [r.ids for r in tokenizer.encode(df, Carrier()).collect()] == [list(b"ab cde"), [], []]


def test_missing_specials_stop_the_run(spark):
    vocab, _ = tokenizer.vocab_table(spark, [], specials=("<pad>", "<eos>"))
    with pytest.raises(ValueError, match="<bos>.*<unk>"):
        tokenizer.require_specials(vocab)
    assert tokenizer.require_specials(vocab, ("<pad>", "<eos>")).count() == 258


def test_many_words_at_once_equal_each_word(spark):
    """Lattices of words of all lengths, weighted, against the segmentation of one word at a time."""
    import random
    rng = random.Random(5)
    lp = {"a": -1.0, "b": -1.5, "ab": -1.2, "ba": -2.0, "aba": -2.5, "東": -3.0, "b東": -3.25, "aa": -2.0}
    words = list(dict.fromkeys("".join(rng.choice("ab東c") for _ in range(rng.randint(0, 9))) for _ in range(300)))
    words += ["ab" * 400, "c", "aaaa"]
    counts = [rng.randint(1, 9) for _ in words]
    lattices = unigram.Lattices(lp)
    uses, expected = Counter(), Counter()
    for w, c in zip(words, counts, strict=True):
        uses.update({p: n * c for p, n in Counter(unigram.best_segmentation(w, lp, 3) or []).items()})
        for p, x in unigram.expected_counts(w, lp, 3).items():
            expected[p] += c * x
    assert dict(zip(lattices.pieces, lattices.uses(words, counts), strict=True)) == {p: uses[p] for p in lp}
    got = dict(zip(lattices.pieces, lattices.expected(words, counts), strict=True))
    assert all(math.isclose(got[p], expected[p], rel_tol=1e-12, abs_tol=1e-12) for p in lp)


def test_learners_deal_their_words_out(spark, monkeypatch):
    """Few bytes of words are many words: every pass over them runs in as many tasks as a shuffle."""
    from lexicount.operators import bpe
    cut, tasks = bpe.cut_lineage, {}

    def seen(df, name):
        tasks.setdefault(name, df.rdd.getNumPartitions())
        return cut(df, name)
    monkeypatch.setattr(bpe, "cut_lineage", seen)
    monkeypatch.setattr(unigram, "cut_lineage", seen)
    df = spark.createDataFrame([(TEXT,)], "text string")
    tokenizer.learn_bpe(tokenizer.pretoken_counts(df), vocab_size=4 + 256 + 2)
    tokenizer.learn_unigram(df, vocab_size=80, em_rounds=1)
    assert tasks["bpe-words"] == tasks["unigram-words"] == 8


def test_words_are_segmented_once(monkeypatch):
    calls, best = [], unigram.best_segmentation
    monkeypatch.setattr(unigram, "best_segmentation", lambda w, *a, **k: calls.append(w) or best(w, *a, **k))
    enc = unigram.UnigramEncoder([(0, "<unk>", -9.0), (1, "▁", -1.0), (2, "a", -1.0)])
    assert enc.encode("a aa a") == [1, 2, 1, 2, 2, 1, 2] and enc.encode("aa") == [1, 2, 2]
    assert sorted(calls) == ["▁a", "▁aa"]
    import pickle
    assert pickle.loads(pickle.dumps(enc)).encode("a") == [1, 2]


def syllables(n, most=5, seed=7):
    """Words of syllables, the first ones often."""
    import random
    rng = random.Random(seed)
    words = dict.fromkeys("".join(rng.choice(["ba", "ke", "lo", "mi", "tun", "ser", "tion"]) for _ in range(rng.randint(1, most))) for _ in range(n))
    return " ".join(f"{w} " * (1 + 40 // (i + 1)) for i, w in enumerate(words))


@pytest.mark.parametrize("held", [10, 400])
def test_pieces_in_a_table_are_learned_as_pieces_on_the_driver(spark, monkeypatch, held):
    """More pieces than the driver holds: the same rounds on a table of the pieces of every block of words."""
    monkeypatch.setattr(unigram, "_BLOCK", 300)
    blocks, of = [], unigram._Dealt.of
    monkeypatch.setattr(unigram._Dealt, "of", staticmethod(lambda *a: blocks.append(of(*a)) or blocks[-1]))
    df = spark.createDataFrame([(syllables(150),), ("ab" * 60 + " " + "ab" * 60,)], "text string")
    want = {r.piece: r.logprob for r in tokenizer.learn_unigram(df, vocab_size=60, seed_size=None).collect()}
    assert not blocks
    got = {r.piece: r.logprob for r in tokenizer.learn_unigram(df, vocab_size=60, seed_size=None, held=held).collect()}
    assert len(blocks) == 1 and blocks[0].words.select("block").distinct().count() > 3
    assert blocks[0].n == blocks[0].known.select("piece").distinct().count() > 400
    assert got.keys() == want.keys() and all(math.isclose(got[p], want[p], rel_tol=1e-9) for p in want)


def test_blocks_are_dealt_out_evenly(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = unigram._even(spark, 3 * n)
    sizes = unigram._by_block(spark.createDataFrame([(i,) for i in got], "block long")).rdd.glom().map(len).collect()
    assert len(set(got)) == 3 * n and sizes == [3] * n and len(unigram._even(spark, 1)) == 1


def test_unlikely_words_are_segmented_as_others():
    """A word whose probability is below every double counts as much as one that is not."""
    lp = {"a": -20.0, "b": -30.0, "ab": -45.0, "c": -1.0}
    lattices = unigram.Lattices(lp)
    short = dict(zip(lattices.pieces, lattices.expected(["ab", "c"], [30, 2]), strict=True))
    long = dict(zip(lattices.pieces, lattices.expected(["ab" * 30, "c"], [1, 2]), strict=True))
    assert all(math.isclose(short[p], long[p], rel_tol=1e-9) for p in lp) and long["c"] == 2 and long["ab"] > 0


def documents_of_syllables(spark, path):
    """Two documents of the same words; their words, and every candidate by enumeration."""
    text = syllables(400)
    spark.createDataFrame([(i, text, "en", "web", len(text)) for i in range(2)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    every, followed = Counter(), Counter()
    for w, c in Counter(text.split() * 2).items():
        for i in range(len(w) + 1):
            for j in range(i, min(len(w), i + 15) + 1):
                every[f"▁{w}"[i:j + 1]] += c
    for p, c in every.items():
        followed[p[:-1]] = max(followed[p[:-1]], c)
    return {p for p, c in every.items() if len(p) == 1 or (c > 1 and followed[p] < c)}


@pytest.fixture
def begun(monkeypatch):
    """The pieces of every pass over the words."""
    passes, counted = [], unigram._counted
    monkeypatch.setattr(unigram, "_counted", lambda words, lp, of: passes.append(lp) or counted(words, lp, of))
    return passes


def test_unigram_vocab_starts_from_every_candidate(spark, monkeypatch, tmp_path, begun):
    """the rounds begin with all repeated branching substrings, not with the best few by frequency x length."""
    from lexicount.plans import q_tok
    want = documents_of_syllables(spark, tmp_path)
    monkeypatch.setattr(q_tok, "UNIGRAM_SIZE", 100)
    assert q_tok.q_unigram_vocab(spark, str(tmp_path)).count() == 100
    assert len(want) > 3 * 100 + 60 and begun[0].keys() == want


def test_unigram_invariants_hold_of_a_vocabulary_from_every_candidate(spark, monkeypatch, tmp_path, begun):
    """the vocabulary that is checked and that every document is read back from starts from all of them too."""
    from lexicount.plans import q_tok
    want = documents_of_syllables(spark, tmp_path)
    monkeypatch.setattr(q_tok, "UNIGRAM_SIZE", 100)
    facts = q_tok.q_unigram_invariants(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in facts] == [(100, 4, len({p for p in want if len(p) == 1}), 1.0, True, True, 2)]
    assert begun[0].keys() == want
