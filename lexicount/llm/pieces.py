"""SentencePiece encoding and decoding (operator 8): unigram Viterbi over a double-array trie.

The vocabulary is a public model file named by a parameter. Its pieces, log
scores and byte pieces are put into a byte-level double-array trie once on the
driver (bounded by the vocabulary) and shipped with the tasks. Texts are cut
where no piece can reach across (before each run of spaces), the distinct
chunks of a slice of documents are segmented side by side in numpy, and the
ids are gathered back per document.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁".encode()
#: Stands for a literal marker character inside a text (never a byte of UTF-8): it is spelled in byte pieces.
_LITERAL = b"\xff"
_CHUNK = re.compile(rb" *[^ ]+| +")
SLICE_BYTES = 4 << 20


@dataclass(frozen=True)
class Vocabulary:
    """Trie arrays, scores and piece bytes; ``byte_ids[b]`` is the piece of byte b (-1: none)."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    scores: np.ndarray
    surface: tuple[bytes, ...]
    byte_ids: np.ndarray
    unk_id: int
    unk_score: float


def double_array(entries: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, value: child of state s by byte b is t = base[s] + b + 1 if check[t] == s."""
    tree: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, v in entries.items():
        at = 0
        for b in key:
            nxt = tree[at].get(b)
            if nxt is None:
                nxt = tree[at][b] = len(tree)
                tree.append({})
                ends.append(-1)
            at = nxt
        ends[at] = v
    size = 2 * len(tree) + 1024
    base, check, value = (np.full(size, fill, dtype=np.int64) for fill in (0, -1, -1))
    used = bytearray(size)
    used[0] = 1
    place, lowest, hint, todo = {0: 0}, 257, 0, [0]
    value[0] = ends[0]
    for node in todo:
        kids = sorted(tree[node])
        if not kids:
            continue
        while used[lowest]:
            lowest += 1
        # single children fill the lowest holes; larger families search on from the last one's place
        b = lowest - kids[0] - 1 if len(kids) == 1 else hint
        while True:
            if b + 257 >= len(used):
                more = len(used)
                used.extend(bytes(more))
                base, check, value = (np.concatenate([a, np.full(more, fill, dtype=np.int64)])
                                      for a, fill in ((base, 0), (check, -1), (value, -1)))
            if not any(used[b + k + 1] for k in kids):
                break
            b += 1
        base[place[node]] = b
        hint = hint if len(kids) == 1 else max(hint, b - 32)
        for k in kids:
            t, child = b + k + 1, tree[node][k]
            used[t], check[t], value[t], place[child] = 1, place[node], ends[child], t
            todo.append(child)
    top = max(place.values()) + 258
    if top > len(base):
        grow = top - len(base)
        base, check, value = (np.concatenate([a, np.full(grow, fill, dtype=np.int64)])
                              for a, fill in ((base, 0), (check, -1), (value, -1)))
    return base[:top].astype(np.int32), check[:top].astype(np.int32), value[:top].astype(np.int32)


def vocabulary(pieces: list[tuple[str, float, str]], unk_id: int = 0) -> Vocabulary:
    """From (piece, score, kind) by id; kind is normal, byte, or anything else for ids never produced."""
    normal = {p.encode(): i for i, (p, _, kind) in enumerate(pieces) if kind == "normal"}
    for p in normal:
        if MARK in re.sub(rb"^(?:" + MARK + rb")+", b"", p):
            raise ValueError(f"piece {p!r} has a white-space marker after its start")
    base, check, value = double_array(normal)
    scores = np.array([s for _, s, _ in pieces], dtype=np.float64)
    byte_ids = np.full(256, -1, dtype=np.int64)
    surface = []
    for i, (p, _, kind) in enumerate(pieces):
        if kind == "byte":
            byte_ids[int(p[3:5], 16)] = i
            surface.append(bytes([int(p[3:5], 16)]))
        else:
            surface.append(p.encode().replace(MARK, b" ") if kind == "normal" else b"")
    low = min((s for _, s, kind in pieces if kind == "normal"), default=0.0)
    return Vocabulary(base, check, value, scores, tuple(surface), byte_ids, unk_id, low - 10.0)


def load_vocabulary(path: str) -> Vocabulary:
    """Pieces of a public SentencePiece model file (read on the driver; never trained here)."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = ["byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
             else "normal" for i in range(len(sp))]
    return vocabulary([(sp.id_to_piece(i), sp.get_score(i), k) for i, k in enumerate(kinds)], sp.unk_id())


def segment(voc: Vocabulary, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all chunks one after another, ids per chunk): the best-scoring segmentation of each.

    All chunks advance together, one start position at a time; a character
    without a piece of its own may also be taken as unknown. Earlier starts
    win ties.
    """
    lens = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
    order = np.argsort(-lens, kind="stable")  # longest first: the lanes still running are a prefix
    slens = lens[order]
    data = np.frombuffer(b"".join([chunks[i] for i in order]) + b"\0", dtype=np.uint8)
    off = np.concatenate([[0], np.cumsum(slens + 0)])[:-1]
    width = np.ones(256, dtype=np.int64)
    width[0x80:0xC0], width[0xC0:0xE0], width[0xE0:0xF0], width[0xF0:0xF8] = 0, 2, 3, 4
    node0 = off + np.arange(len(off))  # lattice nodes: one more than bytes in each chunk
    best = np.full(int(slens.sum()) + len(off), -np.inf)
    back_id = np.full(len(best), -1, dtype=np.int32)
    back_len = np.zeros(len(best), dtype=np.int32)
    best[node0] = 0.0
    running = len(slens)
    for p in range(int(slens[0]) if len(slens) else 0):
        while running and slens[running - 1] <= p:
            running -= 1
        w = width[data[off[:running] + p]]
        lane = np.flatnonzero(w)
        if not len(lane):
            continue
        here, at, left, w = node0[lane] + p, off[lane] + p, slens[lane] - p, w[lane]
        score0 = best[here]
        single = np.zeros(len(lane), dtype=bool)
        act, state = np.arange(len(lane)), np.zeros(len(lane), dtype=np.int32)
        step = 0
        while len(act):
            nxt = voc.base[state] + data[at[act] + step] + 1
            ok = voc.check[nxt] == state
            act, state = act[ok], nxt[ok]
            step += 1
            v = voc.value[state]
            has = v >= 0
            if has.any():
                a, piece = act[has], v[has]
                single[a[w[a] == step]] = True
                cand, to = score0[a] + voc.scores[piece], here[a] + step
                up = cand > best[to]
                to, a = to[up], a[up]
                best[to], back_id[to], back_len[to] = cand[up], piece[up], step
            more = left[act] > step
            act, state = act[more], state[more]
        a = np.flatnonzero(~single)
        if len(a):
            cand, to = score0[a] + voc.unk_score, here[a] + w[a]
            up = cand > best[to]
            to, a = to[up], a[up]
            best[to], back_id[to], back_len[to] = cand[up], -1, w[a]
    # walk back, all chunks together; unknown characters become their byte pieces
    rev_lane, rev_id, rev_pos = [], [], []
    lane, pos = np.arange(len(off)), slens.copy()
    alive = pos > 0
    lane, pos = lane[alive], pos[alive]
    while len(lane):
        node = node0[lane] + pos
        step, piece = back_len[node].astype(np.int64), back_id[node].astype(np.int64)
        known = piece >= 0
        rev_lane.append(lane[known]), rev_id.append(piece[known]), rev_pos.append(pos[known] * 8)
        if not known.all():
            ul, up, us = lane[~known], pos[~known], step[~known]
            for k in range(4):
                m = us > k
                b = data[off[ul[m]] + up[m] - us[m] + k]
                ids = np.where(voc.byte_ids[b] >= 0, voc.byte_ids[b], voc.unk_id)
                rev_lane.append(ul[m]), rev_id.append(ids), rev_pos.append((up[m] - us[m] + k) * 8 + 8)
            lit = data[off[ul] + up - us] == 0xFF  # a literal marker: three byte pieces in its place
            if lit.any():
                rev_id[-4][lit[us > 0]] = -1
                for k, b in enumerate(MARK):
                    rev_lane.append(ul[lit]), rev_pos.append(up[lit] * 8 + k)
                    rev_id.append(np.full(int(lit.sum()), voc.byte_ids[b] if voc.byte_ids[b] >= 0 else voc.unk_id))
        pos = pos - step
        lane, pos = lane[pos > 0], pos[pos > 0]
    if not rev_lane:
        return np.zeros(0, dtype=np.int32), np.zeros(len(chunks), dtype=np.int64)
    lanes, ids, poss = np.concatenate(rev_lane), np.concatenate(rev_id), np.concatenate(rev_pos)
    keep = ids >= 0
    lanes, ids, poss = order[lanes[keep]], ids[keep], poss[keep]
    o = np.lexsort((poss, lanes))
    return ids[o].astype(np.int32), np.bincount(lanes, minlength=len(chunks)).astype(np.int64)


def encode_texts(voc: Vocabulary, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, ids per text); null and empty texts have none, others get the leading marker."""
    known: dict[bytes, int] = {}
    index: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            found = _CHUNK.findall(b" " + t.encode().replace(MARK, _LITERAL))
            index.extend([known.setdefault(c, len(known)) for c in found])
            counts[i] = len(found)
    ids, n = segment(voc, [c.replace(b" ", MARK) for c in known])
    start = np.concatenate([[0], np.cumsum(n)])
    idx = np.array(index, dtype=np.int64)
    each = n[idx] if len(idx) else np.zeros(0, dtype=np.int64)
    upto = np.concatenate([[0], np.cumsum(each)])
    flat = ids[np.repeat(start[idx] - upto[:-1], each) + np.arange(upto[-1])] if len(idx) else ids
    edges = np.concatenate([[0], np.cumsum(counts)])
    return flat, np.diff(upto[edges])


def decode_ids(voc: Vocabulary, ids: np.ndarray) -> str:
    """Text of one id sequence: byte pieces as bytes, markers as spaces, without the leading one."""
    raw = b"".join([voc.surface[i] for i in ids])
    return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > SLICE_BYTES:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def encode(docs: DataFrame, voc: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids, exact (whether decoding gives the text back).

    One row per input row, whole texts. Null and empty texts have no ids and
    decode to the empty text. Literal marker characters are spelled in byte
    pieces, so every text comes back exactly as long as the vocabulary has all
    byte pieces. Other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(voc)  # bounded by the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for lo, hi in _slices(batch.column(1)):
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                flat, n = encode_texts(v, texts)
                edges = np.concatenate([[0], np.cumsum(n)])
                exact = [decode_ids(v, flat[a:b].tolist()) == (t or "")
                         for a, b, t in zip(edges[:-1], edges[1:], texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat, pa.int32())),
                     pa.array(exact, pa.bool_())], names=["doc_id", "n_tokens", "ids", "exact"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, exact boolean")


def decode(rows: DataFrame, voc: Vocabulary, ids: str = "ids") -> DataFrame:
    """doc_id, text of id sequences (null ids: null text)."""
    shared = rows.sparkSession.sparkContext.broadcast(voc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode_ids(shared.value, x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")


#: Vocabulary of the registered query; a parameter of every function here.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, model_path: str = MODEL_PATH) -> DataFrame:
    """Pipeline stage: the id sequences of the documents that are left."""
    return encode(docs, load_vocabulary(model_path))
