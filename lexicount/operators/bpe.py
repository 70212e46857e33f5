"""Byte-level BPE, learned in few rounds over the distinct pre-tokens and applied by a linear merge.

Learning. A round counts adjacent pairs of all words with one grouped sum and
fixes a threshold: the candidates are all pairs with a greater count. Words
are cut into maximal runs of symbols linked by candidates, equal runs are
added up, and the runs are merged pair by pair, always the most frequent
(ties: smaller ids), as long as its count exceeds the threshold. These are the
merges the sequential rule makes over whole words: a new pair that ends in
symbol y and begins in the merge of (.., x) occurs only where (x, y) did, so
every pair above the threshold lies inside runs, at any time. A round makes
hundreds of merges; the driver holds at most ``max_runs`` distinct runs, and
the threshold is raised until they fit. The words are then rewritten.

Applying. A pre-token is a linked list of symbols and a heap of its adjacent
pairs by rank: n log n for any length.
"""
from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SPECIAL_TOKENS
from ..session import cut_lineage, dealt

N_BYTES = 256
Merge = tuple[int, int, int, int]  # rank, left id, right id, count


def merge_symbols(syms: list[int], table: Mapping[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Symbols after all merges of ``table`` ((left, right) -> (rank, new id)), lowest rank first, left to right."""
    n = len(syms)
    if n < 2:
        return syms
    syms = list(syms)
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(*table[p], i) for i, p in enumerate(zip(syms, syms[1:], strict=False)) if p in table]
    heapq.heapify(heap)
    while heap:
        _, new, i = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j >= n or table.get((syms[i], syms[j]), (0, -1))[1] != new:
            continue  # one of the two is gone, or was merged with another neighbour
        syms[i], alive[j] = new, False
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < n and (hit := table.get((syms[a], syms[b]))) is not None:
                heapq.heappush(heap, (*hit, a))
    return [s for s, on in zip(syms, alive, strict=True) if on]


def merge_runs(runs: Sequence[tuple[tuple[int, ...], int]], above: int, next_id: int, limit: int) -> list[tuple[int, int, int]]:
    """(left, right, count) of the merges of weighted runs, most frequent first, while the count exceeds ``above``."""
    words, weight = [list(r) for r, _ in runs], [c for _, c in runs]
    count: dict[tuple[int, int], int] = defaultdict(int)
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i, w in enumerate(words):
        for p in zip(w, w[1:], strict=False):
            count[p] += weight[i]
            where[p].add(i)
    heap = [(-c, p) for p, c in count.items() if c > above]
    heapq.heapify(heap)
    merges: list[tuple[int, int, int]] = []
    while heap and len(merges) < limit:
        c, pair = heapq.heappop(heap)
        now = count.get(pair, 0)
        if now != -c:
            if now > above:
                heapq.heappush(heap, (-now, pair))
            continue
        merges.append((*pair, now))
        table, touched = {pair: (0, next_id)}, set()
        for i in where.pop(pair):
            old = words[i]
            new = merge_symbols(old, table)
            if len(new) == len(old):
                continue  # an entry of a pair that has left the run since
            for p in zip(old, old[1:], strict=False):
                count[p] -= weight[i]
            for p in zip(new, new[1:], strict=False):
                count[p] += weight[i]
                where[p].add(i)
                touched.add(p)
            words[i] = new
        for p in touched:
            if count[p] > above:
                heapq.heappush(heap, (-count[p], p))
        next_id += 1
    return merges


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all symbols one after the other, offsets) of a column of lists."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0]:offsets[-1]], offsets - offsets[0]


def _adjacent(syms: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions whose next symbol is of the same word, the pairs there as left << 32 | right)."""
    inner = np.ones(max(len(syms) - 1, 0), bool)
    inner[offsets[1:-1] - 1] = False  # no word is empty
    at = np.flatnonzero(inner)
    return at, syms[at].astype(np.int64) << 32 | syms[at + 1]


def _linked(syms: np.ndarray, offsets: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, past the last symbol) of the maximal runs linked by ``pairs`` (sorted)."""
    at, key = _adjacent(syms, offsets)
    hit = pairs[np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)] == key
    on = np.zeros(len(syms) + 1, np.int8)
    on[at[hit] + 1] = 1
    step = np.diff(on)  # on[i]: symbol i is linked with the one before
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1) + 1


def _sorted_pairs(pairs: Iterable[tuple[int, int]]) -> np.ndarray:
    return np.sort(np.array([a << 32 | b for a, b in pairs], np.int64))


def _byte_symbols(counts: DataFrame, off: int) -> DataFrame:
    """(syms, cnt): the bytes of every pre-token of two bytes or more as symbols."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(0).cast(pa.binary()).to_pylist()
            offsets = np.cumsum([0, *map(len, text)], dtype=np.int32)
            syms = np.frombuffer(b"".join(text), np.uint8).astype(np.int32) + np.int32(off)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, syms), b.column(1)], names=["syms", "cnt"])
    words = counts.select("pretoken", F.col("count").cast("long").alias("cnt")).filter(F.octet_length("pretoken") > 1)
    return dealt(words, "pretoken").mapInArrow(run, "syms array<int>, cnt long")


def _pairs(words: DataFrame) -> DataFrame:
    """(a, b, c): adjacent pairs and their counts; equal ones are added up by batch, then by one grouped sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            syms, offsets = _lists(b.column(0))
            at, key = _adjacent(syms, offsets)
            word = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[at]
            order = np.argsort(key, kind="stable")
            key, weight = key[order], b.column(1).to_numpy()[word[order]]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            total = np.add.reduceat(weight, first) if len(key) else weight
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                (key[first] >> 32).astype(np.int32), (key[first] & 0xFFFFFFFF).astype(np.int32), total)], names=["a", "b", "c"])
    return words.mapInArrow(run, "a int, b int, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))


def _runs(words: DataFrame, pairs: frozenset[tuple[int, int]]) -> DataFrame:
    """(run, cnt): maximal runs linked by ``pairs``, equal ones added up."""
    shared = words.sparkSession.sparkContext.broadcast(_sorted_pairs(pairs))  # at most pairs_per_round entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            syms, offsets = _lists(b.column(0))
            start, end = _linked(syms, offsets, shared.value)
            size = end - start
            ends = np.cumsum(size)
            inside = np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
            word = np.searchsorted(offsets, start, side="right") - 1
            runs = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), syms[inside])
            yield pa.RecordBatch.from_arrays([runs, pa.array(b.column(1).to_numpy()[word])], names=["run", "cnt"])
    return words.mapInArrow(run, "run array<int>, cnt long").groupBy("run").agg(F.sum("cnt").alias("cnt"))


def _rewritten(words: DataFrame, table: Mapping[tuple[int, int], tuple[int, int]], linked: Iterable[tuple[int, int]]) -> DataFrame:
    """``words`` after the merges of ``table``, each of which lies in a run of the ``linked`` pairs (see the module)."""
    shared = words.sparkSession.sparkContext.broadcast((dict(table), _sorted_pairs(linked)))  # of one round

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, pairs = shared.value

        @lru_cache(maxsize=200_000)
        def merged(symbols: bytes) -> np.ndarray:
            return np.array(merge_symbols(np.frombuffer(symbols, np.int32).tolist(), merges), np.int32)

        for b in batches:
            syms, offsets = _lists(b.column(0))
            start, end = _linked(syms, offsets, pairs)
            syms = syms.copy()
            for i, j in zip(start.tolist(), end.tolist(), strict=True):
                new = merged(syms[i:j].tobytes())
                syms[i:i + len(new)] = new
                syms[i + len(new):j] = -1
            left = np.append(0, np.cumsum(syms >= 0))[offsets].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(left, syms[syms >= 0]), b.column(1)],
                                             names=["syms", "cnt"])
    return words.mapInArrow(run, "syms array<int>, cnt long").filter(F.size("syms") > 1)


def learn_bpe(counts: DataFrame, vocab_size: int, specials: Sequence[str] = SPECIAL_TOKENS, min_count: int = 1,
              pairs_per_round: int = 4096, max_runs: int = 200_000) -> tuple[list[Merge], int]:
    """Exact BPE merges from a pre-token count table (pretoken, count), and the number of rounds.

    Ids: specials 0..s-1, bytes s..s+255, merge k gets id s+256+k. Learning
    ends when ``vocab_size`` is reached or no pair with ``min_count`` is left.
    ``pairs_per_round`` and ``max_runs`` bound what the driver holds; they
    change the number of rounds, not the merges.
    """
    off = len(specials)
    words = cut_lineage(_byte_symbols(counts, off), "bpe-words")
    merges: list[Merge] = []
    rounds, fitted = 0, pairs_per_round + 1
    while off + N_BYTES + len(merges) < vocab_size:
        rounds += 1
        next_id = off + N_BYTES + len(merges)
        pairs = cut_lineage(_pairs(words).filter(F.col("c") >= min_count), "bpe-pairs")
        top = pairs.orderBy(F.desc("c"), "a", "b").limit(pairs_per_round + 1).collect()
        if not top:
            break
        got: list[tuple[int, int, int]] = []
        # few merges need few pairs, and what did not fit in the last round is not tried first
        size = min(len(top), max(4 * (vocab_size - next_id), 1024), 4 * fitted)
        while not got and size > 1:
            # all pairs above the count of the size-th best; at the end of the list, all pairs there are
            above = top[size - 1].c if len(top) > pairs_per_round or size < len(top) else min_count - 1
            linked = frozenset((r.a, r.b) for r in top if r.c > above)
            if linked:
                runs = cut_lineage(_runs(words, linked), "bpe-runs")
                if runs.count() <= max_runs:
                    got = merge_runs([(tuple(r.run), r.cnt) for r in runs.collect()], above, next_id,
                                     vocab_size - next_id)
                    fitted = size
            size //= 4
        if not got:  # too many equal counts or runs: the best pair alone is always right
            got = [(top[0].a, top[0].b, top[0].c)]
            linked = frozenset([(top[0].a, top[0].b)])
        table = {(a, b): (k, next_id + k) for k, (a, b, _) in enumerate(got)}
        merges += [(len(merges) + k, a, b, int(c)) for k, (a, b, c) in enumerate(got)]
        if off + N_BYTES + len(merges) < vocab_size:
            words = cut_lineage(_rewritten(words, table, linked), "bpe-words")
    return merges, rounds


class BpeEncoder:
    """An encoder of one pre-token at a time; any object with ``encode(str) -> list[int]`` can take its place."""

    def __init__(self, merges: Sequence[Merge], specials: Sequence[str] = SPECIAL_TOKENS) -> None:
        self.off = len(specials)
        self.table = {(a, b): (rank, self.off + N_BYTES + rank) for rank, a, b, _ in merges}

    def encode(self, pretoken: str) -> list[int]:
        return merge_symbols([self.off + b for b in pretoken.encode()], self.table)
