"""Benchmark decontamination by spaced seeds.

A mask looks at some positions of a run of words and ignores the others, so that
substitutions at those do not matter. The hashes of all masked runs of the
benchmark are joined with those of every text; around each hit the two texts are
compared word by word along the same offset. The best-scoring stretch (1 for an
equal word, PENALTY for another) is an overlap if it is long and alike enough;
where it is not, any other stretch that is makes one.

The benchmark side of the join is an array in blocks of BLOCK_SEEDS hashes; a
benchmark of any size takes one pass over the texts a block, so what is
broadcast has a bound and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelark.llm.textbatch import NOT_WORD, SHINGLE_FACTORS, U64, hashed_words, mixed

#: Positions that each mask looks at. Fixed values.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 5, 6), (0, 2, 3, 4, 7), (0, 1, 4, 6, 7))
#: Shortest overlap in words (or the whole item, if that is shorter), least share of equal words.
LEAST_WORDS, LEAST_SHARE = 12, 0.8
#: Items of fewer words are too short to tell.
SHORTEST_ITEM = 5
PENALTY = 2
#: With 1 for an equal word and this for another, stretches of LEAST_SHARE and more are those of 0 and more.
SHARE_PENALTY = 4
#: Seeds of one pass: 16 bytes each, and as many words at most.
BLOCK_SEEDS = 1_000_000
TABLE_BITS = 22
#: Meetings of a text's seeds with the block's that are laid out at a time.
HITS_TOGETHER = 1 << 20


@dataclass
class Seeds:
    """A block of benchmark items: their words, and where each seed hash occurs."""

    items: np.ndarray  # ids
    words: list[np.ndarray]
    hashes: np.ndarray  # sorted
    item: np.ndarray
    place: np.ndarray

    def __post_init__(self):
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.hashes >> U64(64 - TABLE_BITS)).astype(np.int64)] = True

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()


def masked(h: np.ndarray, mask: int) -> np.ndarray:
    """Hashes of all runs of words under a mask."""
    places = MASKS[mask]
    m = len(h) - places[-1]
    if m <= 0:
        return np.empty(0, np.uint64)
    run = np.full(m, mask, np.uint64)
    for j, at in enumerate(places):
        run += h[at : at + m] * SHINGLE_FACTORS[j + 8]
    return mixed(run)


def seed_blocks(ids: list[int], texts: list[str | None], most: int = BLOCK_SEEDS) -> Iterator[Seeds]:
    """The benchmark in blocks of at most about ``most`` seeds (a single item always fits one)."""
    words = [h[a:b] for _, h, first in hashed_words(pa.array(texts, pa.string()), NOT_WORD) for a, b in zip(first[:-1], first[1:], strict=True)]
    todo, next_one = [i for i, w in enumerate(words) if len(w) >= SHORTEST_ITEM], 0
    while next_one < len(todo):
        now, n = [], 0
        while next_one < len(todo) and (not now or n + len(words[todo[next_one]]) * len(MASKS) <= most):
            n += len(words[todo[next_one]]) * len(MASKS)
            now.append(todo[next_one])
            next_one += 1
        parts = [(masked(words[i], k), at) for at, i in enumerate(now) for k in range(len(MASKS))]
        h = np.concatenate([p for p, _ in parts])
        item = np.concatenate([np.full(len(p), at, np.int32) for p, at in parts])
        place = np.concatenate([np.arange(len(p), dtype=np.int32) for p, _ in parts])
        order = np.argsort(h, kind="stable")
        yield Seeds(np.array([ids[i] for i in now]), [words[i] for i in now], h[order], item[order], place[order])


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """[a, b) of the highest-scoring stretch, the first of the longest among equals.

    If that one is too short or not alike enough: of all stretches of LEAST_WORDS
    (or of all words, if fewer) and LEAST_SHARE the one of most equal words, on a
    tie the longest, then the first; [0, 0) if there is none.
    """
    least = min(LEAST_WORDS, len(equal))
    same = np.concatenate([[0], np.cumsum(equal)])
    at = np.arange(len(same))
    total = same - PENALTY * (at - same)
    low = np.minimum.accumulate(total)
    b = int(np.argmax(total - low))
    a = int(np.flatnonzero(total[: b + 1] == low[b])[0])
    if b - a >= least and same[b] - same[a] >= LEAST_SHARE * (b - a):
        return a, b
    total = same - SHARE_PENALTY * (at - same)
    # The first beginning that an end allows gives it the most equal words.
    begin = np.searchsorted(-np.minimum.accumulate(total), -total)
    ends = np.flatnonzero(at - begin >= least)
    if not len(ends):
        return 0, 0
    order = np.lexsort((ends, begin[ends] - ends, same[begin[ends]] - same[ends]))
    b = int(ends[order[0]])
    return int(begin[b]), b


def overlaps(doc: np.ndarray, hits: Iterable[tuple[int, int]], seeds: Seeds) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, first word in the text, first in the item, words, equal words) around hits of (item, offset)."""
    for item, offset in sorted(hits):
        own = seeds.words[item]
        a, b = max(0, offset), min(len(doc), offset + len(own))
        equal = doc[a:b] == own[a - offset : b - offset]
        s, e = best_stretch(equal)
        same = int(equal[s:e].sum())
        if e - s >= min(LEAST_WORDS, len(own)) and same >= LEAST_SHARE * (e - s):
            yield item, a + s, a + s - offset, e - s, same


def matches(column, seeds: Seeds) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """All overlaps of each text with the block's items."""
    for _, h, first in hashed_words(column, NOT_WORD):
        spots, sought = [], []
        for k in range(len(MASKS)):
            m = masked(h, k)
            near = np.flatnonzero(seeds.table[(m >> U64(64 - TABLE_BITS)).astype(np.int64)])
            low = np.searchsorted(seeds.hashes, m[near])
            real = seeds.hashes[np.minimum(low, len(seeds.hashes) - 1)] == m[near]
            spots.append(near[real])
            sought.append(m[near[real]])
        spot, wanted = np.concatenate(spots), np.concatenate(sought)
        low, high = np.searchsorted(seeds.hashes, wanted), np.searchsorted(seeds.hashes, wanted, "right")
        hits: list[set[tuple[int, int]]] = [set() for _ in range(len(first) - 1)]
        for part in _portions(high - low):
            times = (high - low)[part]
            at = np.repeat(low[part] - np.cumsum(times) + times, times) + np.arange(times.sum())
            place = np.repeat(spot[part], times)
            text = np.searchsorted(first, place, "right") - 1
            # A run over the border of two texts gives an offset too; comparing words settles it.
            for i, item, offset in np.unique(np.stack([text, seeds.item[at], place - first[text] - seeds.place[at]], 1), axis=0).tolist():
                hits[i].add((item, offset))
        for i, own in enumerate(hits):
            yield list(overlaps(h[first[i] : first[i + 1]], own, seeds)) if own else []


def _portions(times: np.ndarray) -> Iterator[slice]:
    """Runs of places that meet HITS_TOGETHER seeds at most, or one place alone: a common phrase meets many."""
    total, a = np.cumsum(times), 0
    while a < len(times):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + HITS_TOGETHER, "right")))
        yield slice(a, b)
        a = b


HITS = "doc_id long, item_id long, doc_word long, item_word long, n_words long, n_equal long"


def _hits(batches: Iterator[pa.RecordBatch], seeds) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, found in zip(batch.column("doc_id").to_pylist(), matches(batch.column("text"), seeds.value), strict=True):
            best: dict[int, tuple] = {}
            for m in found:
                if m[0] not in best or (m[4], m[3], -m[1]) > (best[m[0]][4], best[m[0]][3], -best[m[0]][1]):
                    best[m[0]] = m
            rows += [(doc_id, int(seeds.value.items[i]), d, j, n, same) for i, d, j, n, same in best.values()]
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_equal"])


def _clean(batches: Iterator[pa.RecordBatch], seeds, text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([not found for found in matches(batch.column(text), seeds.value)], pa.bool_()))


def _blocks(benchmark: DataFrame) -> list[Seeds]:
    """The benchmark's seeds, read item by item; items without id or text do not count."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct().orderBy("item_id", "text")
    got = rows.toArrow()
    return list(seed_blocks(got["item_id"].to_pylist(), got["text"].to_pylist()))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words, n_equal): overlaps of ``docs(doc_id, text)`` and ``benchmark(item_id, text)``.

    One row for a row of docs and an item that overlap, the best stretch of each
    (most equal words; on a tie the longest, then the first): where it begins in
    either, its words, and how many are equal (see ``best_stretch`` for the one
    of each offset). A stretch counts with LEAST_WORDS
    words, or an item's all if it has fewer, and LEAST_SHARE of them equal. Items
    of fewer than SHORTEST_ITEM words, null texts, empty texts and empty tables
    give nothing. Texts are whole, however long; repeated rows come back each;
    other columns are never read.
    """
    sc, out = docs.sparkSession.sparkContext, None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for seeds in _blocks(benchmark):
        found = rows.mapInArrow(partial(_hits, seeds=sc.broadcast(seeds)), HITS)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], HITS)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap with no benchmark item, with their columns as they were."""
    sc, out = docs.sparkSession.sparkContext, docs
    for seeds in _blocks(benchmark):
        out = out.mapInArrow(partial(_clean, seeds=sc.broadcast(seeds), text="text"), docs.schema)
    return out
