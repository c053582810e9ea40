"""Benchmark decontamination: pairs of near words as seeds, counted, then Smith-Waterman alignment of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenarium.llm.textarrays import mix, ragged, raw_bytes, slices, words_of

#: A seed is a word and one of the next REACH words, or one word where no pair has to match.
REACH = 2
#: Share of the pairs that have to match that is given up for leaving out common seeds.
SPARED = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the score of an exact copy from which a passage counts as a copy of the item.
THRESHOLD = 0.5
#: Bytes of benchmark text that are sent to the executors at once; more of it is taken in blocks.
BLOCK_BYTES = 16 << 20
CELLS = 1 << 18
#: Two words of a pair are told from each other by this factor.
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Items:
    """Words of the items end to end, what their links have to weigh, and the seeds: code -> (item, offset), sorted by code.

    A link is two neighbouring matches of an alignment. It adds MATCH less the words it skips in the item or
    in the passage, whichever are more: 2 if it skips none, 1 if it skips at most one in both (its words are
    at most REACH apart in both), else 0 at most. A score of ``s`` therefore needs links that weigh ``s - MATCH``,
    however the copy was edited, and what links at other places of the item weigh can't replace this.
    """

    ids: np.ndarray
    first: np.ndarray
    code: np.ndarray
    need: np.ndarray
    slack: np.ndarray
    seed: np.ndarray
    seed_item: np.ndarray
    seed_at: np.ndarray
    seed_size: np.ndarray
    seed_last: np.ndarray | None = None


def _seeds(code: np.ndarray, last: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the one ``k`` further (of the word alone at 0), and which have both before ``last``."""
    n = len(code)
    out = np.zeros(n, np.uint64)
    if n > k:
        with np.errstate(over="ignore"):
            out[: n - k] = mix(code[: n - k] * _ODD + code[k:]) if k else code
    return out, np.arange(n) + k < last


def prepare(rows: list[tuple[int | None, str | None]], threshold: float = THRESHOLD) -> Items:
    text = pa.array([t or "" for _, t in rows], pa.string())
    words = words_of(*raw_bytes(text))
    size = np.diff(words.first)
    least = np.ceil(threshold * MATCH * size - 1e-9).astype(np.int64)
    need, slack = least - MATCH, np.maximum(MATCH * size - least, 0)
    row = words.row
    last, offset = words.first[1:][row], np.arange(len(row)) - words.first[row]
    seeds, item, at, width = [], [], [], []
    for k in range(REACH + 1):
        code, whole = _seeds(words.code, last, k)
        own = np.flatnonzero(whole & ((need[row] > 0) == (k > 0)))  # one word where a single match is enough
        seeds.append(code[own])
        item.append(row[own])
        at.append(offset[own])
        width.append(np.full(len(own), k))
    seed, item, at, width = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((seeds, np.uint64), (item, np.int64), (at, np.int64), (width, np.int64)))
    order = np.argsort(seed, kind="stable")
    return Items(np.array([i for i, _ in rows], object), words.first, words.code, np.maximum(need, 1), slack, seed[order], item[order], at[order], width[order])


def rarest(items: Items, code: np.ndarray, count: np.ndarray) -> Items:
    """Leaves out the most common places of each item, without losing a copy.

    A place (a word of the item with the pairs that begin there) takes part in one link as its first word,
    so that leaving out ``n`` places takes 2 ``n`` at most from what the links of a copy weigh.
    """
    order = np.argsort(code)
    code, count = code[order], count[order]
    place = np.searchsorted(code, items.seed)
    seen = np.zeros(len(items.seed), np.int64)
    if len(code):
        place = np.minimum(place, len(code) - 1)
        seen = np.where(code[place] == items.seed, count[place], 0)
    word = items.first[items.seed_item] + items.seed_at
    cost = np.bincount(word, seen, len(items.code))
    owner = np.repeat(np.arange(len(items.ids)), np.diff(items.first))
    order = np.lexsort((-cost, owner))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order)) - items.first[owner]
    spared = np.floor(SPARED * (items.need - 1) / MATCH).astype(np.int64)
    kept = np.flatnonzero(rank[word] >= spared[items.seed_item])
    return Items(items.ids, items.first, items.code, items.need - MATCH * spared, items.slack, items.seed[kept], items.seed_item[kept], items.seed_at[kept], items.seed_size[kept])


def merged(items: Items) -> Items:
    """One seed for all places of an item that have the same words, with its first and last offset: texts that repeat themselves meet it once a word."""
    order = np.lexsort((items.seed_at, items.seed_item, items.seed))
    seed, item, at, size = (x[order] for x in (items.seed, items.seed_item, items.seed_at, items.seed_size))
    begin = np.flatnonzero(np.concatenate(([True], (seed[1:] != seed[:-1]) | (item[1:] != item[:-1])))[: len(seed)])
    last = np.append(begin[1:] - 1, len(seed) - 1)[: len(begin)]
    nearest = np.minimum.reduceat(size, begin) if len(begin) else size  # the distance that weighs most
    return Items(items.ids, items.first, items.code, items.need, items.slack, seed[begin], item[begin], at[begin], nearest, at[last])


def _occurrences(items: Items, words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each distance of two words: the words at which seeds occur, and the range of these seeds."""
    small = np.zeros(1 << 20, bool)
    small[(items.seed & np.uint64(0xFFFFF)).astype(np.int64)] = True
    last = np.repeat(words.first[1:], np.diff(words.first))
    for k in range(REACH + 1):
        code, whole = _seeds(words.code, last, k)
        at = np.flatnonzero(small[(code & np.uint64(0xFFFFF)).astype(np.int64)] & whole)
        low, high = np.searchsorted(items.seed, code[at], "left"), np.searchsorted(items.seed, code[at], "right")
        found = np.flatnonzero(high > low)
        yield k, at[found], low[found], high[found]


def _hits(items: Items, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, seed, weight) of each place at which a seed occurs."""
    out_w, out_s, out_k = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, at, low, high in _occurrences(items, words):
        seed = ragged(low, high - low)
        own = items.seed_size[seed]
        fit = (own > 0) == (k > 0)
        out_w.append(np.repeat(at, high - low)[fit])
        out_s.append(seed[fit])
        out_k.append(np.where(np.maximum(own, k) > 1, 1, MATCH)[fit])
    return np.concatenate(out_w), np.concatenate(out_s), np.concatenate(out_k)


def seed_frequencies(docs: DataFrame, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Seeds and how often the whole corpus has them; at most as many numbers as there are seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = words_of(*raw_bytes(batch.column("text")))
            low = np.concatenate([low for _, _, low, _ in _occurrences(items, words)])
            seed, count = np.unique(low, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(items.seed[seed].view(np.int64)), pa.array(count)], ["code", "n"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return counts["code"].to_numpy().view(np.uint64), counts["n"].to_numpy()


def align(passage: np.ndarray, passage_size: np.ndarray, item: np.ndarray, item_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each padded row pair, and the passage word after its end.

    One step per item word over all pairs; gaps along the passage are a running maximum.
    """
    n, width = passage.shape
    ramp = -GAP * np.arange(1, width + 1, dtype=np.int32)
    row = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    inside = np.arange(width) < passage_size[:, None]
    for i in range(item.shape[1]):
        equal = (passage == item[:, i : i + 1]) & inside & (i < item_size)[:, None]
        new = np.maximum(row[:, :-1] + np.where(equal, np.int32(MATCH), np.int32(MISMATCH)), row[:, 1:] + np.int32(GAP))
        new = np.maximum.accumulate(np.maximum(new, 0) + ramp, axis=1) - ramp
        new[(i >= item_size) | ~np.any(inside, axis=1)] = 0
        row[:, 1:] = new
        at = new.argmax(1)
        top = new[np.arange(n), at]
        better = top > best
        best, end = np.where(better, top, best), np.where(better, at + 1, end)
    return best, end


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, item_id, score, first_word, last_word)``: documents with a copy of an item, edited or not.

    ``score`` is the alignment score over that of an exact copy, of the best passage; the words bound the
    passage that was aligned. Every word of every document is looked at. An item without words is in no
    document; a null text has no words; a repeated document or item gives its pairs again, once for each
    (doc_id, item_id) and row. Empty tables give an empty result.
    """
    schema = "doc_id long, item_id long, score double, first_word long, last_word long"
    bench = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    size = bench.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    blocks = max(1, -(-((size["b"] or 0) + 64 * size["n"]) // BLOCK_BYTES))
    texts, out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), None
    for n in range(blocks):  # one, unless the benchmark is larger than a block
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n).orderBy("item_id", "text").collect()
        items = prepare([(r["item_id"], r["text"]) for r in rows], threshold)
        items = merged(rarest(items, *seed_frequencies(texts, items)))

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                row, item, score, a, b = _copies(items, words_of(*raw_bytes(batch.column("text"))), threshold)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(items.ids[item].tolist(), pa.int64()), pa.array(score), pa.array(a), pa.array(b)], ["doc_id", "item_id", "score", "first_word", "last_word"])

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def _copies(items: Items, words, threshold: float):
    at, seed, weight = _hits(items, words)
    row, item = words.row[at] if len(at) else at, items.seed_item[seed]
    size = np.diff(items.first)
    order = np.lexsort((at, item, row))
    at, seed, weight, row, item = at[order], seed[order], weight[order], row[order], item[order]
    first, last = at - items.seed_last[seed], at - items.seed_at[seed]  # where the item would begin
    if len(at):  # a word is the first of one link: of its seeds the one that weighs most counts
        one = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(item) != 0) | (np.diff(at) != 0))))
        weight, first, last = np.maximum.reduceat(weight, one), np.minimum.reduceat(first, one), np.maximum.reduceat(last, one)
        at, row, item = at[one], row[one], item[one]
    # The links of a copy lie within as many words as the item has and the alignment can skip.
    pair = np.cumsum(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(item) != 0)))[: len(row)])
    wide = len(words.code) + 2 * int((size + items.slack).max(initial=0)) + 1
    upto = np.searchsorted(pair * wide + at, pair * wide + at + size[item] + items.slack[item])
    total = np.concatenate(([0], np.cumsum(weight)))
    enough = np.flatnonzero(total[upto] - total[:-1] >= items.need[item])
    row, item, first, last = row[enough], item[enough], first[enough], last[enough]
    order = np.lexsort((first, item, row))
    row, item, first, last = row[order], item[order], first[order], last[order]
    low, high = first, last
    if len(row):  # seeds whose passages overlap are one candidate
        wide = len(words.code) + int(size.max()) + 1
        pair = np.cumsum(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(item) != 0)))) * 4 * wide
        reach = np.maximum.accumulate(pair + last) - pair
        cut = np.concatenate(([True], (np.diff(pair) != 0) | (first[1:] - reach[:-1] > size[item][1:])))
        end = np.concatenate((np.flatnonzero(cut)[1:] - 1, [len(row) - 1]))
        row, item, low, high = row[cut], item[cut], first[cut], reach[end]
    low = np.maximum(low - items.slack[item], words.first[row])
    high = np.minimum(high + size[item] + items.slack[item], words.first[row + 1])
    score, end = np.zeros(len(row)), np.zeros(len(row), np.int64)
    by_size = np.lexsort((high - low, size[item]))
    start = 0
    while start < len(by_size):  # padded blocks of pairs of like size
        stop = start + 1
        while stop < len(by_size) and (stop - start + 1) * max(1, int((high - low)[by_size[start : stop + 1]].max())) <= CELLS:
            stop = min(len(by_size), stop + max(1, (stop - start) // 2))
        part = by_size[start:stop]
        p, q = high[part] - low[part], size[item[part]]
        passage, target = np.zeros((len(part), int(p.max())), np.uint64), np.zeros((len(part), int(q.max())), np.uint64)
        passage[np.arange(passage.shape[1]) < p[:, None]] = words.code[ragged(low[part], p)]
        target[np.arange(target.shape[1]) < q[:, None]] = items.code[ragged(items.first[item[part]], q)]
        best, upto = align(passage, p, target, q)
        score[part], end[part] = best / (MATCH * q), low[part] + upto
        start = stop
    kept = np.flatnonzero((score > 0) & (score >= threshold - 1e-9))
    kept = kept[np.lexsort((low[kept], -score[kept], item[kept], row[kept]))]
    kept = kept[np.concatenate(([True], (np.diff(row[kept]) != 0) | (np.diff(item[kept]) != 0)))[: len(kept)]]
    base = words.first[row[kept]]
    return row[kept], item[kept], score[kept], low[kept] - base, end[kept] - base
