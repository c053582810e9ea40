"""Exact substring dedup: Burrows-Wheeler transforms of shards, merged by iterative interleave refinement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenarium.llm.buckets import by_doc, expand, packed, squeeze, unpacked
from scenarium.llm.textarrays import mix, raw_bytes, slices

#: Bytes of an anchor. Of the anchors within a window of the repeat length the one of least hash routes the window.
ANCHOR = 24
#: Strings of one bucket in bytes, about; shards of a bucket whose transforms are merged.
BUCKET_BYTES, SHARDS = 2 << 20, 4
#: Occurrences of an anchor from which its windows are routed one by one, by their own hash.
HOT = 2048
#: Text of one bucket of documents, about.
DOCS_BYTES = 8 << 20
#: Runs of a slice that are cut out at once.
PLACES = 1 << 16

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the k bytes from each position on, where there are so many."""
    n = len(data)
    with np.errstate(over="ignore"):
        power, inverse = np.full(n, _BASE), np.full(n, _BASE_INV)
        power[0] = inverse[0] = 1
        np.cumprod(power, out=power)
        np.cumprod(inverse, out=inverse)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
        return mix((total[k:] - total[:-k]) * inverse[: n - k + 1])


def runs(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, last window, anchor hash) of each run of windows of ``length`` bytes with one anchor.

    Equal windows have equal anchors at equal offsets, since the choice depends on the window's bytes alone.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, np.zeros(0, np.uint64)
    code = _grams(data, ANCHOR)
    least = (code & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(code), dtype=np.uint64)
    want, size = length - ANCHOR + 1, 1
    while size < want:
        step = min(size, want - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    count = np.maximum(np.diff(off) - length + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    window = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + off[:-1][row]
    anchor = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(row) != 0)))[: len(row)])
    last = np.concatenate((begin[1:] - 1, [len(row) - 1])) if len(begin) else begin
    return row[begin], window[begin], window[last], code[anchor[begin]]


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes of the strings that end, with their own terminator, before ``ends``.

    ``text`` holds byte + 1, and 0 for terminators, which sort by position. Prefix doubling from eight bytes on.
    """
    n = len(text)
    string = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))
    stop = ends[string]  # where each position's string ends
    padded = np.concatenate((text, np.zeros(8, text.dtype)))
    key = np.zeros(n, np.uint64)
    alive = np.ones(n, bool)
    for k in range(7):
        at = np.arange(n) + k
        alive &= at < stop
        key = key * np.uint64(512) + np.where(alive, padded[at], 0).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    terminator = np.flatnonzero(text == 0)  # these come first, in order, and differ from each other
    rank[terminator] = np.arange(len(terminator))
    size, place = 7, np.arange(n)
    while True:
        # only suffixes that tie with a neighbour are keyed again
        tied = rank[order[place[1:]]] == rank[order[place[:-1]]]
        loose = np.zeros(len(place), bool)
        loose[1:] |= tied
        loose[:-1] |= tied
        place = place[loose]
        if not len(place):
            return order
        own = order[place]
        at = own + size
        # a suffix that ended has met its own terminator, which tells it from all others
        beyond = np.where(at < stop[own], rank[np.minimum(at, n - 1)] + n, string[own])
        key = rank[own] * (2 * n) + beyond
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[place] = own
        rank[own] = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), place, 0))
        size *= 2


def last_to_first(transform: np.ndarray, strings: int) -> np.ndarray:
    """For each row the row of the suffix one symbol longer; meaningless where a string begins."""
    order = np.argsort(transform, kind="stable")
    out = np.empty(len(order), np.int32)
    out[order] = np.arange(len(order), dtype=np.int32)
    return out


def merge(transforms: list[np.ndarray], strings: list[int], rounds: int, room: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, row, interval) of all suffixes whose first ``rounds`` symbols another suffix of any shard begins with.

    The interleave starts as the shards end to end. Each round walks it, takes each row's symbol from its
    shard's transform, and deals the rows, as the suffixes one symbol longer, out to the symbols in order:
    after h rounds the interleave is in the order of the first h symbols. Two rows next to each other share
    h symbols if their symbols are equal and they came from one interval: that gives the common prefixes, and
    no suffix is ever compared again. A row alone in its interval can't be in a larger one later, so that it
    leaves the interleave. ``room`` marks each shard's suffixes with ``rounds`` symbols before them: others would
    reach the beginning of their strings, and don't enter.
    """
    size = np.array([len(t) for t in transforms])
    base = np.cumsum(size) - size
    symbol = np.concatenate(transforms)
    used = np.unique(symbol)
    if len(used) <= 256:  # nearly always: one byte a symbol sorts faster
        symbol = np.searchsorted(used, symbol).astype(np.uint8) if len(used) and used[0] == 0 else symbol
    ahead = np.concatenate([last_to_first(t, m) + np.int32(b) for t, m, b in zip(transforms, strings, base, strict=True)])
    rows = np.flatnonzero(np.concatenate(room)).astype(np.int32)
    interval = np.zeros(len(rows), np.int32)
    for _ in range(rounds):
        s = symbol[rows]
        order = np.argsort(s, kind="stable")
        s = s[order]
        rows, came = ahead[rows[order]], interval[order]
        begins = np.empty(len(rows) + 1, bool)
        begins[0] = begins[-1] = True
        np.not_equal(s[1:], s[:-1], out=begins[1:-1])
        begins[1:-1] |= came[1:] != came[:-1]
        shared = ~(begins[:-1] & begins[1:])
        rows = rows[shared]
        interval = np.cumsum(begins[:-1], dtype=np.int32)[shared]
    which = np.searchsorted(base, rows, "right") - 1
    return which, rows - base[which], interval


def repeated_windows(strings: list[bytes], owner: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every window of ``length`` bytes that also is at an earlier (owner, start + offset)."""
    shards = min(SHARDS, len(strings))
    each = np.array_split(np.arange(len(strings)), shards)
    transforms, where, string = [], [], []
    for members in each:
        size = np.array([len(strings[i]) + 1 for i in members])
        ends = np.cumsum(size)
        text = np.zeros(int(ends[-1]), np.uint16)
        inside = np.ones(len(text), bool)
        inside[ends - 1] = False
        text[inside] = np.frombuffer(b"".join([strings[i] for i in members.tolist()]), np.uint8).astype(np.uint16) + 1
        order = suffix_order(text, ends)
        before = np.concatenate((text[-1:], text[:-1]))
        before[np.concatenate(([0], ends[:-1]))] = 0  # a whole string is preceded by its terminator
        transforms.append(before[order])
        own = np.searchsorted(ends, order, "right")
        string.append(members[own])
        where.append(order - (ends - size)[own])
    which, row, interval = merge(transforms, [len(x) for x in each], length, [x >= length for x in where])
    base = np.cumsum([0, *map(len, transforms)])
    at = base[which] + row
    row_string, row_at = np.concatenate(string)[at], np.concatenate(where)[at]
    order = np.lexsort((start[row_string] + row_at, owner[row_string], interval))
    later = np.concatenate(([False], np.diff(interval[order]) == 0))[: len(order)]
    return row_string[order][later], row_at[order][later]


def _frame(columns: list[np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unframe(blobs: list[bytes], types: list[str]) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in types]
    width = sum(np.dtype(t).itemsize for t in types)
    for blob in blobs:
        n, at = len(blob) // width, 0
        for k, t in enumerate(types):
            out[k].append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(x) for x in out]


def _deal(slot: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(slot, kind="stable")
    cut = np.concatenate(([0], np.flatnonzero(np.diff(slot[order])) + 1, [len(slot)])) if len(slot) else np.zeros(1, np.int64)
    columns = [c[order] for c in columns]
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(slot[order[a]]), _frame([c[a:b] for c in columns])


_ASK = ["<u8", "<i8", "<i4", "<i4", "<i8"]
_REST = ["<u8", "<i8", "<i8", "<i4"]
_ANSWER = ["<u8", "<i8", "<i4"]
_PLACE = ["<i8", "<i4", "<i4"]
_STRING = ["<u8", "<i8", "<i4", "<i4"]


def _rows(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in out], pa.int64()), pa.array([k for _, k, _ in out], pa.int32()), pa.array([x for _, _, x in out], pa.binary())], ["bucket", "kind", "rows"])


_ROWS = "bucket long, kind int, rows binary"


def _asks(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """Kind 0: the first run of each anchor of a slice asks whether others have it, and how many.

    Kind 1: other runs of the slice with that anchor; they wait in the slice's bucket for the answer. So an
    anchor's bucket gets one row from each slice, however frequent the anchor is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(slices(batches)):
            own = (part << 32) + number
            data, off = raw_bytes(batch.column("text"))
            row, first, _, code = runs(data, off, length)
            doc, at = batch.column("doc_id").to_numpy()[row], (first - off[row]).astype(np.int32)
            order = np.lexsort((at, doc, code))
            new = np.concatenate(([True], np.diff(code[order].view(np.int64)) != 0))[: len(order)]
            count = np.diff(np.concatenate((np.flatnonzero(new), [len(order)]))) if len(order) else np.zeros(0, np.int64)
            lead, rest = order[new], order[~new]
            name = np.where(count > 1, own, -1)
            out = [(b, 0, x) for b, x in _deal((code[lead] % np.uint64(buckets)).astype(np.int64), [code[lead], doc[lead], at[lead], np.minimum(count, HOT).astype(np.int32), name])]
            if len(rest):
                out.append((own % buckets, 1, _frame([code[rest], np.full(len(rest), own), doc[rest], at[rest]])))
            yield _rows(out)

    return texts.mapInArrow(run, _ROWS)


def _answer(buckets: int):
    """Kind 4: to slices that wait, how many places an anchor has. Kind 5: to the run that asked."""

    def run(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("rows").to_pylist()
        code, doc, at, n, name = _unframe([x for k, x in zip(kinds, blobs, strict=True) if k == 0], _ASK)
        out = [(table.column("bucket")[0].as_py(), 1, x) for k, x in zip(kinds, blobs, strict=True) if k == 1]
        _, where = np.unique(code, return_inverse=True)
        total = np.minimum(np.bincount(where, weights=n)[where], HOT).astype(np.int32) if len(code) else np.zeros(0, np.int32)
        many, waits = total > 1, name >= 0
        out += [(b, 5, x) for b, x in _deal(by_doc(doc[many], buckets), [doc[many], at[many], total[many]])]
        out += [(b, 4, x) for b, x in _deal(name[waits] % buckets, [code[waits], name[waits], total[waits]])]
        return pa.Table.from_batches([_rows(out)])

    return run


def _pass_on(buckets: int):
    """Answers reach the runs that waited; all answers then go to the buckets of their documents."""

    def run(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("rows").to_pylist()
        pick = lambda kind, types: _unframe([x for k, x in zip(kinds, blobs, strict=True) if k == kind], types)
        out = [(table.column("bucket")[0].as_py(), 5, x) for k, x in zip(kinds, blobs, strict=True) if k == 5]
        code, name, doc, at = pick(1, _REST)
        said, slot, total = pick(4, _ANSWER)
        names, place = np.unique(np.concatenate([name, slot]), return_inverse=True)
        key = mix(code) + place[: len(name)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        own = mix(said) + place[len(name) :].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(own)
        crowd = total[order][np.searchsorted(own[order], key)] if len(key) else np.zeros(0, np.int32)
        out += [(b, 5, x) for b, x in _deal(by_doc(doc, buckets), [doc, at, crowd])]
        return pa.Table.from_batches([_rows(out)])

    return run


def keep(kept: dict[tuple[int, bytes], tuple[int, int]], gone: list[tuple[int, int, int]], code: int, doc: int, at: int, string: bytes) -> None:
    """Of equal strings the first place is kept; the others are spans that go."""
    mine = (doc, at)
    other = kept.setdefault((code, string), mine)
    if other != mine:
        if mine < other:
            kept[code, string], mine = mine, other
        gone.append((*mine, mine[1] + len(string)))


def joined(spans: list[tuple[int, int, int]]) -> np.ndarray:
    """(document, begin, end) with spans that overlap or touch made one."""
    g = np.array(spans, np.int64).reshape(-1, 3)
    g = g[np.lexsort((g[:, 1], g[:, 0]))]
    if not len(g):
        return g
    doc = np.cumsum(np.concatenate(([0], np.diff(g[:, 0]) != 0)))
    reach = np.maximum.accumulate(g[:, 2] + doc * (1 << 40)) - doc * (1 << 40)  # texts end far below 2**40
    begin = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (g[1:, 1] > reach[:-1]))))
    return np.stack([g[begin, 0], g[begin, 1], reach[np.concatenate((begin[1:] - 1, [len(g) - 1]))]], 1)


def _strings(length: int, buckets: int):
    """Runs of windows whose anchor repeats, as strings for the bucket of the anchor; of equal ones only the first.

    Kind 2: a string; kind 3: a place in a document that is surely a repeat.
    """

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        asked, place, crowd = _unframe(answers.column("rows").to_pylist(), _PLACE)
        out: list[tuple[int, int, bytes]] = []
        if not docs.num_rows or not len(asked):
            return pa.Table.from_batches([_rows(out)])
        ids = np.unique(asked)
        key = np.searchsorted(ids, asked) * (1 << 32) + place
        order = np.argsort(key)
        key, crowd = key[order], crowd[order]
        kept: dict[tuple[int, bytes], tuple[int, int]] = {}
        spans = [np.zeros((0, 3), np.int64)]
        for batch in unpacked(docs):
            data, off = raw_bytes(batch.column("text"))
            row, first, last, code = runs(data, off, length)
            doc = batch.column("doc_id").to_numpy()[row]
            place = np.minimum(np.searchsorted(ids, doc), len(ids) - 1)
            mine = np.where(ids[place] == doc, place * (1 << 32) + first - off[row], -1)
            found = np.minimum(np.searchsorted(key, mine), len(key) - 1)
            hit = np.flatnonzero(key[found] == mine)
            raw = data.tobytes()
            hot = crowd[found[hit]] >= HOT
            for part in range(0, len(hit), PLACES):  # a text of one character has as many as it has bytes
                k = hit[part : part + PLACES]
                own, begin = doc[k].tolist(), (first - off[row])[k].tolist()
                cut = [raw[x : y + length] for x, y in zip(first[k].tolist(), last[k].tolist(), strict=True)]
                gone: list[tuple[int, int, int]] = []
                for c, d, p, s, crowded in zip(code[k].tolist(), own, begin, cut, hot[part : part + PLACES].tolist(), strict=True):
                    if not crowded:
                        keep(kept, gone, c, d, p, s)
                        continue
                    for o in range(len(s) - length + 1):  # window by window, each under its own hash
                        w = s[o : o + length]
                        keep(kept, gone, int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little"), d, p + o, w)
                spans.append(joined(gone))
        code = np.array([k for k, _ in kept], np.uint64)
        size = np.array([len(s) for _, s in kept], np.int32)
        owner = np.array(list(kept.values()), np.int64).reshape(-1, 2)
        slot = (code % np.uint64(buckets)).astype(np.int64)
        strings = [s for _, s in kept]
        order = np.argsort(slot, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(slot[order])) + 1) if len(order) else []:
            head = _frame([code[own], owner[own, 0], owner[own, 1].astype(np.int32), size[own]])
            out.append((int(slot[own[0]]), 2, squeeze(len(own).to_bytes(4, "little") + head + b"".join([strings[i] for i in own.tolist()]))))
        g = np.concatenate(spans)
        out += [(b, 3, x) for b, x in _deal(by_doc(g[:, 0].copy(), buckets), [g[:, 0], g[:, 1].astype(np.int32), g[:, 2].astype(np.int32)])]
        return pa.Table.from_batches([_rows(out)])

    return run


def _repeats(length: int, buckets: int):
    """All strings of a bucket: places of repeated windows as byte spans of documents."""

    def run(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("rows").to_pylist()
        out = [(table.column("bucket")[0].as_py(), 3, x) for k, x in zip(kinds, blobs, strict=True) if k == 3]
        kept: dict[tuple[int, bytes], tuple[int, int]] = {}
        gone: list[tuple[int, int, int]] = []
        for blob in (expand(x) for k, x in zip(kinds, blobs, strict=True) if k == 2):
            n = int.from_bytes(blob[:4], "little")
            code, doc, at, size = _unframe([blob[4 : 4 + 24 * n]], _STRING)
            end = np.cumsum(size) + 4 + 24 * n
            for c, d, p, a, b in zip(code.tolist(), doc.tolist(), at.tolist(), (end - size).tolist(), end.tolist(), strict=True):
                keep(kept, gone, c, d, p, blob[a:b])
        code = np.array([k for k, _ in kept], np.uint64)
        _, where, count = np.unique(code, return_inverse=True, return_counts=True)
        alike = np.flatnonzero(count[where] > 1) if len(code) else np.zeros(0, np.int64)
        if len(alike):
            # strings of one anchor stay together
            alike = alike[np.argsort(where[alike], kind="stable")]
            strings, owners = [s for _, s in kept], np.array(list(kept.values()), np.int64)
            size = np.cumsum([len(strings[i]) for i in alike])
            group = where[alike]
            part = np.zeros(len(alike), np.int64)
            border = np.flatnonzero(np.diff(group)) + 1
            part[border] = size[border] // BUCKET_BYTES > size[border - 1] // BUCKET_BYTES
            for own in np.split(alike, np.flatnonzero(part)):
                s, at = repeated_windows([strings[i] for i in own.tolist()], owners[own, 0], owners[own, 1], length)
                order = np.lexsort((at, s))
                s, at = s[order], at[order]
                begin = np.concatenate(([True], (np.diff(s) != 0) | (np.diff(at) > length)))[: len(s)]
                last = np.concatenate((np.flatnonzero(begin)[1:] - 1, [len(s) - 1]))[: begin.sum()]
                place = owners[own[s[begin]]]
                gone += zip(place[:, 0].tolist(), (place[:, 1] + at[begin]).tolist(), (place[:, 1] + at[last] + length).tolist(), strict=True)
        g = joined(gone)
        out += [(b, 3, x) for b, x in _deal(by_doc(g[:, 0].copy(), buckets), [g[:, 0], g[:, 1].astype(np.int32), g[:, 2].astype(np.int32)])]
        return pa.Table.from_batches([_rows(out)])

    return run


def _cut(docs: pa.Table, spans: pa.Table) -> pa.Table:
    doc, begin, end = _unframe(spans.column("rows").to_pylist(), _PLACE)
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    columns: list[list] = [[], [], [], [], []]
    for d, raw in ((d, x) for batch in unpacked(docs) for d, x in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
        removed: list[list[int]] = []
        if d is not None:
            low, high = np.searchsorted(doc, d, "left"), np.searchsorted(doc, d, "right")
            for a, b in zip(begin[low:high].tolist(), end[low:high].tolist(), strict=True):
                if removed and a <= removed[-1][1]:
                    removed[-1][1] = max(removed[-1][1], b)
                elif a < len(raw):
                    removed.append([a, b])
        kept, at = hashlib.sha256(), 0
        for a, b in removed:
            kept.update(raw[at:a])
            at = b
        kept.update(raw[at:])
        for c, v in zip(columns, (d, len(raw), sum(b - a for a, b in removed), removed, kept.hexdigest()), strict=True):
            c.append(v)
    return pa.table([pa.array(c, t) for c, t in zip(columns, _CUT.types, strict=True)], schema=_CUT)


_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept_sha256", pa.string())])


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, spans, kept_sha256)`` of every whole text as UTF-8 bytes.

    Removed is each byte within a string of ``length`` bytes that also starts earlier: in a document of
    smaller doc_id, or before in the same one. ``spans`` are the maximal removed runs.

    Windows are routed by the least anchor within them, so that equal windows meet. Only anchors that occur
    more than once go on; equal strings are one, whose first place stays. Where an anchor has different
    strings around it, these are dealt to shards, each shard's Burrows-Wheeler transform is built, and the
    transforms are merged; windows of one interval with a common prefix of ``length`` bytes are repeats but
    for the first. Anchors in more than HOT places have their windows routed one by one, so that no bucket
    grows with a frequent phrase.

    A null text is empty; shorter texts lose nothing; texts without doc_id are looked at by nobody and lose
    nothing; rows that repeat a doc_id start together, so that equal ones don't remove each other; an empty
    table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    facts = texts.agg(F.sum(F.octet_length("text") + 64).alias("b")).first()
    buckets = max(1, -(-(facts["b"] or 0) // DOCS_BYTES))
    named = texts.where("doc_id is not null")
    asks = _asks(named.where(F.octet_length("text") >= length), length, buckets)
    answers = asks.groupBy("bucket").applyInArrow(_answer(buckets), _ROWS)
    answers = answers.groupBy("bucket").applyInArrow(_pass_on(buckets), _ROWS)
    placed = packed(named.where(F.octet_length("text") >= length), buckets)
    strings = placed.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_strings(length, buckets), _ROWS)
    spans = strings.groupBy("bucket").applyInArrow(_repeats(length, buckets), _ROWS)
    every = packed(texts, buckets)
    return every.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(_cut, "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept_sha256 string")
