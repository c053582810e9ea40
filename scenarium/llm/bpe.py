"""Byte-level BPE encoding and decoding in length-bucketed padded numpy matrices."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenarium.llm.textarrays import ragged, slices

#: Cells of one padded matrix, and distinct pieces whose ids a task remembers.
MATRIX_CELLS = 1 << 20
REMEMBERED = 400_000
#: Longer pieces are merged one by one, each round merging every occurrence of its least pair where that is the same.
WIDEST = 256
_NONE = np.int32(2**31 - 1)
#: Letters, numbers and white space of the first 256 code points, as ranges of a character class.
LATIN = {
    r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff",
    r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe",
    r"\s": "\t-\r \x85\xa0",
}
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def latin_pattern(pattern: str) -> str:
    """``pattern`` for texts within the first 256 code points, where explicit ranges match much faster."""
    parts = re.split(r"(\[(?:\\.|[^\]])*\])", pattern)
    for i, part in enumerate(parts):
        for name, ranges in LATIN.items():
            part = part.replace(name, ranges if i % 2 else f"[{ranges}]")
        parts[i] = part.replace(r"\S", f"[^{LATIN[r'\s']}]")
    return "".join(parts)


class PairTable:
    """Open-addressing hash table from a pair of token ids to the rank of their concatenation."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.bits = max(8, (4 * len(pairs)).bit_length())
        self.key = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.rank = np.full(1 << self.bits, _NONE, np.int32)
        key = np.array([k for k, _ in pairs], np.uint64)
        rank = np.array([r for _, r in pairs], np.int32)
        at = self._slot(key)
        while len(key):
            free = self.key[at] == np.uint64(2**64 - 1)
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.key[at[put]], self.rank[at[put]] = key[put], rank[put]
            key, rank, at = key[~put], rank[~put], (at[~put] + 1) & (len(self.key) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, and a rank above all others where a pair isn't a token or an id is negative."""
        shape = a.shape
        key = ((a.astype(np.uint64) << np.uint64(32)) | (b.astype(np.uint64) & np.uint64(0xFFFFFFFF))).ravel()
        at = self._slot(key)
        found = self.key[at]
        out = np.where(found == key, self.rank[at], _NONE)
        open_ = np.flatnonzero((found != key) & (found != np.uint64(2**64 - 1)))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.key) - 1)
            found = self.key[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.rank[at[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(2**64 - 1))]
        return out.reshape(shape)


class Codec:
    def __init__(self, vocabulary: bytes, pattern: str) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.pairs = PairTable(self.ranks)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        size = max(self.ranks.values()) + 1
        by_id = [b""] * size
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.token_length = np.fromiter(map(len, by_id), np.int64, size)
        self.token_begin = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(by_id), np.uint8)
        #: White space is the Unicode property, without the four separators that Python counts too.
        self.split = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.split_latin = re.compile(latin_pattern(pattern)).findall
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.begin, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the pieces by length, their ids end to end in it, and how many each has."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int32, len(pieces))
        width = np.where(whole >= 0, 0, np.where(size > WIDEST, WIDEST + 1, np.maximum(4, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))))
        order = np.argsort(width, kind="stable")
        ids, counts = [], []
        for w in np.unique(width).tolist():
            own = order[np.searchsorted(width[order], w) : np.searchsorted(width[order], w, "right")]
            for at in range(0, len(own), step := max(1, MATRIX_CELLS // max(w, 1))):
                part = own[at : at + step]
                if w == 0:
                    ids.append(whole[part])
                    counts.append(np.ones(len(part), np.int64))
                    continue
                flat = self.byte_ids[np.frombuffer(b"".join([pieces[i] for i in part.tolist()]), np.uint8)]
                if w > WIDEST:
                    each = [self._merge_long(x) for x in np.split(flat, np.cumsum(size[part])[:-1])]
                    ids += each
                    counts.append(np.fromiter(map(len, each), np.int64, len(each)))
                else:
                    matrix = np.full((len(part), w), -1, np.int32)
                    matrix[np.arange(w) < size[part][:, None]] = flat
                    rows, count = self._merge_matrix(matrix, size[part])
                    ids.append(rows[np.arange(w) < count[:, None]])
                    counts.append(count)
        return order, np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([np.zeros(0, np.int64), *counts])

    def _merge_matrix(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each round every row merges its leftmost pair of least rank; rows without a pair leave the matrix."""
        done, count = ids.copy(), size.copy()
        live = np.arange(len(ids))
        rank = self._ranks(ids)
        columns = np.arange(ids.shape[1])
        while len(live):
            j = rank.argmin(1)
            every = np.arange(len(live))
            least = rank[every, j]
            more = least != _NONE
            if not more.all():
                done[live[~more]] = ids[~more]
                live, ids, rank, j, least = live[more], ids[more], rank[more], j[more], least[more]
                every = np.arange(len(live))
                if not len(live):
                    break
            ids[every, j] = least
            after = np.minimum(columns + (columns > j[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, after, 1)
            count[live] -= 1
            ids[every, count[live]] = -1
            rank = np.take_along_axis(rank, after, 1)
            rank[every, count[live] - 1] = rank[every, count[live]] = _NONE
            for at, ok in ((j - 1, j > 0), (j, j + 1 < count[live])):
                r = every[ok]
                rank[r, at[ok]] = self.pairs.look_up(ids[r, at[ok]], ids[r, at[ok] + 1])
        return done, count

    def _ranks(self, ids: np.ndarray) -> np.ndarray:
        """Rank of each column with the next; the last column has none."""
        rank = np.full(ids.shape, _NONE, np.int32)
        a, b = ids[:, :-1], ids[:, 1:]
        ok = b >= 0
        rank[:, :-1][ok] = self.pairs.look_up(a[ok], b[ok])
        return rank

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long piece: all occurrences of its least pair at once, unless that makes a pair of lower rank."""
        while len(ids) > 1:
            rank = self.pairs.look_up(ids[:-1], ids[1:])
            least = rank.min()
            if least == _NONE:
                break
            at = np.flatnonzero(rank == least)
            run = np.concatenate(([True], np.diff(at) > 1))
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[place % 2 == 0]  # in a run of overlapping pairs every other one
            made = np.full(len(at), least, np.int32)
            left = np.where(np.isin(at - 2, at), least, ids[np.maximum(at - 1, 0)])
            lower = (self.pairs.look_up(left, made) < least) & (at > 0)
            right = at + 2 < len(ids)
            lower[right] |= self.pairs.look_up(made[right], ids[at[right] + 2]) < least
            at = at[:1] if lower.any() else at
            ids = ids.copy()
            ids[at] = least
            ids = np.delete(ids, at + 1)
        return ids

    def pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split(text)
        return self.split_latin(text)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offsets of each; a null text has none."""
        if len(self.known) > REMEMBERED:
            self.forget()
        pieces, count = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = self.pieces(text) if text else []
            count[i] = len(own)
            pieces += own
        fresh = list(set(pieces) - self.known.keys())
        if fresh:
            order, ids, size = self.encode_pieces([p.encode() for p in fresh])
            self.known.update(zip([fresh[i] for i in order.tolist()], range(len(self.length), len(self.length) + len(fresh)), strict=True))
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
            self.length = np.concatenate([self.length, size])
            self.ids = np.concatenate([self.ids, ids])
        index = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        length = self.length[index]
        ids = self.ids[ragged(self.begin[index], length)]
        upto = np.concatenate(([0], np.cumsum(length)))
        return ids, upto[np.concatenate(([0], np.cumsum(count)))]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids end to end, and the offset of each id in them; an unknown id is an error."""
        length = self.token_length[ids]
        return self.token_bytes[ragged(self.token_begin[ids], length)], np.concatenate(([0], np.cumsum(length)))


@lru_cache(maxsize=2)
def codec(vocabulary: bytes, pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


def _vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """``(doc_id, ids array<int>, ids_sha256, decoded_sha256, n_tokens)``; ``ids`` only unless ``decoded``.

    Whole texts without special tokens; a null text is empty and has no ids. Rows stay as they are, repeated
    or not, with a null doc_id or not; an empty table gives an empty result. The vocabulary (under 1 MB) is
    read by the driver and sent along.
    """
    vocabulary = _vocabulary(vocabulary_path)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if decoded else ["doc_id", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in slices(batches):
            ids, off = own.encode(batch.column("text").to_pylist())
            if decoded:
                data, at = own.decode(ids)
                wire, at = ids.astype("<u4"), at[off]
                bounds, spans = list(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)), list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                columns = [np.diff(off), [hashlib.sha256(wire[a:b]).hexdigest() for a, b in bounds], [hashlib.sha256(data[a:b]).hexdigest() for a, b in spans]]
            else:
                columns = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)], names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if decoded else "doc_id long, ids array<int>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; a null list is an empty text, bytes that aren't UTF-8 are replaced."""
    vocabulary = _vocabulary(vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in batches:
            each = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            texts = [own.decode(ids)[0].tobytes().decode(errors="replace") for ids in each]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
