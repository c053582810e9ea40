"""Buckets of documents by a hash that Python tasks on both sides of a cogroup agree on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from scenarium.llm.textarrays import SLICE_BYTES, mix, raw_bytes, slices


def by_doc(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def squeeze(data: bytes) -> bytes:
    """Compressed more tightly than shuffle files are."""
    return zstandard.ZstdCompressor(level=3).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def packed(texts: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, ids, sizes, texts)``: the documents of a slice for each bucket, as binaries.

    Rows without a doc_id are spread over all buckets. ``unpacked`` gives the rows back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=4 * SLICE_BYTES):
            ids = batch.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            known = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            slot = np.where(null, np.arange(len(ids)) % buckets, by_doc(known, buckets))
            data, off = raw_bytes(batch.column("text"))
            raw, size = data.tobytes(), np.diff(off)
            order = np.argsort(slot, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(slot[order])) + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(slot[p[0]]) for p in parts], pa.int64()),
                    pa.array([known[p].tobytes() + null[p].tobytes() for p in parts], pa.binary()),
                    pa.array([size[p].tobytes() for p in parts], pa.binary()),
                    pa.array([squeeze(b"".join([raw[off[i] : off[i + 1]] for i in p.tolist()])) for p in parts], pa.binary()),
                ],
                ["bucket", "ids", "sizes", "texts"],
            )

    return texts.mapInArrow(run, "bucket long, ids binary, sizes binary, texts binary")


def unpacked(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """``(doc_id, text binary)`` of packed rows, one batch for each."""
    for ids, sizes, texts in zip(table.column("ids"), table.column("sizes"), table.column("texts"), strict=True):
        size = np.frombuffer(sizes.as_buffer(), np.int64)
        names = np.frombuffer(ids.as_buffer(), np.int64, len(size))
        null = np.frombuffer(ids.as_buffer(), bool, len(size), 8 * len(size))
        off = np.concatenate(([0], np.cumsum(size)))
        text = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(expand(texts.as_py()))])
        yield pa.RecordBatch.from_arrays([pa.array(names, mask=null), text], ["doc_id", "text"])


def pack_rows(rows: np.ndarray, field: str, buckets: int, kind: int) -> pa.RecordBatch:
    """``(bucket, kind, rows)``: rows of a structured array in one binary for each bucket of a field's hash, column by column."""
    slot = (mix(rows[field].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    cut = np.concatenate(([0], np.flatnonzero(np.diff(slot[order])) + 1, [len(rows)])) if len(rows) else np.zeros(1, np.int64)
    columns = [np.ascontiguousarray(rows[c][order]) for c in rows.dtype.names]
    blobs = [squeeze(b"".join([c[x:y].tobytes() for c in columns])) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    slot = slot[order][cut[:-1]]
    return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.full(len(slot), kind, np.int32)), pa.array(blobs, pa.binary())], ["bucket", "kind", "rows"])


def unpack_rows(table: pa.Table, dtype: np.dtype, kind: int) -> np.ndarray:
    blobs = [expand(x.as_py()) for k, x in zip(table.column("kind").to_pylist(), table.column("rows"), strict=True) if k == kind]
    out, at = np.empty(sum(map(len, blobs)) // dtype.itemsize, dtype), 0
    for x in blobs:
        n, begin = len(x) // dtype.itemsize, 0
        for c in dtype.names:
            out[c][at : at + n] = np.frombuffer(x, dtype[c], n, begin)
            begin += n * dtype[c].itemsize
        at += n
    return out
