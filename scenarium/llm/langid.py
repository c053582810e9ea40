"""Language identification with blended-spectrum string kernels, Nystrom landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenarium.llm.textarrays import LOWER, raw_bytes, slices

#: Buckets of byte 1-, 2- and 3-grams.
BUCKETS = (256, 4096, 8192)
WIDTH = sum(BUCKETS)
#: Texts whose presence rows are in memory at once.
ROWS = 512
#: Bounds of the sample that the classifier is fitted on, and its landmarks.
PER_LANGUAGE, MAX_SAMPLE, LANDMARKS, RIDGE = 500, 4000, 192, 1e-2
#: Times the rows wanted of a language that are ranked.
SPARE = 4
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


def presence(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of 0 and 1 for each text: which buckets its whole text's byte n-grams fall into."""
    n = len(off) - 1
    out = np.zeros((n, WIDTH), np.uint8)
    flat, low = out.reshape(-1), LOWER[data].astype(np.uint32)
    base = np.repeat(np.arange(n) * WIDTH, np.diff(off))
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(data))
    code, begin = low, 0
    for k, size in enumerate(BUCKETS):
        if k:
            code = code[:-1] * np.uint32(256) + low[k:]
        m = len(code)
        if m <= 0:
            break
        slot = code if k == 0 else (code * np.uint32(2654435761)) >> np.uint32(32 - (size - 1).bit_length())
        whole = left[:m] > k
        flat[(base[:m] + begin + slot)[whole]] = 1
        begin += size
    return out


@dataclass
class Model:
    """Scores are kernel(x, landmarks) @ dual; the kernel is the cosine of two presence rows."""

    languages: list[str]
    landmarks: np.ndarray
    dual: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        return unit(rows) @ self.landmarks.T @ self.dual


def unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def fit(docs: DataFrame, training: Column) -> Model:
    """Fit on at most PER_LANGUAGE labelled rows of each language and MAX_SAMPLE in all, taken in hash order.

    ``training`` selects rows; those without lang or text, and without a doc_id, teach nothing. Without any
    labelled row the model knows no language; of more than MAX_SAMPLE languages the most frequent are learned.
    """
    rows = docs.where(training & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    ids = rows.select(F.col("doc_id").cast("long"), F.col("lang").cast("string")).withColumn("h", F.xxhash64("doc_id"))
    # only rows whose hash lies in a share of about SPARE * PER_LANGUAGE rows of their language are ranked at all
    counts = ids.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(MAX_SAMPLE)  # at most so many languages
    few = ids.join(F.broadcast(counts), "lang").where(F.pmod("h", F.lit(1 << 31)).cast("double") * F.col("rows") <= F.lit(float(SPARE * PER_LANGUAGE * (1 << 31)))).select("doc_id", "lang", "h").distinct()
    ranked = few.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("n") <= PER_LANGUAGE)
    chosen = ranked.orderBy("n", "h", "lang").limit(MAX_SAMPLE).select("doc_id", "lang", "n").distinct()  # at most MAX_SAMPLE rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            packed = np.packbits(presence(*raw_bytes(batch.column("text"))), axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "n")), pa.array([x.tobytes() for x in packed], pa.binary())], ["doc_id", "lang", "n", "bits"])

    texts = rows.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    seen = texts.join(F.broadcast(chosen), ["doc_id", "lang"]).mapInArrow(run, "doc_id long, lang string, n int, bits binary")
    sample = seen.groupBy("doc_id", "lang").agg(F.min("n").alias("n"), F.min("bits").alias("bits")).orderBy("n", "doc_id", "lang").limit(MAX_SAMPLE).collect()
    languages = sorted({r["lang"] for r in sample})
    if not languages:
        return Model([], np.zeros((0, WIDTH), np.float32), np.zeros((0, 0), np.float32))
    x = unit(np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in sample), np.uint8).reshape(len(sample), -1), axis=1)[:, :WIDTH])
    y = np.where(np.array([r["lang"] for r in sample])[:, None] == np.array(languages), 1.0, -1.0)
    marks = x[:LANDMARKS]  # the sample is in rounds over the languages
    k, own = (x @ marks.T).astype(np.float64), (marks @ marks.T).astype(np.float64)
    dual = np.linalg.solve(k.T @ k + RIDGE * len(x) * 1e-2 * own + 1e-6 * np.eye(len(marks)), k.T @ y)
    return Model(languages, marks, dual.astype(np.float32))


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``doc_id`` (or the columns ``keep``), ``lang_pred`` and ``score`` for every row, from its whole text alone.

    ``names`` are other names for these two; columns of ``keep`` that have one of the two names give way.
    ``und`` with score 0 if the text is null or has no letter, or if the model knows no language; else the
    language of the highest score (ties: the first in alphabetical order), brought from [-1, 1] to [0, 1].
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            text = batch.column("text")
            letter = np.array([bool(t and _LETTER.search(t)) for t in text.to_pylist()]) & bool(model.languages)
            name, score = np.full(len(text), UNDETERMINED, object), np.zeros(len(text))
            if letter.any():
                raw = model.score(presence(*raw_bytes(text)))[letter]
                name[letter] = np.array(model.languages, object)[raw.argmax(1)]
                score[letter] = np.clip((1 + raw.max(1).astype(np.float64)) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([*map(batch.column, fields), pa.array(name, pa.string()), pa.array(score)], [*fields, *names])

    fields = [c for c in keep or ["doc_id"] if c.lower() not in {n.lower() for n in names}]
    rows = docs.select(*dict.fromkeys([*fields, "text"])).withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(run, rows.select(*fields, F.lit("").alias(names[0]), F.lit(0.0).alias(names[1])).schema)


def remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n
