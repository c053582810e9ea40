"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import math
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from scenarium.llm.bpe import decode, encode
from scenarium.llm.chaining import fuzzy_passages
from scenarium.llm.decontam import contaminated
from scenarium.llm.langid import fit, predict
from scenarium.llm.licenses import scan_licenses
from scenarium.llm.lm import score_language_model
from scenarium.llm.pii import replace_pii
from scenarium.llm.simhash import near_duplicate_groups
from scenarium.llm.suffixes import remove_repeats
from scenarium.llm.topk import exact_top_k

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, bucket int, chunk int, train boolean, n int, kind string, rows string, sha string"
LONG = "lorem ipsum dolor sit amet " * 4000
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, "abc"), (4, "abc"), (None, "abc def"), (None, None), (5, "x" * 60_000), (6, LONG), (7, LONG), (8, "é ß 漢字 \U0001f600")]
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i and i % 2 else None, None, None, 1, 2, 3, True, 4, "k", "r", "s") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def model_rows(docs):
    return score_language_model(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2)


OPERATORS = {
    "bpe": (lambda d: encode(d, VOCABULARY, public_tokenizers.PATTERN, decoded=True), 11),
    "language": (lambda d: predict(d, fit(d, F.lit(True))), 11),
    "simhash": (near_duplicate_groups, 11),
    "pii": (replace_pii, 11),
    "model": (model_rows, 11),
    "suffixes": (remove_repeats, 11),
    "licenses": (scan_licenses, 0),
    "chaining": (fuzzy_passages, 1),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(docs, nothing, name):
    operator, rows = OPERATORS[name]
    assert len(operator(docs).collect()) == rows
    assert operator(nothing).collect() == []


def test_bpe_of_odd_texts(docs):
    ids = encode(docs, VOCABULARY, public_tokenizers.PATTERN)
    back = sorted((r["doc_id"] or 0, r["text"]) for r in decode(ids, VOCABULARY, public_tokenizers.PATTERN).collect())
    assert back == sorted((i or 0, t or "") for i, t in TEXTS)


def test_language_of_odd_texts(docs):
    got = {(r["doc_id"], r["lang_pred"]) for r in predict(docs, fit(docs, F.lit(True))).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "und"), (6, "en")} <= got


def test_pii_keeps_all_columns_and_texts(docs):
    out = replace_pii(docs)
    assert out.columns == [*docs.columns, "n_replaced"]
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == set(TEXTS)


def test_simhash_of_texts_without_words(docs):
    rows = {(r["doc_id"], r["fp"], r["component_id"]) for r in near_duplicate_groups(docs).collect()}
    assert {(1, 0, 1), (2, 0, 1), (3, 0, 1), (None, 0, 1)} <= rows
    assert {r[2] for r in rows if r[0] in (6, 7)} == {6}


def test_suffixes_of_repeated_rows_and_copies(docs):
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeats(docs).collect() if r["doc_id"]}
    assert got[5] == 60_000 - 1  # all but the first byte is in a string that starts earlier
    assert got[7] == len(LONG) and got[6] == len(LONG) - 27 and got[4] == 0


def test_decontamination_of_odd_tables(spark, docs, nothing):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "abc"), (3, "abc"), (None, "def"), (4, LONG)], "item_id long, text string")
    rows = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()}
    assert rows == {(4, 3), (None, 3), (None, None), (6, 4), (7, 4)}
    assert contaminated(nothing, bench).collect() == [] and contaminated(docs, bench.limit(0)).collect() == []


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (None, [1.0, 1.0]), (20, []), (7, [3e9, 0.0]), (8, [-0.001, 0.0])]
    vectors = spark.createDataFrame([(i, v, 9, 9) for i, v in rows], "vec_id long, embedding array<double>, n int, q int")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in exact_top_k(vectors, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7), (0, 2, 1), (0, 3, 2), (20, 1, 0), (20, 2, 1), (20, 3, 2)]
    assert exact_top_k(vectors.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    for large in ([(0, [3e30]), (1, [1.0])], [(0, [1e15, 1.0]), (1, [1e15, 1.0])]):  # no sum that is wrong, and no other value in its place
        with pytest.raises(Exception, match=r"beyond 2\*\*61"):
            exact_top_k(spark.createDataFrame(large, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()


def test_top_k_of_repeated_ids_and_large_components(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [5.0, 0.0])], "vec_id long, embedding array<double>")
    got = exact_top_k(vectors, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 2, 320 * 64), (2, 1, 128 * 64), (3, 1, 64 * 64)]
    rng = random.Random(3)
    rows = [(i // 2 * 10, [rng.uniform(-3e6, 3e6) for _ in range(5)]) for i in range(60)]  # every id twice, sums beyond 2**53
    v = [(i, [math.floor(64 * x) for x in e]) for i, e in rows]
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=7).collect()
    for q in {i for i, _ in v if i % 20 == 0}:
        best = sorted((-sum(a * b for a, b in zip(e, w, strict=True)), c) for i, e in v if i == q for c, w in v if c != q)[:7]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) == [(n, c, -s) for n, (s, c) in enumerate(best, 1)]
