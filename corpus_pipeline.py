"""From raw documents to token digests, in five stages; each is a Spark job over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenarium.llm.bpe import encode
from scenarium.llm.decontam import contaminated
from scenarium.llm.langid import UNDETERMINED, fit, predict
from scenarium.llm.pii import replace_pii
from scenarium.llm.simhash import near_copy_groups
from scenarium.plans.materialize import checkpoint_root

#: A text whose best language scores lower shares no more with any learned language than chance.
LEAST_SCORE = 0.25


def own_names(docs: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    return [next(c for c in (n + "_" * k for k in range(len(taken) + 1)) if c not in taken) for n in names]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null or have no letter, and those like no learned language; ``lang`` becomes the prediction.

    Every row is judged by its own text, whatever its doc_id.
    """
    language, score = own_names(docs, "lang_pred", "score")
    found = predict(docs, fit(docs, F.lit(True)), keep=docs.columns, names=(language, score))
    kept = found.where((F.col(language) != UNDETERMINED) & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.col(language)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of exact and near copies (five-word shingles, similarity 0.8): the one of the smallest doc_id.

    Words decide, not spaces or the case of A-Z. Texts without a word are copies of each other, a null is an empty text. Documents without a
    doc_id come last. Rows that share doc_id and words are copies too; rows that share a doc_id only are documents of their own.
    """
    digest, key = own_names(docs, "digest", "key")
    words = F.trim(F.regexp_replace(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[ \\t-\\r]+", " "))
    rows = docs.withColumn(digest, F.xxhash64(words))
    groups = near_copy_groups(rows.select(F.col(digest).alias("digest"), F.col("doc_id").cast("long"), F.col("text").cast("string")))
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("least").isNull(), "least", "digest")).alias("best"))
    no_id = F.lit(-(2**63)).cast("long")
    kept = first.select(F.col("best.digest").alias(digest), F.coalesce("best.least", no_id).alias(key))
    rows = rows.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), no_id))
    return rows.join(kept, [digest, key], "left_semi").dropDuplicates([digest, key]).select(*docs.columns)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a copy of a benchmark item, edited or not; texts that are null or empty hold none, items that are null or empty are in none.

    Rows are told apart by a hash of their text, so that rows without or with a repeated doc_id are judged by their own.
    """
    (key,) = own_names(docs, "key")
    rows = docs.withColumn(key, F.xxhash64("text"))
    found = contaminated(rows.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become surrogates; ``n_chars`` follows the new text. All rows stay; null and empty texts stay as they are."""
    return replace_pii(docs, count=own_names(docs, "n_replaced")[0]).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes, for every row; a null text is empty."""
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_copies),
    ("pii_surrogates", replace_personal_data),
    ("byte_bpe", tokenize),
]
#: SQL can't express the classifier, the alignments or the merges; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    import uuid

    docs, root = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs.write.parquet(f"{root}/{name}")
            docs = spark.read.parquet(f"{root}/{name}")
    return docs
