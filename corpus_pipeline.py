"""From documents to training sequences, in five stages.

Each stage takes all documents that the one before it kept and returns them, but for the
last, with the columns of ``documents`` (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm import exact, language, near, packing, substring
from terraloom.scale import materialize, release

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


NAMES = {"doc_id": "lesson_id", "text": "body", "lang": "language"}


def _lessons(docs: DataFrame) -> DataFrame:
    """The documents as lessons; all other columns go along under neutral names, so none can clash with what an operator adds."""
    return docs.toDF(*[NAMES.get(c, f"other_{i}") for i, c in enumerate(docs.columns)])


def _chosen(lessons: DataFrame, digest, kept: DataFrame) -> DataFrame:
    """The lessons that ``kept`` (lesson_id, digest) names, one row of each."""
    key = lambda c: F.coalesce(F.col(c), F.lit(-(2**63)))
    rows = lessons.withColumn("_key", key("lesson_id")).withColumn("_digest", digest)
    names = kept.select(key("lesson_id").alias("_key"), F.col(kept.columns[1]).alias("_digest"))
    return rows.join(names, ["_key", "_digest"], "left_semi").dropDuplicates(["_key", "_digest"]).select(lessons.columns)


# Every stage takes null ids, null and empty texts, repeated rows and an empty table; columns beyond those of documents,
# whatever their names, are returned as they are (by all but the last stage).


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is rejected; the models learn from the documents' own labels.

    Documents with a null text or without a letter are rejected; without any label all are.
    """
    lessons = _lessons(docs)
    rest = [c for c in lessons.columns if c != "lesson_id"]
    found = language.identify(lessons, language.train(lessons), keep=rest).where(~F.col("rejected"))
    return found.select(lessons.columns).toDF(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text up to white space keep the one with the smallest doc_id.

    A null text equals an empty one; a null doc_id stays only if there is no other; of equal rows one stays.
    """
    lessons = _lessons(docs)
    kept = exact.collapse_copies(lessons).where("kept").select("lesson_id", "body_sha256")
    return _chosen(lessons, exact.body_digest("body"), kept).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies keep the document with the smallest doc_id.

    Documents without words are copies of each other only where their texts are equal.
    """
    lessons = _lessons(docs)
    kept = near.near_copies(lessons).where("kept").select("lesson_id", "body_md5")
    return _chosen(lessons, F.md5(F.coalesce("body", F.lit(""))), kept).toDF(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 13 words and more that an earlier document has; other texts stay as they are.

    A null doc_id counts as larger than every other; documents with one doc_id do not cut each other.
    """
    lessons = _lessons(docs)
    cut = substring.remove_repeats(lessons, window=13, keep=[c for c in lessons.columns if c != "lesson_id"])
    changed = F.col("n_removed") > 0
    made = [F.when(changed, F.col("kept")).otherwise(F.col(a)) if b == "text" else F.when(changed, F.length("kept").cast("bigint")).otherwise(
        F.col(a)) if b == "n_chars" else F.col(a) for a, b in zip(lessons.columns, docs.columns)]
    return cut.select(*made).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of 2048 tokens; an empty text is one token, its end."""
    return packing.pack_lessons(_lessons(docs), VOCABULARY).withColumnRenamed("lesson_id", "doc_id")


STAGES = [
    ("language", keep_languages), ("exact copies", drop_exact_copies), ("near copies", drop_near_copies), ("repeated passages", cut_repeats),
    ("packing", pack)]

#: SQL has no form for the language models, sketches and packing; tests/llm/test_pipeline.py checks each stage's decisions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        if last is not None:
            release(last)
        last = docs
    return docs
