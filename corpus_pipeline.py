"""From raw documents to packed training sequences: quality, language, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acctsignal.llm.batches import id_remainder, unused_name
from acctsignal.llm.language import UNDETERMINED, fit_languages, predict_language
from acctsignal.llm.packing import pack_documents
from acctsignal.llm.parity_join import one_per_group
from acctsignal.llm.quality import fit_quality, quality_score
from acctsignal.llm.queries import QUALITY_THRESHOLD, table, vocabulary
from acctsignal.session import configure, materialize

#: A text whose best language has a smaller part of all languages' evidence is in none of them.
LANGUAGE_THRESHOLD = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose quality score is below the threshold; learned from ``labels``."""
    configure(spark)
    labels = table(spark, sf_dir, "labels").where(id_remainder(F.col("doc_id"), 5) != 0)
    score = quality_score(fit_quality(docs, labels), F.col("text"))
    name = unused_name(docs, "quality_score")
    return docs.withColumn(name, score).where(F.col(name) >= QUALITY_THRESHOLD).drop(name)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in no learned language: without a letter, or without evidence for one language."""
    configure(spark)
    model = fit_languages(docs.where(id_remainder(F.col("doc_id"), 4) != 2))
    name = unused_name(docs, "language")
    found = docs.withColumn(name, predict_language(model, F.col("text")))
    return found.where((F.col(name)["lang_pred"] != UNDETERMINED) & (F.col(name)["score"] >= LANGUAGE_THRESHOLD)).drop(name)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles alike to 0.8, the one with the smallest id stays."""
    configure(spark)
    return one_per_group(docs, width=5, threshold=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 4096 tokens."""
    configure(spark)
    packed = pack_documents(docs, vocabulary("word_bpe_49k.json"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality", keep_good),
    ("language", keep_languages),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("packing", pack),
]

#: Tokenizing and the classifiers can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
