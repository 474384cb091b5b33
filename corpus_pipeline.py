"""The training-data pipeline over ``documents``: each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bookloom.llm import contamination, language, minhash, pieces, secrets
from bookloom.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not determined go: null, empty and letterless texts, and all if no document has a language to
    learn from. Rows are judged one by one, so repeated rows and null ids are no special case; very long texts are read whole."""
    return language.identified(docs.select(*COLUMNS), language.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8): the one of the smallest ``doc_id``,
    with all rows of that id. Rows without ``doc_id`` and texts without words stay; very long texts are compared whole."""
    return minhash.one_of_each(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none, null and empty items are held by none; without
    items every document stays."""
    return contamination.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mask; every row stays, repeated ones too, and null and empty texts as they are."""
    return secrets.redact(docs.select(*COLUMNS), secrets.fit(secrets.samples_from(docs)))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each kept text; a null or empty text has none. Every row gets its row, in an empty table there is none."""
    return pieces.encode_documents(docs, pieces.read_model(spark))


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", encoding),
]

# Trained models and minwise tokens are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
