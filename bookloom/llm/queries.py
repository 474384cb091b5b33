"""Registered queries of the subpackage: ``QUERIES`` and, where SQL can say it, ``SQL``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from bookloom.llm import alignment, contamination, language, licenses, manifest, minhash, oracles, pages, pieces, quality, secrets, substrings, urls, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.report(table(spark, folder, "documents"))


@query
def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_documents(table(spark, folder, "documents"), pieces.read_model(spark))


@query
def op9_quality_pu(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, folder, "labels")))


@query
def op5_language_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.predict(docs, language.fit(docs))


@query
def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(table(spark, folder, "pages"))


@query
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


SQL["op1_license_scan"] = licenses.oracle()


@query
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.dedup(table(spark, folder, "documents"))


@query
def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), k=2)


@query
def op8_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


SQL["op2_minhash_near_dedup"] = oracles.NEAR_DUPLICATES
SQL["op7_substring_dedup"] = oracles.REPEATED_WINDOWS
SQL["op8_embedding_near_dedup"] = oracles.NEAR_VECTORS


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Tampering, where 2 divides the CRC-32 of ``doc_id``, deletes line ends."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest.manifest(table(spark, folder, "documents"), tampered)


SQL["op13_merkle_manifest"] = manifest.ORACLE


@query
def op11_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.report(table(spark, folder, "documents"), alignment.read_models(spark))


@query
def op12_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"))
