"""Semantic answer cache over batches of questions: lookup, store, evict, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bookloom import settings as S
from bookloom.functions.questions import too_different
from bookloom.operators import knn


def _scoped(df: DataFrame, version: str) -> DataFrame:
    return df.withColumn("scope", F.concat_ws("|", F.coalesce("corpus", F.lit("default")), F.col(version).cast("string")))


def lookup(
    questions: DataFrame,
    entries: DataFrame,
    now,
    threshold: float = S.CACHE_THRESHOLD,
    guard: bool = True,
    layout: str = "auto",
) -> DataFrame:
    """The nearest live entry per question and whether it may serve it.

    ``questions(qid, question, corpus, version, vector)``; ``entries(entry_id, corpus,
    corpus_version, question, vector, expires_at, ...)``. Corpus and version must agree, expired
    entries do not count. Only the single nearest entry is tested; ``hit`` is false otherwise.
    """
    live = _scoped(entries.filter(F.col("expires_at") > now), "corpus_version")
    asked = _scoped(questions, "version")
    near = knn.nearest(
        asked.select("qid", "vector", "scope"),
        live.select(F.col("entry_id").alias("item_id"), "vector", "scope"),
        1, "scope", layout=layout,
    ).select("qid", F.col("item_id").alias("entry_id"), "sim")
    stored = entries.select("entry_id", F.col("question").alias("stored_question"))
    out = questions.select("qid", "question").join(near, "qid", "left").join(stored, "entry_id", "left")
    ok = F.col("entry_id").isNotNull() & (F.col("sim") >= threshold)
    if guard:
        ok = ok & ~too_different(F.col("stored_question"), F.col("question"))
    return out.withColumn("hit", F.coalesce(ok, F.lit(False)))


def new_entries(answers: DataFrame, now, ttl_days: int = S.CACHE_TTL_DAYS) -> DataFrame:
    """Cache rows of answered questions; failed answers (an ``error``) are not stored."""
    return answers.filter(F.col("error").isNull()).select(
        F.col("qid").alias("entry_id"),
        F.coalesce("corpus", F.lit("default")).alias("corpus"),
        F.substring("question", 1, S.CACHE_QUESTION_CHARS).alias("question"),
        "vector",
        F.coalesce("answer", F.lit("")).alias("answer"),
        "sources", "citations",
        F.col("version").alias("corpus_version"),
        F.lit(0).alias("hit_count"),
        now.alias("created_at"),
        (now + F.make_dt_interval(days=F.lit(ttl_days))).alias("expires_at"),
    )


def evict(entries: DataFrame, disliked: DataFrame, threshold: float = S.CACHE_THRESHOLD, layout: str = "auto") -> DataFrame:
    """Entries left after removing those similar to a disliked question of their corpus.

    ``disliked(qid, corpus, vector)``. Age and version do not matter here.
    """
    by_corpus = lambda df: df.withColumn("scope", F.coalesce("corpus", F.lit("default")))
    victims = knn.matching_items(
        by_corpus(disliked).select("qid", "vector", "scope"),
        by_corpus(entries).select(F.col("entry_id").alias("item_id"), "vector", "scope"),
        "scope", threshold, layout,
    )
    return entries.join(victims.withColumnRenamed("item_id", "entry_id"), "entry_id", "left_anti")


def stats(entries: DataFrame, lookups: DataFrame, now) -> DataFrame:
    """One row: live entries, hits, misses, hit rate (4 digits, 0 when nothing was asked)."""
    log = lookups.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    live = entries.agg(F.count_if(F.col("expires_at") > now).alias("entries"))
    both = log.crossJoin(F.broadcast(live))  # one row each
    total = F.col("hits") + F.col("misses")
    return both.select(
        "entries", "hits", "misses",
        F.when(total > 0, F.round(F.col("hits") / total, 4)).otherwise(F.lit(0.0)).alias("hit_rate"),
    )


def count_hits(entries: DataFrame, lookups: DataFrame) -> DataFrame:
    """Entries with their hit counters raised by the hits of a batch."""
    hits = lookups.filter("hit").groupBy("entry_id").agg(F.count(F.lit(1)).alias("_n"))
    return entries.join(hits, "entry_id", "left").withColumn(
        "hit_count", F.col("hit_count") + F.coalesce("_n", F.lit(0))
    ).drop("_n")
