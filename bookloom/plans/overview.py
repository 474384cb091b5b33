"""Answers over the whole library: map each question over community summaries, then reduce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bookloom import settings as S
from bookloom.functions.text import strip, token_estimate, words
from bookloom.plans.reorganize import top_summaries


def word_note(question: Column, summary: Column) -> Column:
    """Default map step: the summary when it shares a word with the question, else ``irrelevant``."""
    bag = lambda c: F.array_distinct(words(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))))
    return F.when(F.arrays_overlap(bag(question), bag(summary)), summary).otherwise("irrelevant")


def global_answers(
    queries: DataFrame, communities: DataFrame, note=word_note, reduce=None, budget: int = S.GLOBAL_BUDGET
) -> DataFrame:
    """``(qid, answer, communities, tokens_in, tokens_out)``; a question nothing speaks to has no row.

    At most ``budget`` summaries exist, so they ride along as one array per question; the map step is
    ``note(question, summary)`` and notes that are blank or say ``irrelevant`` are dropped.
    """
    packed = top_summaries(communities, budget).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("entity_count")).alias("o"), "cid", "summary"))).alias("top")
    )
    asked = queries.crossJoin(F.broadcast(packed)).select("qid", "question", F.posexplode("top").alias("i", "c"))
    notes = asked.select(
        "qid", "question", (F.col("i") + 1).alias("n"), F.col("c.cid").alias("cid"), F.col("c.summary").alias("summary"),
        strip(note(F.col("question"), F.col("c.summary"))).alias("note"),
    ).filter((F.coalesce("note", F.lit("")) != "") & ~F.lower("note").contains("irrelevant"))
    by_question = notes.groupBy("qid", "question").agg(
        F.array_sort(F.collect_list(F.struct("n", "cid", "note"))).alias("used"),
        F.sum(token_estimate(F.concat_ws(" ", "summary", "question"))).alias("map_in"),
        F.sum(token_estimate(F.col("note"))).alias("map_out"),
    )
    joined = F.array_join(F.transform("used", lambda u: F.format_string("[%d] %s", u["n"], u["note"])), "\n")
    answer = strip(reduce(F.col("question"), joined)) if reduce else joined
    out = by_question.withColumn("notes", joined).withColumn("answer", answer)
    return out.select(
        "qid", "answer",
        F.transform("used", lambda u: u["cid"]).alias("communities"),
        (F.col("map_in") + token_estimate(F.col("notes"))).alias("tokens_in"),
        (F.col("map_out") + token_estimate(F.col("answer"))).alias("tokens_out"),
    )
