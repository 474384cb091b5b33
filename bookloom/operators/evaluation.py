"""Answer-quality metrics over batches of answered questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from bookloom import settings as S
from bookloom.functions.text import citation_markers, claims, strip
from bookloom.functions.vectors import cosine

CONTEXT_CHARS = 6000


def context_blob(contexts: DataFrame) -> DataFrame:
    """``qid -> context``: the ranked texts of a question joined and cut to 6000 characters.

    No more than that of any one text can remain, so the rest is not collected.
    """
    packed = F.array_sort(F.collect_list(F.struct("rnk", F.substring("text", 1, CONTEXT_CHARS).alias("text"))))
    return contexts.groupBy("qid").agg(
        F.substring(F.array_join(F.transform(packed, lambda x: x["text"]), "\n\n"), 1, CONTEXT_CHARS).alias("context")
    )


def claim_rows(answers: DataFrame, column: str) -> DataFrame:
    return answers.select("qid", F.explode(claims(F.col(column))).alias("claim"))


def supported_share(answers: DataFrame, column: str, contexts: DataFrame, judge, empty: float) -> DataFrame:
    """Share of a text's claims the judge finds in the question's context: ``(qid, score)``.

    ``empty`` is the score of a text without claims; a blank text scores 0. A judge with ``reads`` and ``decides`` reads each
    context once, not once per claim.
    """
    reads, decides = getattr(judge, "reads", lambda context: context), getattr(judge, "decides", judge)
    read = context_blob(contexts).withColumn("context", reads(F.col("context")))
    rows = claim_rows(answers, column).join(read, "qid", "left").withColumn("context", F.coalesce("context", reads(F.lit(""))))
    judged = rows.withColumn("ok", decides(F.col("claim"), F.col("context")).cast("double"))
    shares = judged.groupBy("qid").agg(F.round(F.avg("ok"), 4).alias("score"))
    blank = strip(F.coalesce(column, F.lit(""))) == ""
    return answers.select("qid", blank.alias("_blank")).join(shares, "qid", "left").select(
        "qid", F.when(F.col("_blank"), 0.0).otherwise(F.coalesce("score", F.lit(empty))).alias("score")
    )


def faithfulness(answers: DataFrame, contexts: DataFrame, judge) -> DataFrame:
    return supported_share(answers, "answer", contexts, judge, 1.0)


def context_recall(answers: DataFrame, contexts: DataFrame, judge) -> DataFrame:
    return supported_share(answers, "ground_truth", contexts, judge, 0.0)


def context_precision(verdicts: DataFrame) -> DataFrame:
    """Mean precision at each useful rank: ``verdicts(qid, rnk, useful)`` to ``(qid, score)``."""
    run = Window.partitionBy("qid").orderBy("rnk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = Window.partitionBy("qid").orderBy("rnk")
    at = verdicts.withColumn("k", F.row_number().over(place)).withColumn(
        "p", F.sum(F.col("useful").cast("int")).over(run) / F.col("k")
    )
    return at.groupBy("qid").agg(
        F.coalesce(F.round(F.avg(F.when(F.col("useful"), F.col("p"))), 4), F.lit(0.0)).alias("score")
    )


def citation_correctness(answers: DataFrame) -> DataFrame:
    """Share of distinct markers that point at a source: ``answers(qid, answer, n_sources)``."""
    m = answers.withColumn("_m", citation_markers(F.coalesce("answer", F.lit(""))))
    valid = F.size(F.filter("_m", lambda n: (n >= 1) & (n <= F.col("n_sources"))))
    return m.select(
        "qid", F.size("_m").alias("emitted"), valid.alias("valid"),
        F.when(F.size("_m") > 0, F.round(valid / F.size("_m"), 4)).otherwise(F.lit(0.0)).alias("score"),
    )


def answer_relevancy(answers: DataFrame, derived: DataFrame, embed) -> DataFrame:
    """Mean similarity of the question to questions derived from its answer.

    ``derived(qid, derived_question)``; none is neutral (1), a blank answer scores 0.
    """
    asked = answers.select("qid", embed(F.col("question")).alias("qv"))
    sims = (
        derived.filter(strip(F.coalesce("derived_question", F.lit(""))) != "")
        .withColumn("dv", embed(F.col("derived_question")))
        .join(asked, "qid")
        .groupBy("qid")
        .agg(F.round(F.avg(cosine(F.col("qv"), F.col("dv"))), 4).alias("score"))
    )
    blank = strip(F.coalesce("answer", F.lit(""))) == ""
    return answers.select("qid", blank.alias("_blank")).join(sims, "qid", "left").select(
        "qid", F.when(F.col("_blank"), 0.0).otherwise(F.coalesce("score", F.lit(1.0))).alias("score")
    )


def mean_scores(scores: DataFrame, key: str = "metric") -> DataFrame:
    return scores.groupBy(key).agg(F.round(F.avg("score"), 4).alias("score"))


def breaches(report: DataFrame, gate: dict[str, float] = S.GATE) -> DataFrame:
    """Gated metrics below their threshold: ``report(config, metric, score)``."""
    limit = F.create_map(*[F.lit(x) for kv in gate.items() for x in kv])
    return report.withColumn("threshold", F.try_element_at(limit, F.col("metric"))).filter(
        F.col("threshold").isNotNull() & (F.col("score").isNull() | (F.col("score") < F.col("threshold")))
    )


def seeded_corpora(chunks: DataFrame) -> DataFrame:
    """Corpora that hold at least one chunk."""
    return chunks.select("corpus").distinct()
