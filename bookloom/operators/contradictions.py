"""Contradiction candidates among the hits of a question, and the scan over judged pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bookloom import settings as S
from bookloom.functions.vectors import cosine
from bookloom.operators.graph_build import known_contradiction


def candidate_pairs(
    hits: DataFrame, low: float = S.BAND_LOW, high: float = S.BAND_HIGH, limit: int = S.BAND_PAIRS
) -> DataFrame:
    """Pairs of one question's hits whose similarity lies in the band, most alike first.

    ``hits(qid, rnk, chunk_id, vector)``, a short ranked list per question. Pairs are formed inside the
    question's row and at most ``limit`` leave it. Without any pair in the band the two best hits are
    the pair (``sim`` is null then).
    """
    packed = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rnk", "chunk_id", "vector"))).alias("h"))

    def with_rest(x: Column, i: Column) -> Column:
        rest = F.slice(F.col("h"), i + 2, F.size("h"))
        return F.transform(
            rest,
            lambda y: F.struct(
                (-F.round(cosine(x["vector"], y["vector"]), 9)).alias("order"),
                x["rnk"].alias("ra"), y["rnk"].alias("rb"),
                x["chunk_id"].alias("a"), y["chunk_id"].alias("b"),
                (x["vector"].isNotNull() & y["vector"].isNotNull()).alias("both"),
            ),
        )

    pairs = F.filter(
        F.flatten(F.transform("h", with_rest)), lambda p: p["both"] & (-p["order"] >= low) & (-p["order"] <= high)
    )
    first_two = F.struct(
        F.lit(None).cast("double").alias("order"), F.col("h")[0]["rnk"].alias("ra"), F.col("h")[1]["rnk"].alias("rb"),
        F.col("h")[0]["chunk_id"].alias("a"), F.col("h")[1]["chunk_id"].alias("b"), F.lit(False).alias("both"),
    )
    chosen = packed.filter(F.size("h") >= 2).withColumn("p", F.slice(F.array_sort(pairs), 1, limit)).withColumn(
        "p", F.when(F.size("p") == 0, F.array(first_two)).otherwise(F.col("p"))
    )
    return chosen.select("qid", F.posexplode("p").alias("n", "p")).select(
        "qid", (F.col("n") + 1).alias("pair_no"), "p.a", "p.b", (-F.col("p.order")).alias("sim")
    )


def scan(pairs: DataFrame, known: DataFrame, texts: DataFrame, judge) -> tuple[DataFrame, DataFrame]:
    """``(alerts, new_edges)``: the first conflicting pair of each question, in pair order.

    A known edge is a conflict; other pairs go to ``judge(df) -> df with contradicts, reason`` over
    columns ``text_a, text_b``. At most a handful of pairs per question reach the judge.
    """
    t = texts.select("chunk_id", "text")
    rows = known_contradiction(pairs, known)
    rows = rows.join(t.toDF("a", "text_a"), "a").join(t.toDF("b", "text_b"), "b")
    open_pairs = rows.filter(~F.col("known"))
    judged = judge(open_pairs.withColumns({"text_a": F.substring("text_a", 1, 1500), "text_b": F.substring("text_b", 1, 1500)}))
    cols = ["qid", "pair_no", "a", "b", "known", "contradicts", "reason"]
    settled = rows.filter("known").withColumn("contradicts", F.lit(True)).withColumn(
        "reason", F.lit("previously detected")
    ).select(*cols).unionByName(judged.select(*cols))
    first = settled.filter("contradicts").groupBy("qid").agg(
        F.min_by(F.struct("a", "b", "reason", "known"), "pair_no").alias("p")
    )
    alerts = first.select("qid", F.lit("sources disagree").alias("alert"), "p.a", "p.b", "p.reason", "p.known")
    return alerts.drop("known"), alerts.filter(~F.col("known")).select("a", "b").distinct()
