"""Ranked hit lists: fusion, merging, reranking, parent expansion, context assembly, citations.

A hit row is ``(qid, chunk_id, score, rnk)`` plus whatever columns ride along; ``rnk`` is its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bookloom import settings as S
from bookloom.functions.text import citation_markers, strip, token_estimate, words
from bookloom.session import stored


def _place(df: DataFrame, order: list[Column], top: int | None, name: str = "rnk") -> DataFrame:
    out = df.withColumn(name, F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    return out if top is None else out.filter(F.col(name) <= top)


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, top: int = S.CANDIDATES, k: int = S.RRF_K) -> DataFrame:
    """Reciprocal rank fusion. Equal sums keep vector order first, then keyword order."""
    arms = vector_hits.select("qid", "chunk_id", F.col("rnk").alias("vr"), F.lit(None).cast("int").alias("kr")).unionByName(
        keyword_hits.select("qid", "chunk_id", F.lit(None).cast("int").alias("vr"), F.col("rnk").alias("kr"))
    )
    both = arms.groupBy("qid", "chunk_id").agg(F.min("vr").alias("vr"), F.min("kr").alias("kr"))
    share = lambda r: F.coalesce(1.0 / (F.lit(k) + F.col(r)), F.lit(0.0))
    exact = both.withColumn("raw", share("vr") + share("kr"))
    placed = _place(exact, [F.desc("raw"), F.asc_nulls_last("vr"), F.asc_nulls_last("kr")], top)
    return placed.select("qid", "chunk_id", F.round("raw", 4).alias("score"), "rnk")


def merge_hits(hits: DataFrame, extra: DataFrame, top: int = S.CANDIDATES) -> DataFrame:
    """Union by chunk with the best score; equal scores keep the order first list, then second."""
    both = hits.select("qid", "chunk_id", "score", F.struct(F.lit(0).alias("list"), "rnk").alias("at")).unionByName(
        extra.select("qid", "chunk_id", "score", F.struct(F.lit(1).alias("list"), "rnk").alias("at"))
    )
    one = both.groupBy("qid", "chunk_id").agg(F.max("score").alias("score"), F.min("at").alias("at"))
    return _place(one, [F.desc("score"), F.asc("at")], top).drop("at")


def neutral_hits(found: DataFrame, score: float = S.GRAPH_SCORE) -> DataFrame:
    """Chunks fetched by id, as hits of one neutral score in id order: input ``(qid, chunk_id)``."""
    return _place(found.select("qid", "chunk_id").distinct().withColumn("score", F.lit(score)), [F.asc("chunk_id")], None)


def lexical_overlap(question: Column, text: Column) -> Column:
    """Share of the question's words that occur in the text."""

    def bag(c: Column) -> Column:
        return F.array_distinct(words(F.lower(c)))

    q = bag(question)
    return F.size(F.array_intersect(q, bag(text))) / F.greatest(F.lit(1), F.size(q))


def rerank(hits: DataFrame, top: int = S.RERANK_TOP, score: Column | None = None) -> DataFrame:
    """Best ``top`` hits by ``score`` (default word overlap); equal scores keep their order.

    Needs ``question`` and ``text``. ``fused_rnk`` keeps the former place, ``rerank_score`` 4 digits.
    """
    given = score if score is not None else lexical_overlap(F.col("question"), F.col("text"))
    scored = hits.withColumnRenamed("rnk", "fused_rnk").withColumn("_s", given)
    placed = _place(scored, [F.desc("_s"), F.asc("fused_rnk")], top)
    return placed.withColumn("rerank_score", F.round("_s", 4)).drop("_s")


def expand_to_parents(hits: DataFrame, parents: DataFrame, order_by: str = "score") -> DataFrame:
    """Swap child text for parent text, one hit per parent (its best child), ids stay the child's.

    Hits without a stored parent pass unchanged. Result order is by score, as the best children come
    first among equals; ``order_by='rerank'`` keeps the incoming order instead. The hits are stored, so
    only texts of parents they name are moved.
    """
    hits = stored(hits, "expanded")
    named = parents.select("parent_id", F.col("text").alias("parent_text")).join(
        hits.select("parent_id").distinct(), "parent_id", "left_semi"
    )
    joined = hits.join(named, "parent_id", "left")
    group = F.when(F.col("parent_text").isNotNull(), F.col("parent_id")).otherwise(F.col("chunk_id"))
    w = Window.partitionBy("qid", group)
    best = (
        joined.withColumn("_best", F.row_number().over(w.orderBy(F.desc("score"), F.asc("rnk"))))
        .withColumn("_first", F.min("rnk").over(w))
        .filter("_best = 1")
        .withColumn("text", F.coalesce("parent_text", "text"))
        .withColumn("_rest", F.col("parent_text").isNull())
    )
    order = [F.desc("score"), F.asc("_rest"), F.asc("_first")] if order_by == "score" else [F.asc("_first")]
    return _place(best, order, None).drop("_best", "_first", "_rest", "parent_text")


def within_budget(hits: DataFrame, budget: int = S.CONTEXT_BUDGET) -> DataFrame:
    """Numbered source blocks up to the token budget; the first block always stays.

    Needs ``title`` and ``text``. The running sum never falls, so the kept blocks are a prefix.
    """
    block = F.format_string("[%d] (%s) %s", F.col("rnk"), F.col("title"), strip(F.col("text")))
    rows = hits.withColumn("block", block).withColumn("block_tokens", token_estimate(F.col("block")))
    run = Window.partitionBy("qid").orderBy("rnk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum("block_tokens").over(run)).filter(
        (F.col("rnk") == 1) | (F.col("used") <= budget)
    )


def assemble(queries: DataFrame, hits: DataFrame, images: DataFrame | None = None, budget: int = S.CONTEXT_BUDGET) -> DataFrame:
    """``(qid, question, user_text, citations, tokens_used)`` for every question, hits or not.

    ``images`` (optional): ``qid, rnk, title, caption, tags`` lines listed after the sources.
    """
    kept = within_budget(hits, budget).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct(F.col("rnk").alias("n"), "chunk_id", F.col("title").alias("doc"), "block"))).alias("b"),
        F.sum("block_tokens").alias("block_tokens"),
    )
    out = queries.select("qid", "question").join(kept, "qid", "left")
    lines = F.array().cast("array<string>")
    line_tokens = F.lit(0).cast("long")
    if images is not None:
        tags = F.concat(F.lit("["), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]"))
        line = F.format_string("(image: %s) %s tags=%s", "title", F.coalesce("caption", F.lit("")), tags)
        shown = images.withColumn("line", line).groupBy("qid").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rnk", "line"))), lambda x: x["line"]).alias("lines"),
            F.sum(token_estimate(F.col("line"))).alias("line_tokens"),
        )
        out = out.join(shown, "qid", "left")
        lines = F.coalesce(F.col("lines"), lines)
        line_tokens = F.coalesce(F.col("line_tokens"), line_tokens)
    blocks = F.coalesce(F.transform("b", lambda x: x["block"]), F.array().cast("array<string>"))
    shown_lines = F.when(F.size(lines) > 0, F.concat(F.array(F.lit("IMAGES:")), lines)).otherwise(lines)
    parts = F.concat(
        F.array(F.lit("SOURCES:")), blocks, shown_lines, F.array(F.lit(""), F.concat(F.lit("QUESTION: "), F.col("question")))
    )
    return out.select(
        "qid", "question",
        F.array_join(parts, "\n\n").alias("user_text"),
        F.coalesce(
            F.transform("b", lambda x: F.struct(x["n"].alias("n"), x["chunk_id"].alias("chunk_id"), x["doc"].alias("doc"))),
            F.array().cast("array<struct<n:int,chunk_id:string,doc:string>>"),
        ).alias("citations"),
        (F.coalesce("block_tokens", F.lit(0)) + line_tokens).alias("tokens_used"),
    )


def ground(answers: DataFrame) -> DataFrame:
    """Split numbered sources by the markers an answer emits: ``kept, dropped, grounded``.

    Without any marker all sources are kept and the answer is not grounded. Needs ``answer`` and
    ``citations``.
    """
    marked = answers.withColumn("_emitted", citation_markers(F.coalesce("answer", F.lit(""))))
    some = F.size("_emitted") > 0
    hit = lambda c: F.array_contains("_emitted", c["n"])
    return marked.select(
        *answers.columns,
        F.when(some, F.filter("citations", hit)).otherwise(F.col("citations")).alias("kept"),
        F.when(some, F.transform(F.filter("citations", lambda c: ~hit(c)), lambda c: c["n"]))
        .otherwise(F.array().cast("array<int>"))
        .alias("dropped"),
        some.alias("grounded"),
    )


def number_sources(seen: DataFrame) -> DataFrame:
    """Stable source numbers over several retrieval steps: first seen, first numbered.

    ``seen``: ``qid, step, rnk, chunk_id``.
    """
    first = seen.groupBy("qid", "chunk_id").agg(F.min(F.struct("step", "rnk")).alias("at"))
    return _place(first, [F.asc("at")], None, "n").drop("at")


def source_payload(hits: DataFrame, chars: int = 400) -> DataFrame:
    return hits.select("qid", "rnk", "chunk_id", F.col("title").alias("doc"), F.substring("text", 1, chars).alias("text"), "score")


