"""Question batches to ranked hits: two arms, fusion, graph boost, rerank, parents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from bookloom import settings as S
from bookloom.functions.entities import phrases
from bookloom.functions.questions import year_range
from bookloom.functions.text import strip
from bookloom.functions.vectors import hash_embedding
from bookloom.operators import graph_query as gq
from bookloom.operators import keyword as kw
from bookloom.operators import knn, ranking
from bookloom.operators.scope import drop_unknown_tags, normalised
from bookloom.session import cut, stored
from bookloom.sources.library import Library


@dataclass(frozen=True)
class RetrievalConfig:
    """The switches of a retrieval run."""

    rerank_enabled: bool = True
    graph_boost: bool = True
    top_k_rerank: int = S.RERANK_TOP
    parent_child: bool = True
    metadata_filter: bool = True
    candidates: int = S.CANDIDATES
    fused: int = S.CANDIDATES
    order_by: str = "score"


def with_vectors(queries: DataFrame, dim: int = S.EMBED_DIM, embed=hash_embedding) -> DataFrame:
    return queries.withColumn("vector", embed(F.col("question"), dim).cast("array<float>"))


def with_year_filter(queries: DataFrame) -> DataFrame:
    """Default metadata hints: a bare year in the question limits the document dates."""
    hint = year_range(F.col("question"))
    return queries.withColumn("date_from", hint["date_from"]).withColumn("date_to", hint["date_to"])


def question_entities(queries: DataFrame, limit: int = S.GRAPH_NAMES, chars: int | None = None) -> DataFrame:
    """The first ``limit`` distinct capitalised phrases of each question, most frequent first."""
    found = queries.select("qid", F.posexplode(phrases(F.col("question"))).alias("at", "name")).groupBy("qid", "name").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("at")
    )
    return ranking._place(found, [F.desc("n"), F.asc("at")], limit).select("qid", "name")


def hit_details(lib: Library, hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Text, title and parent of each hit, and the question it answers.

    The hits are stored, so the planner knows that they are few and moves them to the chunks; vectors are those of the hits only.
    """
    chunk = lib.passages.select("chunk_id", "doc_id", "parent_id", "text", "chunk_index", "tokens")
    title = lib.document_meta.select("doc_id", "title")
    found = stored(hits, "hits").join(chunk, "chunk_id").withColumn("embedding", lib.embed(F.col("text"), lib.dim).cast("array<float>"))
    return found.join(title, "doc_id").join(queries.select("qid", "question"), "qid")


def two_arms(lib: Library, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Vector hits and keyword hits of normalised questions with vectors, ``k`` each."""
    near = knn.nearest(queries, lib.items, k).select("qid", F.col("item_id").alias("chunk_id"), "sim", "rnk")
    asked = queries.filter(strip(F.col("question")) != "")
    words = kw.keyword_search(asked, lib.document_meta, lib.term_rows, lib.postings, lib.term_frequencies, lib.term_stats, k)
    return near, words


def retrieve_context(
    lib: Library,
    queries: DataFrame,
    config: RetrievalConfig = RetrievalConfig(),
    rewrite: Column | None = None,
    rerank_score: Column | None = None,
    metadata=with_year_filter,
) -> DataFrame:
    """Ranked, possibly parent-expanded hits: ``qid, rnk, chunk_id, doc_id, title, text, score, ...``.

    ``queries(qid, question, corpus)``. ``rewrite`` may replace the question; ``metadata`` adds filter
    columns to the question batch.
    """
    asked = queries.select("qid", F.coalesce(rewrite, F.col("question")).alias("question") if rewrite is not None else "question", "corpus")
    if config.metadata_filter:
        asked = drop_unknown_tags(normalised(metadata(asked)), lib.document_meta)
    else:
        asked = normalised(asked)
    asked = cut(with_vectors(asked, lib.dim, lib.embed))
    near, words = two_arms(lib, asked, config.candidates)
    hits = ranking.fuse(near, words, config.fused)
    if config.graph_boost:
        found = gq.neighbor_chunks(lib.graph, question_entities(asked), 2, S.GRAPH_LIMIT)
        hits = ranking.merge_hits(hits, ranking.neutral_hits(found), config.candidates)
    detailed = hit_details(lib, hits, asked)
    if config.rerank_enabled:
        detailed = ranking.rerank(detailed, config.top_k_rerank, rerank_score)
    if config.parent_child:
        detailed = ranking.expand_to_parents(detailed, lib.parents, config.order_by)
    return detailed


HIT = ("qid", "rnk", "chunk_id", "doc_id", "parent_id", "title", "text", "score", "question")


def _by_run(hits: DataFrame, place: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``place``, which works per ``qid``, applied per ``run`` and ``qid``."""
    both = hits.withColumn("_qid", F.col("qid")).withColumn("qid", F.concat_ws("/", F.col("run").cast("string"), F.col("qid").cast("string")))
    return place(both).select("run", *[F.col("_qid").alias("qid") if c == "qid" else F.col(c) for c in HIT])


def _dealt(hits: DataFrame, runs: dict) -> DataFrame:
    """Rows of run ``n`` once for every number in ``runs[n]``, which becomes their run."""
    numbers = F.create_map(*[x for n, wanted in runs.items() for x in (F.lit(n), F.array(*[F.lit(w) for w in wanted]))])
    return hits.withColumn("run", F.explode(F.try_element_at(numbers, F.col("run"))))


def retrieve_each(lib: Library, queries: DataFrame, configs: list[RetrievalConfig], metadata=with_year_filter) -> DataFrame:
    """The hits of :func:`retrieve_context` for each configuration, with ``config``, its place in the list.

    What configurations share is done once: a question is searched once for all that leave it the same filters, neighbours in the
    graph depend on the question only, and texts, parents and overlaps are looked up for all hits together.
    """
    asked = queries.select("qid", "question", "corpus")
    filters = ("corpus", "tags", "date_from", "date_to", "author")
    scoped = None
    for filtered in sorted({c.metadata_filter for c in configs}):
        one = drop_unknown_tags(normalised(metadata(asked)), lib.document_meta) if filtered else normalised(asked)
        one = one.select("qid", "question", *filters, F.lit(filtered).alias("filtered"))
        scoped = one if scoped is None else scoped.unionByName(one)
    kinds = F.array_sort(F.collect_set("filtered")).alias("kinds")
    searched = scoped.groupBy("qid", "question", *filters).agg(kinds).withColumn(
        "search", F.concat_ws("/", F.array_join(F.col("kinds").cast("array<string>"), ""), F.col("qid").cast("string")))
    searched = cut(with_vectors(searched, lib.dim, lib.embed))
    near, words = two_arms(lib, searched.withColumn("qid", F.col("search")).drop("search", "kinds"), max(c.candidates for c in configs))
    one_arm = lambda hits, n: hits.select("qid", "chunk_id", "rnk", F.lit(n).alias("arm"))
    arms = stored(one_arm(near, 0).unionByName(one_arm(words, 1)), "arms")
    known = searched.select("search", F.col("qid").alias("asked"), F.explode("kinds").alias("filtered"))
    if any(c.graph_boost for c in configs):
        neighbours = stored(ranking.neutral_hits(gq.neighbor_chunks(lib.graph, question_entities(asked), 2, S.GRAPH_LIMIT)), "neighbours")

    searches = list(dict.fromkeys((c.metadata_filter, c.graph_boost, c.candidates, c.fused) for c in configs))
    hits = None
    for n, (filtered, graph_boost, candidates, top) in enumerate(searches):
        first = arms.filter(F.col("rnk") <= candidates)
        one = ranking.fuse(first.filter("arm = 0"), first.filter("arm = 1"), top).withColumnRenamed("qid", "search")
        one = one.join(known.filter(F.col("filtered") == filtered), "search").select(F.col("asked").alias("qid"), "chunk_id", "score", "rnk")
        if graph_boost:
            one = ranking.merge_hits(one, neighbours, candidates)
        one = one.select(F.lit(n).alias("run"), "qid", "chunk_id", "score", "rnk")
        hits = one if hits is None else hits.unionByName(one)
    detailed = stored(hit_details(lib, hits, asked).select("run", *HIT), "detailed")

    top = lambda c: c.top_k_rerank if c.rerank_enabled else None
    order = lambda c: c.order_by if c.parent_child else None
    source = lambda c: searches.index((c.metadata_filter, c.graph_boost, c.candidates, c.fused))
    lists = list(dict.fromkeys((source(c), top(c)) for c in configs))
    ranked = _staged(detailed, lists, lambda rows, n: ranking.rerank(rows, n))
    wanted = list(dict.fromkeys((lists.index((source(c), top(c))), order(c)) for c in configs))
    shown = _staged(ranked, wanted, lambda rows, by: ranking.expand_to_parents(rows, lib.parents, by))
    places: dict[int, list[int]] = {}
    for i, c in enumerate(configs):
        places.setdefault(wanted.index((lists.index((source(c), top(c))), order(c))), []).append(i)
    return _dealt(shown, places).withColumnRenamed("run", "config")


def _staged(hits: DataFrame, steps: list[tuple], place: Callable[[DataFrame, object], DataFrame]) -> DataFrame:
    """Runs ``0, 1, ...`` of ``steps``, pairs of a former run and how its hits are placed; nothing leaves them as they are."""
    out = None
    for how in dict.fromkeys(how for _, how in steps):
        runs: dict[int, list[int]] = {}
        for n, (former, by) in enumerate(steps):
            if by == how:
                runs.setdefault(former, []).append(n)
        rows = _dealt(hits, runs)
        rows = rows.select("run", *HIT) if how is None else _by_run(rows, lambda df, how=how: place(df, how))
        out = rows if out is None else out.unionByName(rows)
    return out


def hybrid_search(lib: Library, queries: DataFrame, top: int = 5) -> DataFrame:
    """Plain hybrid search: 12 hits per arm, 10 fused, reranked to ``top`` (1..6), no filters or graph."""
    asked = cut(with_vectors(normalised(queries.select("qid", "question", "corpus")), lib.dim, lib.embed))
    near, words = two_arms(lib, asked, 12)
    hits = hit_details(lib, ranking.fuse(near, words, 10), asked)
    return ranking.rerank(hits, max(1, min(int(top), 6)))
