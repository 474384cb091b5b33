"""A batch of questions end to end: lane, cache, retrieval, answer, citations, cache rows, messages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from bookloom import settings as S
from bookloom.functions.questions import asks_whole_library, lane
from bookloom.functions.text import data_url, token_estimate, word_count
from bookloom.operators import cache, catalog as ct, contradictions, conversations as cv, knn, ranking
from bookloom.operators.models import extractive_answer, never_contradicts
from bookloom.plans import overview
from bookloom.plans.retrieve import RetrievalConfig, retrieve_context, with_vectors
from bookloom.session import cut
from bookloom.sources.library import Library

GREETING = "Ask me anything about the documents of this library."


@dataclass(frozen=True)
class Answered:
    """What a batch produces; the caller appends the rows it wants to keep."""

    answers: DataFrame  # qid, question, corpus, lane, mode, answer, cached, error, citations, sources, grounded, tokens_in, tokens_out, cost_usd
    cache_entries: DataFrame
    messages: DataFrame
    lookups: DataFrame
    alerts: DataFrame  # qid, alert, a, b, reason: sources of an answer that contradict each other
    contradictions: DataFrame  # a, b: contradicting chunks not known before


def route(questions: DataFrame) -> DataFrame:
    """Adds ``lane`` and ``whole_library``; optional columns ``image`` (a data URL, or whether there is one) and ``mode`` are honoured."""
    have = dict(questions.dtypes)
    pictured = {"boolean": F.col("image"), "string": F.col("image").isNotNull()}.get(have.get("image", ""))
    picked = lane(F.col("question"), pictured, F.col("mode") if "mode" in have else None)
    return questions.withColumn("lane", picked).withColumn("whole_library", asks_whole_library(F.col("question")))


def with_turns(questions: DataFrame, messages: DataFrame | None) -> DataFrame:
    """Adds ``turns``, the last turns of the question's conversation; only asked conversations are read."""
    none = F.array().cast("array<struct<role:string,content:string>>")
    if messages is None:
        return questions.withColumn("turns", none)
    held = messages.join(questions.select("conversation_id").distinct(), "conversation_id", "left_semi")
    return questions.join(cv.history(held), "conversation_id", "left").withColumn("turns", F.coalesce("turns", none))


def image_hits(lib: Library, asked: DataFrame, embed_image, n: int = S.IMAGE_HITS) -> DataFrame:
    """``qid, rnk, image_id, title, caption, tags, score``: images nearest to the picture of a question (a data URL in ``image``).

    A picture that cannot be read finds nothing.
    """
    pictures = asked.withColumn("picture", data_url(F.col("image"))).filter("picture is not null")
    vectors = pictures.select("qid", "corpus", embed_image(F.col("picture.bytes"), lib.dim).alias("vector"))
    held = lib.images.select(F.col("image_id").alias("item_id"), "corpus", "vector")
    found = knn.nearest(vectors, held, n).withColumnRenamed("item_id", "image_id")
    titles = lib.document_meta.select("doc_id", "title")
    shown = lib.images.select("image_id", "doc_id", "caption", "tags").join(titles, "doc_id")
    return found.join(shown, "image_id").select("qid", "rnk", "image_id", "title", "caption", "tags", F.round("sim", 4).alias("score"))


def answer(
    lib: Library, questions: DataFrame, versions: DataFrame, entries: DataFrame, now: Column,
    generate=None, model: str = "llama-3.3-70b-versatile", chat=None, fast_model: str = "llama-3.1-8b-instant",
    communities: DataFrame | None = None, messages: DataFrame | None = None, judge=never_contradicts, known: DataFrame | None = None,
    note=overview.word_note, reduce=None,
) -> Answered:
    """Answer ``questions(qid, question, corpus, conversation_id)``, optionally with ``image`` (a data URL) and ``mode``.

    * Small talk (the fast lane) skips cache and retrieval: ``chat(df) -> df with answer, error`` replies at the price of
      ``fast_model``.
    * Cached answers are replayed with their sources and citations; a question with a picture is never looked up.
    * Deep questions about the whole library are answered from ``communities`` (cid, summary, entity_count, members), map and
      reduce; those that no summary speaks to go on like the rest.
    * A picture is answered from the images nearest to it.
    * The rest is retrieved (with graph boost in the deep lane), generated by ``generate(df) -> df with answer, error`` over
      ``user_text``, ``citations`` and ``turns``, and grounded. ``judge`` looks at pairs of its sources for contradictions, after
      those in ``known (a, b)``.

    ``messages`` is the log so far: the last turns of a conversation go into prompts. A question without conversation opens one of
    its own.
    """
    spark = lib.spark
    if "image" not in questions.columns:
        questions = questions.withColumn("image", F.lit(None).cast("string"))
    opened = questions.withColumn("conversation_id", F.coalesce("conversation_id", F.concat(F.lit("conv-"), F.col("qid").cast("string"))))
    routed = cut(with_turns(with_vectors(route(opened), lib.dim, lib.embed), messages))
    serious = routed.filter("lane <> 'fast'")
    current = ct.current_versions(versions)
    asked = cut(serious.withColumn("_c", F.coalesce("corpus", F.lit("default"))).join(
        current.select(F.col("corpus").alias("_c"), "version"), "_c", "left"
    ).withColumn("version", F.coalesce("version", F.lit(0))).drop("_c"))
    looked = cut(cache.lookup(asked.filter("image is null"), entries, now))
    hit = looked.filter("hit").select("qid", "entry_id").join(
        entries.select("entry_id", F.col("answer").alias("stored"), F.col("sources").alias("stored_sources"), F.col("citations").alias("stored_citations")), "entry_id"
    ).select("qid", "stored", "stored_sources", "stored_citations")
    left = asked.join(hit, "qid", "left_anti")

    about_all = left.filter("lane = 'deep' and whole_library and image is null").select("qid", "question")
    told = cut(overview.global_answers(about_all, communities, note, reduce)) if communities is not None else None
    if told is not None:
        left = left.join(told, "qid", "left_anti")
    with_image, without = left.filter("image is not null"), left.filter("image is null")

    deep = retrieve_context(lib, without.filter("lane = 'deep'"), RetrievalConfig(graph_boost=True))
    plain = retrieve_context(lib, without.filter("lane <> 'deep'"), RetrievalConfig(graph_boost=False))
    cols = ["qid", "rnk", "chunk_id", "title", "text"]
    hits = cut(deep.select(*cols).unionByName(plain.select(*cols)))
    pictures = cut(image_hits(lib, with_image, lib.embed_image))
    lead = hits.filter("rnk = 1").select("qid", F.col("text").alias("first_text")).unionByName(
        pictures.filter("rnk = 1").select("qid", F.col("caption").alias("first_text"))
    )
    prompts = ranking.assemble(left, hits, pictures).join(lead, "qid", "left").join(left.select("qid", "turns"), "qid")
    replied = generate(prompts) if generate else prompts.withColumn(
        "answer", extractive_answer(F.coalesce("first_text", F.lit("")))
    ).withColumn("error", F.lit(None).cast("string"))
    grounded = cut(ranking.ground(replied.select("qid", "answer", "error", "citations", "user_text")))

    vectors = lib.items.select(F.col("item_id").alias("chunk_id"), "vector")
    pairs = contradictions.candidate_pairs(hits.select("qid", "rnk", "chunk_id").join(vectors, "chunk_id"))
    known = known if known is not None else spark.createDataFrame([], "a string, b string")
    alerts, fresh_edges = contradictions.scan(pairs, known, lib.chunks, judge)

    text = lambda c: F.to_json(c)
    nothing, no_list = F.lit(None).cast("string"), F.lit("[]")
    base = ["qid", "question", "corpus", "conversation_id", "lane", "vector"]
    fresh = asked.join(grounded, "qid").select(
        *base, "version", F.when(F.col("image").isNull(), "retrieval").otherwise("image").alias("mode"), "answer", F.lit(False).alias("cached"), "error",
        text(F.col("kept")).alias("citations"), text(F.col("citations")).alias("sources"), "grounded",
        token_estimate(F.col("user_text")).alias("tokens_in"), word_count(F.coalesce("answer", F.lit(""))).alias("tokens_out"),
    )
    replay = asked.join(hit, "qid").select(
        *base, "version", F.lit("cache").alias("mode"), F.col("stored").alias("answer"), F.lit(True).alias("cached"), nothing.alias("error"),
        F.coalesce("stored_citations", no_list).alias("citations"), F.coalesce("stored_sources", no_list).alias("sources"), F.lit(False).alias("grounded"),
        F.lit(0).alias("tokens_in"), F.lit(0).alias("tokens_out"),
    )
    talked = routed.filter("lane = 'fast'")
    talked = chat(talked) if chat else talked.withColumn("answer", F.lit(GREETING)).withColumn("error", nothing)
    small_talk = talked.select(
        *base, F.lit(0).alias("version"), F.lit("chat").alias("mode"), "answer", F.lit(False).alias("cached"), "error",
        no_list.alias("citations"), no_list.alias("sources"), F.lit(False).alias("grounded"),
        token_estimate(F.col("question")).alias("tokens_in"), word_count(F.coalesce("answer", F.lit(""))).alias("tokens_out"),
    )
    rows = fresh.unionByName(replay).unionByName(small_talk)
    if told is not None:
        rows = rows.unionByName(_global_rows(asked, told, communities, base))
    everything = ct.with_cost(rows.withColumn("model", F.when(F.col("lane") == "fast", fast_model).otherwise(model)), ct.price_table(spark))
    usage = F.to_json(F.struct(F.col("tokens_in").alias("in"), F.col("tokens_out").alias("out"), "lane", "mode"))
    talk = everything.withColumn("usage", usage)
    storable = everything.filter("mode = 'retrieval' or mode = 'global'")
    return Answered(everything.drop("vector", "version", "model"), cache.new_entries(storable, now), cv.exchange_rows(talk, now), looked, alerts, fresh_edges)


def _global_rows(asked: DataFrame, told: DataFrame, communities: DataFrame, base: list[str]) -> DataFrame:
    """Answers over communities, cited as communities."""
    used = told.select("qid", F.posexplode("communities").alias("at", "cid")).join(communities.select("cid", "summary"), "cid")
    cited = used.groupBy("qid").agg(F.to_json(F.array_sort(F.collect_list(F.struct(
        (F.col("at") + 1).alias("n"), F.col("cid").alias("community_id"), F.lit("Community").alias("doc"),
        F.substring("summary", 1, S.CITED_SUMMARY_CHARS).alias("summary"),
    )))).alias("citations"))
    return asked.join(told, "qid").join(cited, "qid").select(
        *base, "version", F.lit("global").alias("mode"), "answer", F.lit(False).alias("cached"), F.lit(None).cast("string").alias("error"),
        "citations", F.col("citations").alias("sources"), F.lit(True).alias("grounded"),
        F.col("tokens_in").cast("int").alias("tokens_in"), F.col("tokens_out").cast("int").alias("tokens_out"),
    )
