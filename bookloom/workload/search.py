"""Search queries: vector, keyword, fusion, reranking, parents, contexts, cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bookloom import settings as S
from bookloom.operators import graph_query as gq
from bookloom.operators import keyword as kw
from bookloom.operators import knn, ranking
from bookloom.operators.scope import drop_unknown_tags, normalised
from bookloom.operators.vector_index import VectorIndex
from bookloom.plans import retrieve as plan
from bookloom.session import scratch_path
from bookloom.sources import sample
from bookloom.sources.library import open_sample
from bookloom.workload import query
from bookloom.workload import sql as s


def _asked(spark, folder) -> DataFrame:
    return plan.with_vectors(normalised(sample.questions(spark, folder)))


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


@query(s.with_(s.PASSAGES, s.QUESTIONS, s.vector_arm(10)) + "SELECT qid, rnk, chunk_id, round(sim, 6) AS sim FROM vec")
def vector_topk(spark, folder):
    lib = open_sample(spark, folder)
    hits = knn.nearest(_asked(spark, folder), lib.items, 10)
    return _long(hits, "rnk").select("qid", "rnk", F.col("item_id").alias("chunk_id"), F.round("sim", 6).alias("sim"))


_FILTERED = """
fq AS (SELECT *, CASE WHEN item_id % 3 = 0 THEN ['en'] WHEN item_id % 3 = 1 THEN ['t' || (item_id % 5)] END AS tags0,
  CASE WHEN item_id % 4 = 0 THEN TIMESTAMP '2020-06-01' END AS d0, CASE WHEN item_id % 4 = 0 THEN TIMESTAMP '2022-06-30' END AS d1,
  CASE WHEN item_id % 5 = 0 THEN 'author ' || (item_id % 7) END AS author FROM questions),
filtered AS MATERIALIZED (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM docs d WHERE d.corpus = coalesce(fq.corpus, 'default')
  AND list_has_any(d.tags, fq.tags0)) THEN tags0 END AS tags FROM fq)"""
_WHERE = """(q.corpus IS NULL OR c.corpus = q.corpus) AND (q.tags IS NULL OR list_has_any(d.tags, q.tags)) AND (q.d0 IS NULL OR d.doc_date >= q.d0)
  AND (q.d1 IS NULL OR d.doc_date <= q.d1) AND (q.author IS NULL OR contains(lower(d.author), q.author))"""


def _filtered(spark, folder, lib) -> DataFrame:
    asked = drop_unknown_tags(normalised(sample.filtered_questions(spark, folder)), lib.document_meta)
    return plan.with_vectors(asked)


@query(s.with_(s.PASSAGES, s.QUESTIONS, _FILTERED, s.vector_arm(10, "filtered", _WHERE), s.keyword_arm(10, "filtered", _WHERE)) + """
SELECT qid, 'vector' AS arm, rnk, chunk_id FROM vec UNION ALL SELECT qid, 'keyword', rnk, chunk_id FROM kwd""")
def meta_filter_search(spark, folder):
    lib = open_sample(spark, folder)
    near, words = plan.two_arms(lib, _filtered(spark, folder, lib), 10)
    return _long(near.select("qid", F.lit("vector").alias("arm"), "rnk", "chunk_id").unionByName(
        words.select("qid", F.lit("keyword").alias("arm"), "rnk", "chunk_id")), "rnk")


@query(s.with_(s.PASSAGES, s.QUESTIONS, s.keyword_arm(10)) + "SELECT qid, rnk, chunk_id, round(score, 6) AS score FROM kwd")
def keyword_topk(spark, folder):
    lib = open_sample(spark, folder)
    q = normalised(sample.questions(spark, folder))
    hits = kw.keyword_search(q, lib.document_meta, lib.term_rows, lib.postings, lib.term_frequencies, lib.term_stats, 10)
    return _long(hits, "rnk").select("qid", "rnk", "chunk_id", F.round("score", 6).alias("score"))


@query(s.with_(s.PASSAGES) + f"""
SELECT term, count(*) AS df FROM (SELECT chunk_id, unnest(list_distinct({s.term_list('text')})) AS term FROM chunks) GROUP BY term""")
def term_index(spark, folder):
    return kw.document_frequency(open_sample(spark, folder).postings)


def _fused(spark, folder, lib, k=S.CANDIDATES, top=S.CANDIDATES):
    near, words = plan.two_arms(lib, _asked(spark, folder), k)
    return ranking.fuse(near, words, top)


@query(s.with_(s.PASSAGES, s.QUESTIONS, s.vector_arm(20), s.keyword_arm(20), s.fused()) + "SELECT qid, rnk, chunk_id, round(raw, 8) AS score FROM fused")
def rrf_hybrid(spark, folder):
    lib = open_sample(spark, folder)
    near, words = plan.two_arms(lib, _asked(spark, folder), S.CANDIDATES)
    hits = ranking.fuse(near, words)
    exact = hits.join(near.select("qid", "chunk_id", F.col("rnk").alias("v")), ["qid", "chunk_id"], "left").join(
        words.select("qid", "chunk_id", F.col("rnk").alias("k")), ["qid", "chunk_id"], "left")
    raw = F.coalesce(1.0 / (60 + F.col("v")), F.lit(0.0)) + F.coalesce(1.0 / (60 + F.col("k")), F.lit(0.0))
    return _long(exact, "rnk").select("qid", "rnk", "chunk_id", F.round(raw, 8).alias("score"))


@query(s.with_(s.GRAPH, s.QUESTIONS, s.NEIGHBORS) + "SELECT qid, chunk_id FROM neighbors")
def neighbor_chunks(spark, folder):
    lib = open_sample(spark, folder)
    return gq.neighbor_chunks(lib.graph, plan.question_entities(sample.questions(spark, folder)))


_MERGED = (s.GRAPH, s.QUESTIONS, s.vector_arm(20), s.keyword_arm(20), s.fused(), s.NEIGHBORS, s.merged())


def _merged(spark, folder, lib):
    found = gq.neighbor_chunks(lib.graph, plan.question_entities(sample.questions(spark, folder)))
    return ranking.merge_hits(_fused(spark, folder, lib), ranking.neutral_hits(found))


@query(s.with_(*_MERGED) + "SELECT qid, rnk, chunk_id, score FROM merged")
def merge_hits(spark, folder):
    return _long(_merged(spark, folder, open_sample(spark, folder)), "rnk").select("qid", "rnk", "chunk_id", "score")


@query(s.with_(s.PASSAGES, s.QUESTIONS, s.vector_arm(20), s.keyword_arm(20), s.fused(), s.reranked("fused")) + """
SELECT qid, rnk, chunk_id, round(s, 6) AS overlap, fused_rnk FROM reranked""")
def lexical_rerank(spark, folder):
    lib = open_sample(spark, folder)
    q = sample.questions(spark, folder)
    hits = ranking.rerank(plan.hit_details(lib, _fused(spark, folder, lib), q))
    return _long(hits, "rnk", "fused_rnk").select("qid", "rnk", "chunk_id", F.round(ranking.lexical_overlap(F.col("question"), F.col("text")), 6).alias("overlap"), "fused_rnk")


@query(s.with_(s.PASSAGES, s.QUESTIONS, s.vector_arm(12), s.keyword_arm(12), s.fused(10), s.reranked("fused", 5)) + """
SELECT qid, rnk, chunk_id, substr(c.text, 1, 700) AS passage FROM reranked JOIN chunks c USING (chunk_id)""")
def hybrid_search(spark, folder):
    hits = plan.hybrid_search(open_sample(spark, folder), sample.questions(spark, folder))
    return _long(hits, "rnk").select("qid", "rnk", "chunk_id", F.substring("text", 1, 700).alias("passage"))


@query(s.with_(s.PASSAGES, s.QUESTIONS, s.vector_arm(20), s.keyword_arm(20), s.fused(), s.reranked("fused", 10), s.EXPANDED) + """
SELECT qid, rnk, chunk_id, md5(text) AS text_md5, title, score FROM expanded""")
def parent_expand(spark, folder):
    lib = open_sample(spark, folder)
    q = sample.questions(spark, folder)
    hits = ranking.rerank(plan.hit_details(lib, _fused(spark, folder, lib), q), 10)
    out = ranking.expand_to_parents(hits, lib.parents)
    return _long(out, "rnk").select("qid", "rnk", "chunk_id", F.md5("text").alias("text_md5"), "title", "score")


FULL = (*_MERGED, s.reranked("merged"), s.EXPANDED)


@query(s.with_(*FULL) + "SELECT qid, rnk, chunk_id, title, score, round(s, 6) AS overlap, md5(text) AS text_md5 FROM expanded")
def retrieve_context(spark, folder):
    lib = open_sample(spark, folder)
    hits = plan.retrieve_context(lib, sample.questions(spark, folder))
    child = lib.chunks.select("chunk_id", F.col("text").alias("child"))
    return _long(hits.join(child, "chunk_id"), "rnk").select(
        "qid", "rnk", "chunk_id", "title", "score", F.round(ranking.lexical_overlap(F.col("question"), F.col("child")), 6).alias("overlap"), F.md5("text").alias("text_md5"))


_CONTEXT = (s.PASSAGES, s.QUESTIONS, s.vector_arm(20), s.keyword_arm(20), s.fused(), s.reranked("fused", 10), s.EXPANDED, s.BLOCKS)


def contexts(spark, folder) -> DataFrame:
    """Assembled contexts of all questions over reranked, parent-expanded hits."""
    lib = open_sample(spark, folder)
    q = sample.questions(spark, folder)
    hits = ranking.expand_to_parents(ranking.rerank(plan.hit_details(lib, _fused(spark, folder, lib), q), 10), lib.parents)
    return ranking.assemble(q, hits)


_ASSEMBLED = """
SELECT q.qid, md5('SOURCES:' || chr(10) || chr(10) || coalesce(string_agg(k.block, chr(10) || chr(10) ORDER BY k.rnk) || chr(10) || chr(10), '') ||
    chr(10) || chr(10) || 'QUESTION: ' || any_value(q.question)) AS prompt_md5,
  CAST(coalesce(sum(bt), 0) AS BIGINT) AS tokens_used, count(k.rnk) AS n_sources, string_agg(k.chunk_id, ',' ORDER BY k.rnk) AS sources
FROM questions q LEFT JOIN kept k ON k.qid = q.qid GROUP BY q.qid"""


@query(s.with_(*_CONTEXT) + _ASSEMBLED)
def context_budget(spark, folder):
    c = contexts(spark, folder)
    ids = F.transform("citations", lambda x: x["chunk_id"])
    return c.select(
        "qid", F.md5("user_text").alias("prompt_md5"), F.col("tokens_used").cast("long").alias("tokens_used"),
        F.size("citations").cast("long").alias("n_sources"), F.when(F.size(ids) > 0, F.array_join(ids, ",")).alias("sources"))


@query(s.with_(*_CONTEXT, """
ans AS (SELECT qid, CASE WHEN item_id % 4 = 3 THEN [] ELSE [1, 3, item_id % 7, 12] END AS m FROM questions)""") + """
SELECT a.qid, len(m) > 0 AS grounded, string_agg(CASE WHEN len(m) = 0 OR list_contains(m, k.rnk) THEN k.rnk END, ',' ORDER BY k.rnk) AS kept,
  string_agg(CASE WHEN len(m) > 0 AND NOT list_contains(m, k.rnk) THEN k.rnk END, ',' ORDER BY k.rnk) AS dropped
FROM ans a LEFT JOIN kept k ON k.qid = a.qid GROUP BY a.qid, m""")
def citation_grounding(spark, folder):
    n = F.col("item_id")
    marks = F.when(n % 4 == 3, F.lit("")).otherwise(F.format_string(" [1] see [3], [%d] and [12][1]", n % 7))
    answers = contexts(spark, folder).join(sample.questions(spark, folder).select("qid", "item_id"), "qid").withColumn("answer", F.concat(F.lit("So"), marks))
    g = ranking.ground(answers)
    joined = lambda a: F.when(F.size(a) > 0, F.array_join(F.transform(a, lambda x: x.cast("string")), ","))
    return g.select("qid", "grounded", joined(F.transform("kept", lambda c: c["n"])).alias("kept"), joined(F.col("dropped")).alias("dropped"))


@query(s.with_(s.PASSAGES, s.QUESTIONS, s.vector_arm(20), s.keyword_arm(20)) + """
, seen AS (SELECT qid, 1 AS step, rnk, chunk_id FROM vec UNION ALL SELECT qid, 2, rnk, chunk_id FROM kwd)
SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY min(step * 1000 + rnk)) AS n FROM seen GROUP BY qid, chunk_id""".lstrip())
def source_numbers(spark, folder):
    near, words = plan.two_arms(open_sample(spark, folder), _asked(spark, folder), S.CANDIDATES)
    seen = near.select("qid", F.lit(1).alias("step"), "rnk", "chunk_id").unionByName(words.select("qid", F.lit(2).alias("step"), "rnk", "chunk_id"))
    return _long(ranking.number_sources(seen), "n").select("qid", "chunk_id", "n")


@query("""
WITH img AS (SELECT printf('img%06d', e.vec_id) AS image_id, d.source AS corpus, e.label, CAST(e.embedding AS DOUBLE[]) AS v
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
dims AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM img),
ctr AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM dims GROUP BY ALL) GROUP BY label)
SELECT CAST(c.label AS VARCHAR) AS qid, image_id, round(list_cosine_similarity(c.v, i.v), 6) AS sim,
  row_number() OVER (PARTITION BY c.label ORDER BY round(list_cosine_similarity(c.v, i.v), 9) DESC, image_id) AS rnk
FROM ctr c JOIN img i ON true QUALIFY rnk <= 5""")
def image_topk(spark, folder):
    """Images nearest to the mean vector of each label."""
    img = sample.image_vectors(spark, folder)
    means = img.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    asked = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("vector"))
    q = asked.select(F.col("label").cast("string").alias("qid"), "vector")
    hits = knn.nearest(q, img.select(F.col("image_id").alias("item_id"), "vector"), 5)
    return _long(hits, "rnk").select("qid", F.col("item_id").alias("image_id"), F.round("sim", 6).alias("sim"), "rnk")


@query("""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id AS qid, b.vec_id AS item_id, round(list_cosine_similarity(a.v, b.v), 6) AS sim,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id) AS rnk
FROM v a JOIN v b ON a.label = b.label QUALIFY rnk <= 5""")
def vector_topk_scoped(spark, folder):
    """Every vector against the vectors of its label, on the cell grid."""
    e = sample.table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    hits = knn.nearest(e.withColumnRenamed("vec_id", "qid"), e.withColumnRenamed("vec_id", "item_id"), 5, "label", layout="grid")
    return _long(hits, "rnk").select("qid", "item_id", F.round("sim", 6).alias("sim"), "rnk")


@query()
def ann_topk(spark, folder):
    """Approximate neighbours of every question, in its corpus, from the stored index with its measured number of cells."""
    hits = open_sample(spark, folder).vector_index.search(_asked(spark, folder).select("qid", "vector", "corpus"), 10)
    return _long(hits, "rnk").select("qid", "rnk", F.col("item_id").alias("chunk_id"), F.round("sim", 6).alias("sim"))


def _indexed(spark, folder):
    """A stored index over the given vectors, and every fiftieth of them as a question."""
    e = sample.table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    index = VectorIndex.build(e, scratch_path(spark, "embeddings-index"))
    return index, e, e.filter("item_id % 50 = 0").withColumnRenamed("item_id", "qid")


_NEAR = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id AS qid, b.vec_id AS item_id, round(list_cosine_similarity(a.v, b.v), 6) AS sim,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id) AS rnk
FROM v a JOIN v b ON a.vec_id % 50 = 0 QUALIFY rnk <= 10"""


@query(_NEAR)
def index_all_cells(spark, folder):
    """With every cell probed the index gives the exact neighbours."""
    index, _, asked = _indexed(spark, folder)
    hits = index.search(asked, 10, probes=len(index.centres))
    return _long(hits, "rnk").select("qid", "item_id", F.round("sim", 6).alias("sim"), "rnk")


@query("SELECT count(*) AS questions, true AS recalled, true AS below_all FROM embeddings WHERE vec_id % 50 = 0")
def index_recall(spark, folder):
    """The measured number of cells finds nine tenths of the exact neighbours or more."""
    index, e, asked = _indexed(spark, folder)
    exact = knn.nearest(asked, e, 10).select("qid", "item_id")
    found = index.search(asked, 10).select("qid", "item_id", F.lit(1).alias("found"))
    met = exact.join(found, ["qid", "item_id"], "left").agg(
        F.count_distinct("qid").alias("questions"), (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("recalled"),
    )
    return met.withColumn("below_all", F.lit(index.probes <= len(index.centres)))
