"""Answering queries: cache, contradictions, metrics, evaluation matrix, global answers, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bookloom.functions.vectors import hash_embedding
from bookloom.operators import cache, contradictions
from bookloom.operators import conversations as cv
from bookloom.operators import evaluation as ev
from bookloom.operators import knn
from bookloom.operators.models import contains_claim
from bookloom.plans import evaluate, overview, reorganize
from bookloom.plans import retrieve as plan
from bookloom.operators.scope import normalised
from bookloom.session import cut
from bookloom.sources import sample
from bookloom.sources.library import open_sample
from bookloom.workload import query, texts
from bookloom.workload import sql as s


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


NOW = 1704067200 + 40 * 3600

_CACHE = (s.MESSAGES, f"""
um AS MATERIALIZED (SELECT *, 'src' || (conv_id % 20) AS corpus, CAST({s.embedding('content')} AS DOUBLE[]) AS v FROM messages WHERE role = 'user'),
entries AS MATERIALIZED (SELECT message_id AS entry_id, corpus, content, v, turn % 3 AS version, ts + 3600 > {NOW - 3600 * 30} AS live FROM um)""")


def _cache_tables(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Every user message was cached once, at a corpus version by its turn, for a limited time; every
    user message is asked again at the first version."""
    m = sample.messages(spark, folder).filter("role = 'user'").select(
        "message_id", "content", "created_at", "turn", F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("corpus"),
        hash_embedding(F.col("content")).cast("array<float>").alias("vector"))
    entries = m.select(
        F.col("message_id").alias("entry_id"), "corpus", F.col("content").alias("question"), "vector", (F.col("turn") % 3).cast("int").alias("corpus_version"),
        F.lit(0).alias("hit_count"), (F.col("created_at") + F.make_dt_interval(hours=F.lit(31))).alias("expires_at"))
    asked = m.select(F.col("message_id").alias("qid"), F.col("content").alias("question"), "corpus", F.lit(0).alias("version"), "vector")
    return asked, entries


_NEAREST = """
near AS MATERIALIZED (SELECT q.message_id AS qid, e.entry_id, e.content AS stored, q.content AS asked, round(list_cosine_similarity(q.v, e.v), 9) AS sim
  FROM um q JOIN entries e ON e.corpus = q.corpus AND e.version = 0 AND e.live
  QUALIFY row_number() OVER (PARTITION BY q.message_id ORDER BY round(list_cosine_similarity(q.v, e.v), 9) DESC, e.entry_id) = 1)"""


# The nearest entry serves a question if it is close and the wording guard has nothing against it.
_SERVED = (f"""
tk AS MATERIALIZED (SELECT *, {texts._TOK.format(x='stored')} AS a, {texts._TOK.format(x='asked')} AS b, {texts._CAP.format(x='stored')} AS ca, {texts._CAP.format(x='asked')} AS cb FROM near)""", f"""
lk AS MATERIALIZED (SELECT m.message_id AS qid, n.entry_id, round(n.sim, 6) AS sim, coalesce(n.sim >= 0.92 AND NOT ({texts.DIFFERENT}), false) AS hit
  FROM um m LEFT JOIN tk n ON n.qid = m.message_id)""")


@query(s.with_(*_CACHE, _NEAREST, *_SERVED) + "SELECT qid, entry_id, sim, hit FROM lk")
def cache_lookup(spark, folder):
    """Nearest live entry, its similarity, and whether it serves the question."""
    asked, entries = _cache_tables(spark, folder)
    out = cache.lookup(asked, entries, F.timestamp_seconds(F.lit(NOW)))
    return out.select("qid", "entry_id", F.round("sim", 6).alias("sim"), "hit")


@query(s.with_(*_CACHE, _NEAREST, *_SERVED) + "SELECT qid, entry_id, hit FROM lk")
def cache_lookup_guarded(spark, folder):
    asked, entries = _cache_tables(spark, folder)
    return cache.lookup(asked, entries, F.timestamp_seconds(F.lit(NOW))).select("qid", "entry_id", "hit")


@query(s.with_(*_CACHE, _NEAREST, *_SERVED) + """
SELECT (SELECT count(*) FROM entries WHERE live) AS entries, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 4) AS hit_rate FROM lk""")
def cache_stats(spark, folder):
    asked, entries = _cache_tables(spark, folder)
    now = F.timestamp_seconds(F.lit(NOW))
    return cache.stats(entries, cache.lookup(asked, entries, now), now)


@query(s.with_(*_CACHE, """
bad AS (SELECT m.* FROM messages m WHERE role = 'assistant' AND (conv_id + turn + 1) % 3 = 0)""", """
asked AS (SELECT DISTINCT (SELECT u.message_id FROM messages u WHERE u.conversation_id = b.conversation_id AND u.role = 'user' AND u.ts <= b.ts
  ORDER BY u.ts DESC, u.message_id DESC LIMIT 1) AS message_id FROM bad b)""") + """
SELECT entry_id FROM entries e WHERE NOT EXISTS (SELECT 1 FROM asked a JOIN um u ON u.message_id = a.message_id
  WHERE u.corpus = e.corpus AND round(list_cosine_similarity(u.v, e.v), 9) >= 0.9)""")
def cache_evict(spark, folder):
    """A thumbs-down on an answer evicts what is close (0.9) to the question before it."""
    _, entries = _cache_tables(spark, folder)
    down = cv.latest_feedback(sample.feedback(spark, folder)).filter("rating < 0").select("message_id")
    asked = cv.prior_questions(sample.messages(spark, folder)).join(down, "message_id").filter("question is not null")
    vault = sample.conversations(spark, folder).select("conversation_id", F.col("vault_name").alias("corpus"))
    disliked = asked.join(vault, "conversation_id").select("question_id", "corpus", "question").distinct().select(
        F.col("question_id").alias("qid"), "corpus", hash_embedding(F.col("question")).cast("array<float>").alias("vector"))
    return cache.evict(entries, disliked, 0.9).select("entry_id")


@query(s.with_(s.PASSAGES, s.QUESTIONS, s.vector_arm(10)) + """
, pr AS (SELECT a.qid, a.chunk_id AS a, b.chunk_id AS b, a.rnk AS ra, b.rnk AS rb, round(list_cosine_similarity(x.v, y.v), 9) AS sim
  FROM vec a JOIN vec b ON a.qid = b.qid AND a.rnk < b.rnk JOIN c_vec x ON x.chunk_id = a.chunk_id JOIN c_vec y ON y.chunk_id = b.chunk_id),
band AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, ra, rb) AS pair_no FROM pr WHERE sim BETWEEN 0.70 AND 0.95 QUALIFY pair_no <= 4)
SELECT qid, pair_no, a, b, round(sim, 6) AS sim FROM band UNION ALL
SELECT qid, 1, a, b, NULL FROM pr WHERE ra = 1 AND rb = 2 AND qid NOT IN (SELECT qid FROM band)""")
def contradiction_pairs(spark, folder):
    lib = open_sample(spark, folder)
    asked = plan.with_vectors(normalised(sample.questions(spark, folder)))
    hits = knn.nearest(asked, lib.items, 10).join(lib.items.select("item_id", "vector"), "item_id")
    pairs = contradictions.candidate_pairs(hits.select("qid", "rnk", F.col("item_id").alias("chunk_id"), "vector"))
    return _long(pairs, "pair_no").select("qid", "pair_no", "a", "b", F.round("sim", 6).alias("sim"))


@query()
def contradiction_scan(spark, folder):
    """Candidate pairs judged by a rule: different languages of the same length class disagree."""
    lib = open_sample(spark, folder)
    asked = plan.with_vectors(normalised(sample.questions(spark, folder)))
    hits = knn.nearest(asked, lib.items, 10).join(lib.items.select("item_id", "vector"), "item_id")
    pairs = contradictions.candidate_pairs(hits.select("qid", "rnk", F.col("item_id").alias("chunk_id"), "vector"))
    known = pairs.filter("pair_no = 2").select(F.col("b").alias("a"), F.col("a").alias("b"))

    def judge(df):
        return df.withColumn("contradicts", (F.length("text_a") % 5) == (F.length("text_b") % 5)).withColumn("reason", F.lit("same remainder"))

    alerts, _ = contradictions.scan(pairs, known, lib.chunks, judge)
    return alerts


# ── metrics ─────────────────────────────────────────────────────────────────────────────────────

_HITS = (s.PASSAGES, s.QUESTIONS, s.vector_arm(20), s.keyword_arm(20), s.fused(), s.reranked("fused"), s.EXPANDED)


def _answered(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Answers and contexts: the answer of a question is the text of its best chunk, the ground truth
    the passage it comes from."""
    lib = open_sample(spark, folder)
    q = sample.questions(spark, folder)
    near, words = plan.two_arms(lib, plan.with_vectors(normalised(q)), 20)
    from bookloom.operators import ranking

    hits = cut(ranking.rerank(plan.hit_details(lib, ranking.fuse(near, words), q)))
    first = hits.filter("rnk = 1").select("qid", F.col("text").alias("answer"))
    truth = q.select("qid", "item_id").join(sample.table(spark, folder, "benchmark").select("item_id", F.col("text").alias("ground_truth")), "item_id")
    answers = q.select("qid", "question").join(first, "qid", "left").join(truth.select("qid", "ground_truth"), "qid")
    contexts = ranking.expand_to_parents(hits, lib.parents).select("qid", "rnk", "doc_id", "text")
    return answers, contexts


def _judged(column: str, empty: float) -> str:
    bag = lambda x: f"list_distinct({s.word_list(f'lower({x})')})"
    return f"""
ctx AS MATERIALIZED (SELECT qid, {bag("substr(string_agg(text, chr(10) || chr(10) ORDER BY rnk), 1, 6000)")} AS b FROM expanded GROUP BY qid),
ans AS MATERIALIZED (SELECT q.qid, c.text AS answer, b.text AS ground_truth FROM questions q JOIN benchmark b ON b.item_id = q.item_id
  LEFT JOIN reranked r ON r.qid = q.qid AND r.rnk = 1 LEFT JOIN chunks c ON c.chunk_id = r.chunk_id),
cl AS (SELECT qid, {bag('claim')} AS w FROM (SELECT qid, unnest(list_filter({s.sentence_list(s.trim(column))}, lambda z: length(z) > 3)) AS claim FROM ans)),
sc AS (SELECT cl.qid, round(avg(CASE WHEN len(list_intersect(w, coalesce(b, []))) / greatest(len(w), 1) >= 0.6 THEN 1.0 ELSE 0.0 END), 4) AS score FROM cl LEFT JOIN ctx ON ctx.qid = cl.qid GROUP BY cl.qid)"""


_SCORE = "SELECT a.qid, CAST(CASE WHEN coalesce(trim({c}), '') = '' THEN 0.0 ELSE coalesce(score, {e}) END AS DOUBLE) AS score FROM ans a LEFT JOIN sc ON sc.qid = a.qid"


@query(s.with_(*_HITS, _judged("answer", 1.0)) + _SCORE.format(c="answer", e="1.0"))
def faithfulness(spark, folder):
    return ev.faithfulness(*_answered(spark, folder), contains_claim)


@query(s.with_(*_HITS, _judged("ground_truth", 0.0)) + _SCORE.format(c="ground_truth", e="0.0"))
def context_recall(spark, folder):
    return ev.context_recall(*_answered(spark, folder), contains_claim)


@query(s.with_(*_HITS) + """
, v AS (SELECT e.qid, e.rnk, coalesce(l.quality, 0) = 1 AS useful FROM expanded e LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = e.doc_id),
p AS (SELECT *, sum(CAST(useful AS INTEGER)) OVER (PARTITION BY qid ORDER BY rnk) / rnk AS prec FROM v)
SELECT qid, CAST(coalesce(round(avg(prec) FILTER (useful), 4), 0) AS DOUBLE) AS score FROM p GROUP BY qid""")
def context_precision(spark, folder):
    """A context is useful when its document is labelled as good."""
    _, contexts = _answered(spark, folder)
    labels = sample.table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), "quality")
    v = contexts.join(labels, "doc_id", "left").select("qid", "rnk", (F.coalesce("quality", F.lit(0)) == 1).alias("useful"))
    return ev.context_precision(v)


@query(s.with_(s.MESSAGES) + r"""
SELECT message_id AS qid, len(m) AS emitted, len(list_filter(m, lambda n: n BETWEEN 1 AND 5)) AS valid,
  CASE WHEN len(m) > 0 THEN round(len(list_filter(m, lambda n: n BETWEEN 1 AND 5)) / len(m), 4) ELSE 0.0 END AS score
FROM (SELECT message_id, list_distinct(list_transform(regexp_extract_all(content || ' [' || turn || '] [' || (conv_id % 9) || '][x] [1234]', '\[([0-9]{1,3})\]', 1), lambda n: CAST(n AS INTEGER))) AS m
  FROM messages WHERE role = 'assistant')""")
def citation_correctness(spark, folder):
    m = sample.messages(spark, folder).filter("role = 'assistant'")
    a = m.select(F.col("message_id").alias("qid"), F.lit(5).alias("n_sources"),
                 F.concat("content", F.format_string(" [%d] [%d][x] [1234]", F.col("turn"), F.col("conv_id") % 9)).alias("answer"))
    return _long(ev.citation_correctness(a), "emitted", "valid")


@query(s.with_(s.QUESTIONS, f"""
dv AS (SELECT qid, item_id, question, CAST({s.embedding('question')} AS DOUBLE[]) AS v FROM questions)""") + """
SELECT a.qid, round(avg(list_cosine_similarity(a.v, b.v)), 4) AS score FROM dv a JOIN dv b ON a.item_id = b.item_id GROUP BY a.qid""")
def answer_relevancy(spark, folder):
    """The questions derived from an answer are all questions of its passage."""
    q = sample.questions(spark, folder)
    derived = q.select("qid", "item_id").join(q.select("item_id", F.col("question").alias("derived_question")), "item_id").select("qid", "derived_question")
    return ev.answer_relevancy(q.select("qid", "question", F.col("question").alias("answer")), derived, lambda c: hash_embedding(c).cast("array<float>"))


@query()
def eval_matrix(spark, folder):
    lib = open_sample(spark, folder)
    q = sample.questions(spark, folder)
    truth = sample.table(spark, folder, "benchmark").select("item_id", F.col("text").alias("ground_truth"))
    golden = q.join(truth, "item_id").select("qid", "question", "corpus", "ground_truth")
    return evaluate.matrix(lib, golden)


@query()
def reorganization(spark, folder):
    """Detect communities, fingerprint them and write missing summaries."""
    return reorganize.refresh(open_sample(spark, folder).graph)


@query()
def global_answers(spark, folder):
    lib = open_sample(spark, folder)
    communities = reorganize.refresh(lib.graph).filter("summary is not null")
    return overview.global_answers(sample.questions(spark, folder).select("qid", "question"), communities)


@query(s.with_(s.WHOLE) + """
SELECT 'documents' AS part, count(*) AS n, count(DISTINCT content_hash) AS n_distinct FROM docs
UNION ALL SELECT 'passages', count(*), count(DISTINCT text) FROM chunks UNION ALL SELECT 'mentions', count(*), count(DISTINCT canonical) FROM mentions""")
def stream_ingest_counts(spark, folder):
    """The uploads arrive as a stream of files; the stored tables equal those of one batch."""
    from bookloom.session import scratch_path
    from bookloom.streaming import ingest as si

    root = scratch_path(spark, "stream")
    sample.documents(spark, folder).repartitionByRange(4, "seq").sortWithinPartitions("seq").write.parquet(f"{root}/inbox")
    schema = spark.read.parquet(f"{root}/inbox").schema
    inbox = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/inbox")
    si.ingest_stream(inbox, f"{root}/lib").awaitTermination()
    out = None
    for part, key in (("documents", "content_hash"), ("passages", "text"), ("mentions", "canonical")):
        per_key = spark.read.parquet(f"{root}/lib/{part}").groupBy(key).agg(F.count(F.lit(1)).alias("c"))
        one = per_key.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_distinct")).select(F.lit(part).alias("part"), "n", "n_distinct")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def answered_batch(spark, folder):
    """Questions end to end, the user messages of the log serving as cache."""
    from bookloom.plans import ask

    lib = open_sample(spark, folder)
    _, entries = _cache_tables(spark, folder)
    entries = entries.withColumn("answer", F.lit("cached")).withColumn("sources", F.lit("[]")).withColumn("citations", F.lit("[]"))
    q = sample.questions(spark, folder).select("qid", "question", "corpus", F.lit(None).cast("string").alias("conversation_id"))
    none = spark.createDataFrame([], "corpus string, version int")
    out = ask.answer(lib, q, none, entries, F.timestamp_seconds(F.lit(NOW)))
    return out.answers.select("qid", "lane", "cached", "grounded", "tokens_in", "tokens_out", F.round("cost_usd", 8).alias("cost_usd"), F.md5("answer").alias("answer_md5"))
