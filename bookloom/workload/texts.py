"""Text queries: copies, passages, sentences, phrases, question routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookloom.functions import entities as ent
from bookloom.functions import questions as qs
from bookloom.functions import text as tx
from bookloom.operators import documents as docs
from bookloom.sources import files, sample
from bookloom.sources.library import open_sample
from bookloom.workload import query
from bookloom.workload import sql as s


@query(s.with_(s.UPLOADED) + """
SELECT doc_id, corpus FROM uploaded QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY seq) = 1""")
def content_dedup(spark, folder):
    return docs.first_copies(sample.documents(spark, folder)).select("doc_id", "corpus")


@query(s.with_(s.PASSAGES) + """
SELECT printf('%s/%06d', doc_id, pp) AS parent_id, doc_id, md5(ptext) AS text_md5, length(ptext) AS n_chars,
  (SELECT min(c.chunk_index) FROM chunks c WHERE c.doc_id = par.doc_id AND c.pp = par.pp) AS start_chunk_idx FROM par""")
def chunk_parents(spark, folder):
    p = open_sample(spark, folder).parents
    return p.select("parent_id", "doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"), F.col("start_chunk_idx").cast("long").alias("start_chunk_idx"))


@query(s.with_(s.PASSAGES) + f"""
SELECT chunk_id, doc_id, chunk_index, parent_id, md5(text) AS text_md5, CAST(len({s.word_list('text')}) AS BIGINT) AS tokens FROM chunks""")
def chunk_children(spark, folder):
    c = open_sample(spark, folder).chunks
    return c.select("chunk_id", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "parent_id", F.md5("text").alias("text_md5"), F.col("tokens").cast("long").alias("tokens"))


@query(s.with_(s.DOCS, s.chunk_list("docs", "doc_id", "text", 700, 100, "kid")) + """
SELECT doc_id, generate_subscripts(kids, 1) - 1 AS chunk_index, md5(unnest(kids)) AS text_md5 FROM kid""")
def flat_chunks(spark, folder):
    c = docs.flat_table(open_sample(spark, folder).documents)
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("text").alias("text_md5"))


@query(s.with_(s.UPLOADED) + f"""
SELECT doc_id, CAST({s.token_estimate('text')} AS BIGINT) AS token_estimate, CAST(len({s.word_list('text')}) AS BIGINT) AS word_count,
  CASE WHEN {s.trim('text')} = '' THEN 'empty' ELSE 'ok' END AS extraction_status FROM uploaded""")
def token_counts(spark, folder):
    d = docs.with_status(sample.documents(spark, folder))
    return d.select("doc_id", tx.token_estimate(F.col("text")).cast("long").alias("token_estimate"), tx.word_count(F.col("text")).cast("long").alias("word_count"), "extraction_status")


@query(s.with_(s.UPLOADED) + f"""
SELECT doc_id, i, md5(sentence) AS sentence_md5, length(sentence) > 3 AS is_claim FROM (SELECT doc_id, unnest(l) AS sentence,
  generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, {s.sentence_list('text')} AS l FROM uploaded))""")
def sentence_split(spark, folder):
    d = sample.documents(spark, folder).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("i", "sentence"))
    return d.select("doc_id", F.col("i").cast("long").alias("i"), F.md5("sentence").alias("sentence_md5"), (F.length("sentence") > 3).alias("is_claim"))


@query(s.with_(s.UPLOADED) + f"""
SELECT name, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({s.phrase_list('text')}) AS name FROM uploaded) GROUP BY name""")
def entity_phrases(spark, folder):
    d = sample.documents(spark, folder).select("doc_id", F.explode(ent.phrases(F.col("text"))).alias("name"))
    per_doc = d.groupBy("name", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("name").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query(s.with_(s.UPLOADED) + """
, w AS (SELECT doc_id, length(text) AS n, text, unnest(CASE WHEN length(text) <= 8000 THEN [0] ELSE
  [least(i * greatest((length(text) - 8000) // 2, 1), length(text) - 8000) FOR i IN [0, 1, 2]] END) AS start FROM uploaded)
SELECT doc_id, start, md5(substr(text, start + 1, 8000)) AS window_md5 FROM w""".replace("\n, w", ",\nw"))
def text_windows(spark, folder):
    d = sample.documents(spark, folder)
    n = F.length("text")
    step = F.greatest(F.floor((n - 8000) / 2), F.lit(1))
    w = d.select("doc_id", n.alias("n"), step.alias("step"), F.posexplode(ent.text_windows(F.col("text"), 3)).alias("i", "w"))
    start = F.when(F.col("n") <= 8000, F.lit(0)).otherwise(F.least(F.col("i") * F.col("step"), F.col("n") - 8000))
    return w.select("doc_id", start.cast("long").alias("start"), F.md5("w").alias("window_md5"))


@query(s.with_(s.UPLOADED, f"""
f AS (SELECT doc_id, doc_id || ['.pdf', '.MD', '.txt', '.jpeg', '.docx', ''][seq % 6 + 1] AS file_name FROM uploaded)""") + """
SELECT doc_id, CASE seq6 WHEN '.pdf' THEN 'pdf' WHEN '.md' THEN 'md' WHEN '.txt' THEN 'txt' WHEN '.jpeg' THEN 'image' END AS format,
  CASE seq6 WHEN '.pdf' THEN 'application/pdf' WHEN '.md' THEN 'text/markdown' WHEN '.txt' THEN 'text/plain' WHEN '.jpeg' THEN 'image/jpeg'
    ELSE 'application/octet-stream' END AS mime, CASE seq6 WHEN '.jpeg' THEN 'image/jpeg' ELSE 'image/png' END AS image_mime, doc_id AS stem
FROM (SELECT doc_id, lower(regexp_extract(file_name, '\\.[^.]+$')) AS seq6 FROM f)""")
def file_formats(spark, folder):
    ends = F.array(*[F.lit(x) for x in (".pdf", ".MD", ".txt", ".jpeg", ".docx", "")])
    d = sample.documents(spark, folder).select("doc_id", F.concat("doc_id", F.get(ends, (F.col("seq") % 6).cast("int"))).alias("name"))
    return d.select("doc_id", files.infer_format(F.col("name")).alias("format"), files.file_mime(F.col("name")).alias("mime"), files.image_mime(F.col("name")).alias("image_mime"), tx.file_stem(F.col("name")).alias("stem"))


def _any(pattern: str) -> str:
    return rf"regexp_matches(t, '(?i)(^|[^\p{{L}}\p{{N}}_])({pattern.replace(chr(39), chr(39) * 2)})([^\p{{L}}\p{{N}}_]|$)')"


_LANE = "CASE WHEN length(t) <= 2 THEN 'fast' WHEN NOT contains(t, ' ') AND length(t) <= 12 THEN 'fast' "
_LANE += "WHEN lower(trim(rtrim(t, '!?.,;'))) IN (" + ", ".join(s.q(g) for g in qs.GREETINGS) + ") THEN 'fast' "
_LANE += f"WHEN {_any(qs.NO_RETRIEVAL)} THEN 'fast' "
_LANE += "".join(f"WHEN {_any(p)} THEN 'deep' " for p in qs.MANY_SOURCES) + "ELSE 'standard' END"


@query(s.with_(s.MESSAGES, f"""
m AS (SELECT message_id, {s.trim(f"regexp_replace(translate(content, '‘’“”', ''''''''''), '{s.WS}+', ' ', 'g')")} AS t, content, turn FROM messages)""") + f"""
SELECT message_id, {_LANE} AS lane, CASE WHEN turn % 10 = 9 THEN 'standard' WHEN turn % 10 = 7 THEN 'deep' ELSE {_LANE} END AS lane_given,
  {_any(qs.WHOLE_LIBRARY)} AS global_intent, substr(content, 1, 80) AS title FROM m""")
def lane_router(spark, folder):
    m = sample.messages(spark, folder)
    mode = F.when(F.col("turn") % 10 == 7, "deep").when(F.col("turn") % 10 == 8, "other")
    return m.select(
        "message_id", qs.lane(F.col("content")).alias("lane"),
        qs.lane(F.col("content"), F.col("turn") % 10 == 9, mode).alias("lane_given"),
        qs.asks_whole_library(F.col("content")).alias("global_intent"), tx.title_default(F.col("content")).alias("title"),
    )


@query(s.with_(s.QUESTIONS) + """,
y AS (SELECT qid, question || ' in ' || (1750 + item_id * 7) || ', please' AS t FROM questions)
SELECT qid, CASE WHEN y <> '' THEN y || '-01-01' END AS date_from, CASE WHEN y <> '' THEN y || '-12-31' END AS date_to
FROM (SELECT qid, regexp_extract(t, '(?:^|[^\\p{L}\\p{N}_])(1[89][0-9]{2}|20[0-9]{2})(?:[^\\p{L}\\p{N}_]|$)', 1) AS y FROM y)""")
def question_years(spark, folder):
    q = sample.questions(spark, folder)
    hint = qs.year_range(F.concat("question", F.lit(" in "), (F.lit(1750) + F.col("item_id") * 7).cast("string"), F.lit(", please")))
    return q.select("qid", hint["date_from"].alias("date_from"), hint["date_to"].alias("date_to"))


_TOK = "regexp_extract_all(lower({x}), '[a-z0-9'']+')"
_CAP = (
    r"list_sort(list_distinct(list_filter(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '^[A-Z][a-z]+$'))))"
)


# Whether two questions, as token lists a, b and name lists ca, cb, must not share an answer.
DIFFERENT = """CASE WHEN len(a) = 0 OR len(b) = 0 THEN true
  WHEN CAST(len(list_intersect(list_distinct(a), list_distinct(b))) AS DOUBLE) / len(list_distinct(list_concat(a, b))) < 0.8 THEN true
  WHEN CAST(greatest(len(a), len(b)) AS DOUBLE) / greatest(least(len(a), len(b)), 1) > 1.5 THEN true
  WHEN len(ca) > 0 AND len(cb) > 0 AND ca <> cb THEN true ELSE false END"""


@query(s.with_(s.QUESTIONS, f"""
pairs AS (SELECT a.qid, b.question AS stored, a.question AS asked, 'next' AS kind FROM questions a JOIN questions b
    ON b.item_id = a.item_id + 1 AND right(b.qid, 3) = right(a.qid, 3)
  UNION ALL SELECT qid, question, question || ' ?', 'same' FROM questions
  UNION ALL SELECT qid, question, question || ' Bombay', 'named' FROM questions),
tok AS (SELECT *, {_TOK.format(x='stored')} AS a, {_TOK.format(x='asked')} AS b, {_CAP.format(x='stored')} AS ca, {_CAP.format(x='asked')} AS cb FROM pairs)""") + """
SELECT qid, kind, """ + DIFFERENT + " AS different FROM tok")
def dup_question_guard(spark, folder):
    q = sample.questions(spark, folder)
    n = F.right("qid", F.lit(3))
    a = q.select("qid", F.col("question").alias("asked"), (F.col("item_id") + 1).alias("item"), n.alias("n"))
    b = q.select(F.col("question").alias("stored"), F.col("item_id").alias("item"), n.alias("n"))
    pairs = (
        a.join(b, ["item", "n"]).select("qid", "stored", "asked", F.lit("next").alias("kind"))
        .unionByName(q.select("qid", F.col("question").alias("stored"), F.concat("question", F.lit(" ?")).alias("asked"), F.lit("same").alias("kind")))
        .unionByName(q.select("qid", F.col("question").alias("stored"), F.concat("question", F.lit(" Bombay")).alias("asked"), F.lit("named").alias("kind")))
    )
    return pairs.select("qid", "kind", qs.too_different(F.col("stored"), F.col("asked")).alias("different"))
