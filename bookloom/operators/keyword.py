"""Keyword search: an inverted index and conjunctive BM25 ranking.

All terms of a question must occur. Candidates therefore come from its rarest term only, and the
other terms are checked inside the candidate's own row, so a term found in a third of all chunks
never multiplies rows unless it is the only term asked for. Few questions (their terms are counted
first) travel to the tasks that read the chunks, where both steps happen and nothing is shuffled.

The conditions of that join have generated code, so a chunk's terms are copied for rows that meet
them only, not for every term of the chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bookloom import settings as S
from bookloom.operators.scope import in_scope
from bookloom.session import stored

SCAN_TERMS = 500_000  # terms of all questions up to which they are sent to every task

# English words that carry no meaning for search.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up",
    "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor",
    "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should",
    "now",
]

SCOPE = ("corpus", "tags", "doc_date", "author")

TERM = r"[\p{L}\p{N}']+"


def terms(text: Column) -> Column:
    """Lower-cased terms in text order, stop words removed."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


def term_rows(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, doc_id, dl, ts array<term>)`` per chunk, terms in text order with repeats.

    Filter columns of the document that the chunks carry stay with them.
    """
    scope = [c for c in SCOPE if c in chunks.columns]
    return chunks.select("chunk_id", "doc_id", *scope, terms(F.col("text")).alias("ts")).select(
        "chunk_id", "doc_id", *scope, F.size("ts").alias("dl"), "ts"
    )


def postings(rows: DataFrame) -> DataFrame:
    """The inverted index ``(term, chunk_id)``."""
    return rows.select(F.explode(F.array_distinct("ts")).alias("term"), "chunk_id")


def document_frequency(posting_rows: DataFrame) -> DataFrame:
    return posting_rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def collection_stats(rows: DataFrame) -> tuple[int, float]:
    """Number of chunks and their mean length in terms: two numbers, whatever the collection size."""
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("m")).first()
    return one["n"], float(one["m"] or 1.0)


def keyword_search(
    queries: DataFrame,
    documents: DataFrame,
    rows: DataFrame,
    posting_rows: DataFrame,
    frequencies: DataFrame,
    stats: tuple[int, float],
    k: int = 10,
) -> DataFrame:
    """Top ``k`` chunks per question holding all its terms: ``(qid, chunk_id, score, rnk)``.

    ``queries`` carries normalised filters and ``question``; ``frequencies(term, df)`` comes from
    :func:`document_frequency`; ``stats`` is (chunks, mean length). ``documents`` are joined only if
    ``rows`` lack their filter columns.
    A question without terms finds nothing.
    """
    n_chunks, avg_dl = stats
    asked = queries.select("qid", F.explode(F.array_distinct(terms(F.col("question")))).alias("term"))
    weighed = asked.join(frequencies, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    filters = queries.select("qid", "corpus", "tags", "date_from", "date_to", "author")
    per_question = stored(
        weighed.groupBy("qid")
        .agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("wanted"))
        .filter(F.col("wanted")[0]["df"] > 0)
        .withColumn("term", F.col("wanted")[0]["term"])
        .withColumn("needed", F.transform("wanted", lambda w: w["term"]))
        .join(filters, "qid"),
        "asked-terms",
    )
    asked_terms = per_question.agg(F.sum(F.size("wanted"))).first()[0] or 0
    if asked_terms <= SCAN_TERMS:
        chunks = rows.select("*", F.explode(F.array_distinct("ts")).alias("term")).alias("d")
        candidates = chunks.join(F.broadcast(per_question).alias("q"), F.col("d.term") == F.col("q.term"))
    else:
        met = per_question.join(posting_rows, "term").alias("q")
        candidates = met.join(rows.alias("d"), F.col("q.chunk_id") == F.col("d.chunk_id"))
    holds = F.size(F.array_except("q.needed", "d.ts")) == 0
    if set(SCOPE) <= set(rows.columns):
        held = candidates.filter(in_scope("q", "d")).filter(holds)
    else:
        meta = documents.select("doc_id", *SCOPE).alias("m")
        held = candidates.filter(holds).join(meta, F.col("d.doc_id") == F.col("m.doc_id")).filter(in_scope("q", "m"))
    scoped = held.select("q.qid", "d.chunk_id", "d.dl", "d.ts", "q.wanted")

    def weight(w: Column) -> Column:
        idf = F.log1p((F.lit(n_chunks) - w["df"] + 0.5) / (w["df"] + 0.5))
        tf = (F.size("ts") - F.size(F.array_remove("ts", w["term"]))).cast("double")
        norm = S.BM25_K1 * (1 - S.BM25_B + S.BM25_B * F.col("dl") / F.lit(avg_dl))
        return idf * tf * (S.BM25_K1 + 1) / (tf + norm)

    scored = scoped.select(
        "qid", "chunk_id",
        F.round(F.aggregate(F.transform("wanted", weight), F.lit(0.0), lambda a, x: a + x), 9).alias("score"),
    )
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rnk", F.row_number().over(order)).filter(F.col("rnk") <= k)
