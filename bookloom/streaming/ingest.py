"""Streaming ingest and feedback: micro-batches into stored tables, safe to replay.

Every batch writes under its own id, so a batch that runs twice (executor or driver loss) replaces
what it wrote the first time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bookloom.operators import cache, catalog as ct, conversations as cv, documents as docs, graph_build as gb
from bookloom.functions.vectors import hash_embedding
from bookloom.sources.files import FILE_SCHEMA
from bookloom.sources.tables import append_batch, read_batches

DOCUMENT_SCHEMA = "doc_id string, seq long, title string, corpus string, content_hash string, text string, extraction_status string"
CHUNK_SCHEMA = (
    "chunk_id string, doc_id string, seq long, corpus string, chunk_index int, parent_id string, text string, tokens int, embedding array<float>"
)
PARENT_SCHEMA = "parent_id string, doc_id string, seq long, corpus string, parent_pos int, text string, start_chunk_idx int"
MENTION_SCHEMA = "chunk_id string, doc_id string, corpus string, chunk_index int, canonical string"
VERSION_SCHEMA = "corpus string, step int"


def file_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """New files of a folder as they arrive."""
    return (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(folder)
    )


def ingest_batch(rows: DataFrame, batch_id: int, root: str) -> None:
    """One micro-batch of document rows: drop known content, chunk, extract mentions, bump versions.

    Earlier batches are read without this batch's own folder, so a replay sees what the first run saw.
    """
    spark = rows.sparkSession
    stored = read_batches(spark, f"{root}/documents", DOCUMENT_SCHEMA + ", batch_id long").filter(F.col("batch_id") < batch_id)
    cols = [c.split()[0] for c in DOCUMENT_SCHEMA.split(", ")]
    fresh = docs.with_status(docs.new_documents(rows, stored)).select(*cols)
    append_batch(fresh, f"{root}/documents", batch_id)
    kept = spark.read.schema(DOCUMENT_SCHEMA).parquet(f"{root}/documents/batch_id={batch_id}")
    append_batch(docs.passage_table(kept), f"{root}/passages", batch_id)
    passages = spark.read.parquet(f"{root}/passages/batch_id={batch_id}")
    entities = gb.merge_extracts(gb.local_extracts(docs.parents_of(passages)))
    append_batch(entities, f"{root}/doc_entities", batch_id)
    named = spark.read.parquet(f"{root}/doc_entities/batch_id={batch_id}")
    append_batch(gb.mention_edges(gb.chunk_entities(docs.chunks_of(passages), named)), f"{root}/mentions", batch_id)
    append_batch(kept.select("corpus").distinct().withColumn("step", F.lit(1)), f"{root}/versions", batch_id)


def ingest_stream(documents: DataFrame, root: str, after_batch=None):
    """Run a document stream into the tables below ``root`` until its input is used up.

    ``documents`` has the columns of a document row. ``after_batch(spark, root, batch_id)`` hooks in
    a debounced reorganisation.
    """

    def step(rows: DataFrame, batch_id: int) -> None:
        ingest_batch(rows, batch_id, root)
        if after_batch is not None:
            after_batch(rows.sparkSession, root, batch_id)

    return (
        documents.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{root}/_progress")
        .trigger(availableNow=True)
        .start()
    )


def versions(spark: SparkSession, root: str) -> DataFrame:
    """Corpus versions: one step per batch that added documents to the corpus, however often it ran."""
    return read_batches(spark, f"{root}/versions", VERSION_SCHEMA).groupBy("corpus").agg(F.sum("step").cast("int").alias("version"))


def evict_batch(ratings: DataFrame, entries: DataFrame, messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Cache entries left after the thumbs-down ratings of one micro-batch."""
    down = cv.latest_feedback(ratings).filter("rating < 0").select("message_id")
    vault = conversations.select("conversation_id", F.col("vault_name").alias("corpus"))
    asked = cv.prior_questions(messages).join(down, "message_id", "left_semi").filter("question is not null").join(vault, "conversation_id", "left")
    disliked = asked.groupBy("question_id", "corpus").agg(F.first("question").alias("question")).select(
        F.col("question_id").alias("qid"), "corpus", hash_embedding(F.col("question")).cast("array<float>").alias("vector"))
    return cache.evict(entries, disliked)


def feedback_stream(ratings: DataFrame, read_entries, write_entries, messages: DataFrame, conversations: DataFrame, progress: str):
    """Apply a stream of ratings to a cache table.

    ``read_entries(batch_id)`` gives the entries before the batch, ``write_entries(df, batch_id)``
    stores them after it.
    """

    def step(rows: DataFrame, batch_id: int) -> None:
        write_entries(evict_batch(rows, read_entries(batch_id), messages, conversations), batch_id)

    return ratings.writeStream.foreachBatch(step).option("checkpointLocation", progress).trigger(availableNow=True).start()


def due_after_batch(documents: DataFrame, jobs: DataFrame, runs: DataFrame, policy: str, now, min_docs: int = 3) -> DataFrame:
    """Whether a reorganisation is due after a batch: one row, one boolean column ``due``."""
    state = ct.documents_since(documents, jobs, runs)
    return state.select(ct.should_run(F.lit(policy), F.col("docs_since"), F.col("last_run"), now, min_docs).alias("due"))
