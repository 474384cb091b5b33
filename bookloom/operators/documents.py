"""Documents to passages: content deduplication, status, chunk and parent tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bookloom import settings as S
from bookloom.functions.chunking import chunk_text, passages
from bookloom.functions.text import strip, word_count
from bookloom.functions.vectors import hash_embedding


def chunk_key(doc_id: Column, index: Column) -> Column:
    """Chunk id derived from its document and position, so a replay produces the same ids."""
    return F.format_string("%s#%06d", doc_id, index)


def first_copies(documents: DataFrame) -> DataFrame:
    """Drop later copies of the same content, whatever corpus they are in.

    The first copy per hash comes from a combining aggregate and only ids are joined back, so a hash
    shared by a third of all documents costs no more than any other. The ids are looked up in a hash
    table, so the texts are not sorted.
    """
    first = documents.groupBy("content_hash").agg(F.min_by("doc_id", "seq").alias("doc_id"))
    return documents.join(first.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")


def new_documents(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """First copies among ``incoming`` whose content is not stored yet."""
    return first_copies(incoming).join(existing.select("content_hash"), "content_hash", "left_anti")


def with_status(documents: DataFrame) -> DataFrame:
    """``extraction_status``: ``empty`` for text without a visible character, else as given or ``ok``."""
    given = F.col("extraction_status") if "extraction_status" in documents.columns else F.lit("ok")
    blank = strip(F.coalesce("text", F.lit(""))) == ""
    return documents.withColumn("extraction_status", F.when(blank, "empty").otherwise(given))


def passage_table(
    documents: DataFrame,
    parent_size: int = S.PARENT_SIZE,
    child_size: int = S.CHILD_SIZE,
    child_overlap: int = S.CHILD_OVERLAP,
    dim: int = S.EMBED_DIM,
    embed=hash_embedding,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Parent-child passages. ``chunk_index`` runs over the document; no shuffle is involved.

    Without ``embed`` the rows have no ``embedding``. ``keep`` names further columns of the document.
    """
    rows = documents.filter(F.col("extraction_status") != "empty").select(
        "doc_id", "seq", "corpus", *keep,
        F.posexplode(passages(F.col("text"), parent_size, child_size, child_overlap)).alias("chunk_index", "p"),
    )
    return rows.select(
        chunk_key(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"),
        "doc_id", "seq", "corpus", *keep, "chunk_index",
        F.format_string("%s/%06d", "doc_id", "p.parent_pos").alias("parent_id"),
        F.col("p.parent_pos").alias("parent_pos"),
        F.col("p.child_pos").alias("child_pos"),
        F.col("p.text").alias("text"),
        word_count(F.col("p.text")).alias("tokens"),
        *([] if embed is None else [embed(F.col("p.text"), dim).cast("array<float>").alias("embedding")]),
        F.col("p.parent_text").alias("parent_text"),
    )


def flat_table(
    documents: DataFrame,
    size: int = S.FLAT_SIZE,
    overlap: int = S.FLAT_OVERLAP,
    dim: int = S.EMBED_DIM,
    embed=hash_embedding,
) -> DataFrame:
    """Flat chunks without parents."""
    rows = documents.filter(F.col("extraction_status") != "empty").select(
        "doc_id", "seq", "corpus",
        F.posexplode(chunk_text(F.col("text"), size, overlap)).alias("chunk_index", "text"),
    )
    return rows.select(
        chunk_key(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"),
        "doc_id", "seq", "corpus", "chunk_index",
        F.lit(None).cast("string").alias("parent_id"),
        "text",
        word_count(F.col("text")).alias("tokens"),
        embed(F.col("text"), dim).cast("array<float>").alias("embedding"),
    )


def chunks_of(passage_rows: DataFrame) -> DataFrame:
    return passage_rows.select(
        "chunk_id", "doc_id", "seq", "corpus", "chunk_index", "parent_id", "text", "tokens", "embedding"
    )


def parents_of(passage_rows: DataFrame) -> DataFrame:
    return passage_rows.filter(F.col("child_pos") == 0).select(
        "parent_id", "doc_id", "seq", "corpus", "parent_pos",
        F.col("parent_text").alias("text"),
        F.col("chunk_index").alias("start_chunk_idx"),
    )
