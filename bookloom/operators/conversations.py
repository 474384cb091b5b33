"""Conversations and feedback: history, as-of questions, transcripts, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from bookloom.functions.text import strip


def history(messages: DataFrame, loaded: int = 20, kept: int = 8, chars: int = 4000) -> DataFrame:
    """Turns fed back into a prompt: of the last ``loaded`` messages the last ``kept``, then only
    non-blank user and assistant turns, cut to ``chars``, oldest first.

    The newest rows per conversation are picked by a limited ranking, so long conversations are
    thinned before they are shuffled.
    """
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("message_id"))
    recent = messages.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= min(loaded, kept))
    valid = recent.filter(F.col("role").isin("user", "assistant") & (strip(F.coalesce("content", F.lit(""))) != ""))
    turns = F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "role", F.substring("content", 1, chars).alias("content"))))
    return valid.groupBy("conversation_id").agg(
        F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("turns")
    )


def prior_questions(messages: DataFrame, slice_seconds: int = 6 * 3600) -> DataFrame:
    """The user question each message belongs to: its own for user messages, else the latest user
    message of the conversation at or before it (ties by id): ``message_id, question_id, question``.

    Time is cut into slices. Inside a slice the answer is a running maximum; before it, only the last
    user message of each earlier slice matters. A conversation with a third of all messages is thus
    spread over its slices, and what crosses slices is one row each.
    """
    user_at = F.when(F.col("role") == "user", F.struct("created_at", "message_id", "content"))
    rows = messages.select(
        "message_id", "conversation_id", "role", "content", "created_at",
        F.floor(F.unix_timestamp("created_at") / slice_seconds).alias("slice"),
        user_at.alias("u"),
    )
    running = (
        Window.partitionBy("conversation_id", "slice").orderBy("created_at")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = rows.withColumn("near", F.max("u").over(running)).drop("u")
    last_of_slice = rows.groupBy("conversation_id", "slice").agg(F.max("u").alias("last"))
    earlier = Window.partitionBy("conversation_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last_of_slice.withColumn("far", F.max("last").over(earlier)).drop("last")
    found = F.coalesce("near", "far")
    return inside.join(carried, ["conversation_id", "slice"]).select(
        "message_id", "conversation_id",
        F.when(F.col("role") == "user", F.col("message_id")).otherwise(found["message_id"]).alias("question_id"),
        F.when(F.col("role") == "user", F.col("content")).otherwise(found["content"]).alias("question"),
    )


def exchange_rows(answered: DataFrame, now) -> DataFrame:
    """One user and one assistant message per answered question."""
    none = F.lit(None)
    user = F.struct(
        F.lit(0).alias("turn"), F.lit("user").alias("role"), F.col("question").alias("content"),
        none.cast("string").alias("sources"), none.cast("string").alias("citations"), none.cast("string").alias("usage"),
        none.cast("string").alias("error"), F.lit(False).alias("cached"),
    )
    reply = F.struct(
        F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.coalesce("answer", F.lit("")).alias("content"),
        "sources", "citations", "usage", "error", "cached",
    )
    return answered.select("conversation_id", "qid", F.explode(F.array(user, reply)).alias("m")).select(
        F.format_string("%s/%d", "qid", "m.turn").alias("message_id"), "conversation_id", "m.role", "m.content",
        "m.sources", "m.citations", "m.usage", "m.error", "m.cached", now.alias("created_at"),
    )


def message_counts(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    counts = messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("message_count"))
    return conversations.join(counts, "conversation_id", "left").withColumn(
        "message_count", F.coalesce("message_count", F.lit(0))
    )


def transcripts(messages: DataFrame) -> DataFrame:
    """All messages in conversation order; the order is the sort key, nothing is gathered."""
    return messages.orderBy("conversation_id", "created_at", "message_id")


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """One row per message, the latest rating and note win."""
    return feedback.groupBy("message_id").agg(
        F.max_by(F.struct("rating", "note", "created_at"), "created_at").alias("f")
    ).select("message_id", "f.rating", "f.note", "f.created_at")


def feedback_log(feedback: DataFrame, messages: DataFrame, conversations: DataFrame, limit: int = 50) -> DataFrame:
    """Newest feedback with the rated text and its corpus."""
    m = messages.select("message_id", "conversation_id", "role", "content")
    return (
        feedback.join(m, "message_id")
        .join(conversations.select("conversation_id", F.col("vault_name").alias("corpus")), "conversation_id")
        .select(
            "message_id", "rating", "note", "corpus", "created_at",
            F.when(F.col("role") == "user", F.col("content")).alias("question"),
            F.when(F.col("role") == "assistant", F.col("content")).otherwise(F.lit("")).alias("answer"),
        )
        .orderBy(F.desc("created_at"), "message_id")
        .limit(limit)
    )


def feedback_totals(feedback: DataFrame) -> DataFrame:
    return feedback.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("rating") == 1).alias("up"),
        F.count_if(F.col("rating") == -1).alias("down"),
    )
