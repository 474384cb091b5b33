"""The model tables derived from the given parquet tables (deterministic, whole tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bookloom.functions.text import sentences


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Uploaded documents, copies included."""
    d = table(spark, folder, "documents")
    n = F.col("doc_id")
    return d.select(
        n.cast("string").alias("doc_id"),
        n.alias("seq"),
        F.concat(F.lit("doc-"), n.cast("string")).alias("title"),
        F.col("source").alias("corpus"),
        F.lit("txt").alias("format"),
        F.sha2("text", 256).alias("content_hash"),
        F.concat(F.lit("job-"), F.col("source")).alias("job_id"),
        F.array("lang", F.concat(F.lit("t"), (n % 5).cast("string"))).alias("tags"),
        F.concat(F.lit("Author "), (n % 7).cast("string")).alias("author"),
        F.timestamp_seconds(F.lit(1577836800) + (n % 1460) * 86400).alias("doc_date"),
        F.timestamp_seconds(F.lit(1704067200) + n * 60).alias("ingested_at"),
        "text",
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """One question per sentence of the benchmark passages; every second passage asks one corpus."""
    b = table(spark, folder, "benchmark").select("item_id", F.posexplode(sentences(F.col("text"))).alias("n", "question"))
    item = F.col("item_id")
    return b.select(
        F.format_string("%s-%03d", item.cast("string"), F.col("n")).alias("qid"),
        "item_id",
        "question",
        F.when(item % 2 == 1, F.concat(F.lit("src"), (item % 20).cast("string"))).alias("corpus"),
    )


def filtered_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions with tag, date and author filters on top of the corpus."""
    item = F.col("item_id")
    return questions(spark, folder).select(
        "*",
        F.when(item % 3 == 0, F.array(F.lit("en"), F.lit(" "))).when(item % 3 == 1, F.array(F.concat(F.lit("t"), (item % 5).cast("string")))).alias("tags"),
        F.when(item % 4 == 0, F.lit("2020-06-01")).when(item % 4 == 1, F.lit("June 2020")).alias("date_from"),
        F.when(item % 4 == 0, F.lit("2022-06-30")).alias("date_to"),
        F.when(item % 5 == 0, F.concat(F.lit("AUTHOR "), (item % 7).cast("string"))).alias("author"),
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations")
    return c.select(
        F.format_string("%s-%06d", F.col("conv_id").cast("string"), "turn").alias("message_id"),
        F.col("conv_id").cast("string").alias("conversation_id"),
        "role",
        F.col("text").alias("content"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.floor(F.col("turn") / 2) * 60).alias("created_at"),
        "conv_id", "turn",
    )


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """One row per conversation; its vault follows from the id, its title from the first user turn."""
    c = table(spark, folder, "conversations")
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    return c.groupBy("conv_id").agg(first.alias("first"), F.max("turn").alias("last")).select(
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("vault_name"),
        F.col("first").alias("first_question"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.floor(F.col("last") / 2) * 60).alias("updated_at"),
    )


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Two feedback rows per assistant message, the later one counts."""
    m = messages(spark, folder).filter("role = 'assistant'")
    twice = m.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"))
    return twice.select(
        "message_id",
        F.when((F.col("conv_id") + F.col("turn") + F.col("again")) % 3 == 0, -1).otherwise(1).alias("rating"),
        F.concat(F.lit("note "), F.col("again").cast("string")).alias("note"),
        (F.col("created_at") + F.make_dt_interval(mins=F.lit(5) + F.col("again"))).alias("created_at"),
    )


def image_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """One image per embedding row, with that row as its vector: ``image_id, label, vector``."""
    e = table(spark, folder, "embeddings")
    d = table(spark, folder, "documents").select("doc_id")
    return e.join(d, e.vec_id == d.doc_id).select(F.format_string("img%06d", "vec_id").alias("image_id"), "label", F.col("embedding").alias("vector"))


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """One image file per embedding row, attached to the document of the same number.

    Its bytes are what a vision model would reply for it: the first line of that document, as plain text or, for two of three,
    as JSON with tags. Every seventeenth file is empty. Of a document only its first line meets the files.
    """
    e = table(spark, folder, "embeddings").select("vec_id")
    first = F.coalesce(F.substring_index("text", "\n", 1), F.lit(""))
    d = table(spark, folder, "documents").select("doc_id", "source", "lang", first.alias("line"))
    n, line = F.col("vec_id"), F.col("line")
    bare = F.regexp_replace(line, r'["\\\x00-\x1f]', "")
    tags = F.concat(F.coalesce("lang", F.lit("")), F.lit('", "t'), (n % 5).cast("string"))
    reply = F.when(n % 17 == 0, "").when(n % 3 == 0, line).otherwise(F.concat(F.lit('{"caption": "'), bare, F.lit('", "tags": ["'), tags, F.lit('"]}')))
    ending = F.element_at(F.array(*[F.lit(x) for x in ("png", "jpg", "JPEG", "webp", "gif")]), (n % 5 + 1).cast("int"))
    return e.join(d, e.vec_id == d.doc_id).select(
        F.format_string("img%06d", "vec_id").alias("image_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("corpus"),
        F.format_string("/library/%s/%d.%s", "source", "vec_id", ending).alias("path"), reply.cast("binary").alias("content"),
    )
