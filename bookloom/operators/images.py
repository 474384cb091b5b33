"""Images of a library: from the bytes of a file to media type, vector, caption, tags and graph edges.

Models are plug points over Arrow batches: ``embed(content, dim)`` is a column, ``describe(files)`` adds ``reply`` (what a vision
model wrote) and ``error``. Without models the vector is a hash of the bytes and there is no caption. A description that fails
leaves an image without caption; a file without bytes is no image, and only the quarantine lists it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from bookloom import settings as S
from bookloom.functions.entities import canonical, caption_entities, display
from bookloom.functions.questions import image_description
from bookloom.functions.vectors import hash_embedding
from bookloom.operators.models import model_map
from bookloom.sources.files import image_mime

IMAGE_COLUMNS = ("image_id", "doc_id", "corpus", "path", "mime", "caption", "tags", "vector", "error")


def not_described(files: DataFrame) -> DataFrame:
    """Default: no vision model, no caption."""
    return files.withColumns({"reply": F.lit(""), "error": F.lit(None).cast("string")})


def reply_in_file(files: DataFrame) -> DataFrame:
    """The bytes of the file as the reply itself, invalid UTF-8 replaced; for test data and side-car files."""
    return files.withColumns({"reply": F.make_valid_utf8(F.col("content").cast("string")), "error": F.lit(None).cast("string")})


def vision_model(call: Callable, load: Callable[[], object] | None = None, tasks: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """A user model as ``describe``: ``call(row)`` or ``call(row, model)`` returns the reply for ``row["content"], row["mime"]``."""

    def describe(files: DataFrame) -> DataFrame:
        if load:
            return model_map(files, "reply string", lambda row, model: {"reply": call(row, model)}, load, tasks)
        return model_map(files, "reply string", lambda row: {"reply": call(row)}, None, tasks)

    return describe


def image_files(files: DataFrame, documents: DataFrame) -> DataFrame:
    """``image_id, doc_id, corpus, path, content`` of uploaded image files: an image is named after its document."""
    rows = documents.filter("format = 'image'").select("doc_id", "corpus", F.col("file_path").alias("path"))
    return files.filter("format = 'image'").select("path", "content").join(rows, "path").select(
        F.col("doc_id").alias("image_id"), "doc_id", "corpus", "path", "content",
    )


def quarantined(files: DataFrame) -> DataFrame:
    """``doc_id, path, error`` of files that are no images."""
    return files.filter(F.coalesce(F.octet_length("content"), F.lit(0)) == 0).select("doc_id", "path", F.concat(F.lit("Empty file: "), F.coalesce("path", F.lit(""))).alias("error"))


def image_table(files: DataFrame, describe: Callable[[DataFrame], DataFrame] = not_described, embed=hash_embedding, dim: int = S.EMBED_DIM) -> DataFrame:
    """One row per image of ``files (image_id, doc_id, corpus, path, content)``; no shuffle."""
    good = files.filter(F.octet_length("content") > 0).select("image_id", "doc_id", "corpus", "path", image_mime(F.col("path")).alias("mime"), "content")
    described = describe(good).withColumn("said", image_description(F.coalesce("reply", F.lit(""))))
    return described.select(
        "image_id", "doc_id", "corpus", "path", "mime", F.col("said.caption").alias("caption"), F.col("said.tags").alias("tags"),
        embed(F.col("content"), dim).cast("array<float>").alias("vector"), "error",
    )


def depicts(images: DataFrame) -> DataFrame:
    """``DEPICTS`` edges from captions: ``(image_id, canonical, name)``."""
    return (
        images.select("image_id", F.explode(caption_entities(F.col("caption"))).alias("word"))
        .select("image_id", canonical(F.col("word")).alias("canonical"), display(F.col("word")).alias("name"))
        .groupBy("image_id", "canonical")
        .agg(F.min("name").alias("name"))
    )


def with_depicted(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities plus those that only captions name."""
    shown = edges.groupBy("canonical").agg(F.min("name").alias("name"))
    new = shown.join(entities.select("canonical"), "canonical", "left_anti").withColumn("type", F.lit("Concept"))
    return entities.select("canonical", "name", "type").unionByName(new)
