"""Files as documents: extension allow-list, size guard, text decoding, content identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from bookloom import settings as S
from bookloom.functions.text import file_stem, file_suffix
from bookloom.operators.documents import with_status

# Accepted extensions and the format each stands for.
FORMATS = {
    ".pdf": "pdf", ".md": "md", ".markdown": "md", ".txt": "txt",
    ".png": "image", ".jpg": "image", ".jpeg": "image", ".webp": "image",
}

# Media types of stored files and of images.
FILE_MIME = {
    ".pdf": "application/pdf", ".md": "text/markdown", ".markdown": "text/markdown", ".txt": "text/plain",
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp",
}
IMAGE_MIME = {
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp", ".gif": "image/gif",
}

FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def _lookup(table: dict[str, str], key: Column) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(entries, key)


def infer_format(name: Column) -> Column:
    """``pdf``, ``md``, ``txt`` or ``image``; null for anything else."""
    return _lookup(FORMATS, file_suffix(name))


def file_mime(name: Column) -> Column:
    return F.coalesce(_lookup(FILE_MIME, file_suffix(name)), F.lit("application/octet-stream"))


def image_mime(name: Column) -> Column:
    return F.coalesce(_lookup(IMAGE_MIME, file_suffix(name)), F.lit("image/png"))


def read_files(spark: SparkSession, path: str, max_bytes: int = S.MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` files below a folder.

    The length filter is pushed to the reader, so an oversized file is never loaded.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    typed = files.withColumn("format", infer_format(F.col("path")))
    accepted = typed.filter(F.col("length") <= max_bytes).filter(F.col("format").isNotNull())
    rejected = typed.select("path", "length", "format").filter(
        F.col("format").isNull() | (F.col("length") > max_bytes)
    ).withColumn(
        "reason",
        F.when(F.col("format").isNull(), F.concat(F.lit("Unsupported file type: "), "path")).otherwise(
            F.concat(F.lit("File too large: "), "path")
        ),
    )
    return accepted, rejected


def document_rows(files: DataFrame, corpus: str, job_id: str, pdf_text=None) -> DataFrame:
    """Document rows of accepted files: title = file stem, hash from the bytes, id from bytes and path.

    Text files decode as UTF-8 with replacement. ``pdf_text`` (bytes column to text column) plugs in
    a PDF reader; without one a PDF has no text and is recorded as empty.
    """
    text = F.when(F.col("format").isin("md", "txt"), F.make_valid_utf8(F.col("content").cast("string")))
    if pdf_text is not None:
        text = text.when(F.col("format") == "pdf", pdf_text(F.col("content")))
    digest = F.sha2("content", 256)
    rows = files.select(
        F.substring(F.sha2(F.concat_ws("|", digest, "path"), 256), 1, 32).alias("doc_id"),
        F.xxhash64("path").alias("seq"),
        file_stem(F.col("path")).alias("title"),
        F.lit(corpus).alias("corpus"),
        "format",
        digest.alias("content_hash"),
        F.lit(job_id).alias("job_id"),
        F.col("path").alias("file_path"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.col("modificationTime").alias("ingested_at"),
    )
    return with_status(rows)
