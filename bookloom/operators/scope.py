"""Document filters a question can carry: corpus, tags, date range, author."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bookloom.functions.text import strip


def day(value: Column) -> Column:
    """Midnight UTC of a value whose first ten characters look like ``YYYY-MM-DD``; else null."""
    head = F.substring(strip(value), 1, 10)
    return F.when(head.rlike("^.{4}-.{2}-.{2}$"), F.try_to_timestamp(head, F.lit("yyyy-MM-dd")))


def real_tags(tags: Column) -> Column:
    return F.filter(tags, lambda t: t.isNotNull() & (strip(t) != ""))


def normalised(queries: DataFrame) -> DataFrame:
    """Filter columns as the operators expect them; absent ones are added as null."""
    have = set(queries.columns)
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    tags = F.col("tags") if "tags" in have else F.lit(None).cast("array<string>")
    author = strip(text("author"))
    return queries.withColumns(
        {
            "corpus": text("corpus"),
            "tags": F.when(F.size(real_tags(tags)) > 0, real_tags(tags)),
            "date_from": day(text("date_from").cast("string")),
            "date_to": day(text("date_to").cast("string")),
            "author": F.when(author != "", author),
        }
    )


def in_scope(q: str, d: str) -> Column:
    """Join condition between normalised questions ``q`` and documents ``d`` (alias names)."""
    qc, dc = (lambda n: F.col(f"{q}.{n}")), (lambda n: F.col(f"{d}.{n}"))
    return (
        (qc("corpus").isNull() | (dc("corpus") == qc("corpus")))
        & (qc("tags").isNull() | F.arrays_overlap(dc("tags"), qc("tags")))
        & (qc("date_from").isNull() | (dc("doc_date") >= qc("date_from")))
        & (qc("date_to").isNull() | (dc("doc_date") <= qc("date_to")))
        & (qc("author").isNull() | F.contains(F.lower(dc("author")), F.lower(qc("author"))))
    )


def drop_unknown_tags(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """Remove a tag filter that no document of the question's corpus carries.

    A question without corpus is looked up in ``default``, so its tags usually go.
    """
    asked = queries.select("qid", F.coalesce("corpus", F.lit("default")).alias("corpus"), F.explode("tags").alias("tag"))
    carried = documents.select("corpus", F.explode("tags").alias("tag")).distinct()
    known = asked.join(carried, ["corpus", "tag"], "left_semi").select("qid").distinct()
    marked = queries.join(known.withColumn("_known", F.lit(True)), "qid", "left")
    return marked.withColumn("tags", F.when(F.col("_known"), F.col("tags"))).drop("_known")
