import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from bookloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, "bookloom-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate one expression over a single row of named values."""
    from pyspark.sql import functions as F

    def value(column, **values):
        row = spark.range(1)
        for name, v in values.items():
            row = row.withColumn(name, F.lit(v))
        return row.select(column.alias("v")).first()["v"]

    return value


@pytest.fixture(scope="session")
def tiny(spark):
    """Three documents in two corpora as a library."""
    from pyspark.sql import functions as F

    from bookloom.sources.library import Library

    rows = [
        ("d1", 1, "PyTorch guide", "tech", "PyTorch tensors are the core data structure. Tensors run on a GPU with Neo4j beside them.", ["ml"], "Ada Lovelace", "2024-03-01"),
        ("d2", 2, "Graphs", "tech", "Neo4j stores graphs. Gandhi met Nehru in Delhi. Nehru wrote to Patel.", ["graph"], "Alan Turing", "2023-05-01"),
        ("d3", 3, "History", "past", "Patel and Delhi appear in history. Patel led the talks with Bose.", None, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id string, seq long, title string, corpus string, text string, tags array<string>, author string, day string").select(
        "*", F.lit("txt").alias("format"), F.sha2("text", 256).alias("content_hash"), F.lit("j").alias("job_id"),
        F.to_timestamp("day").alias("doc_date"), F.current_timestamp().alias("ingested_at"),
    ).drop("day")
    return Library(spark, docs)
