"""Joins of documents with lists of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MAX_BROADCAST_IDS = 2_000_000  # 8 bytes each


def sized(ids: DataFrame) -> DataFrame:
    """``ids`` marked for broadcast if they were counted to be few; otherwise the join stays a shuffle."""
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` is not the only column of ``ids``; rows without ``doc_id`` stay."""
    gone = sized(ids.toDF("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
