"""Connected components of links between ids, by alternating stars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from bookloom.session import cut

LEAST_TASKS, LINKS_PER_TASK = 8, 50_000


def _mark(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every id of ``links (a, b)``; the component is its smallest id.

    Each round ties every id's larger neighbours, then its smaller ones, to the smallest id it sees, until nothing changes: a
    number of rounds that grows with the logarithm of a component's size. Minima combine before the shuffle, and every round
    ends in a reliable checkpoint. Links of an id with itself and null ids are left out. Few links are handled by few tasks, as a
    shuffle of small tables costs files and not rows.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a <> b").distinct())
    mark = _mark(edges)
    while mark[0]:
        tasks = max(LEAST_TASKS, math.ceil(mark[0] / LINKS_PER_TASK))
        edges = edges.coalesce(tasks)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.filter("u <> v").coalesce(tasks).distinct().coalesce(tasks))
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
