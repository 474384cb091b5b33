"""Exact and cell-based nearest neighbours for batches of question vectors.

Every pair of vectors in scope has to be scored once, but no pair becomes a row: tasks multiply a
block of questions with a block of items and pass on at most ``k`` rows per question. Two layouts:

* few questions (their number and bytes are checked first): the question block goes to the tasks
  that read the items, and the items are not shuffled at all;
* otherwise questions and items are laid out on a grid of bounded cells, ``scope x item block x
  question block``, so a scope with a third of all items is spread like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F, types as T

BLOCK_QUERIES = 2048
BLOCK_ITEMS = 65536
BLOCK_BYTES = 64 * 1024 * 1024
BLOCK_SCORES = 2_000_000  # similarities held at once
SIM_DIGITS = 9  # ranks compare similarities at this precision, so summation order cannot matter

META = ("corpus", "tags", "date_from", "date_to", "author")
NEEDS = {"corpus": "corpus", "tags": "tags", "date_from": "doc_date", "date_to": "doc_date", "author": "author"}


def _unit(column) -> np.ndarray:
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    norm = np.sqrt((rows * rows).sum(axis=1))
    norm[norm == 0] = 1.0
    return rows / norm[:, None]


def _group_filters(queries: pd.DataFrame) -> Iterator[tuple[dict, np.ndarray]]:
    """Question positions by the filter they share."""
    present = [c for c in META if c in queries.columns]
    if not present:
        yield {}, np.arange(len(queries))
        return

    def value(v):
        if isinstance(v, (list, tuple, np.ndarray)):
            return tuple(v)
        return None if pd.isna(v) else v

    groups: dict[tuple, list[int]] = {}
    for i, row in enumerate(zip(*(queries[c] for c in present))):
        groups.setdefault(tuple(value(v) for v in row), []).append(i)
    for key, where in groups.items():
        yield dict(zip(present, key)), np.asarray(where)


def _allowed(items: pd.DataFrame, rule: dict) -> np.ndarray:
    """Items a filter lets through; the same meaning as :func:`bookloom.operators.scope.in_scope`."""
    ok = np.ones(len(items), dtype=bool)
    if rule.get("corpus") is not None:
        ok &= (items["corpus"] == rule["corpus"]).to_numpy()
    if rule.get("tags"):
        wanted = set(rule["tags"])
        ok &= np.fromiter((t is not None and not wanted.isdisjoint(t) for t in items["tags"]), bool, len(items))
    if rule.get("date_from") is not None:
        ok &= (items["doc_date"] >= rule["date_from"]).to_numpy()
    if rule.get("date_to") is not None:
        ok &= (items["doc_date"] <= rule["date_to"]).to_numpy()
    if rule.get("author"):
        low = items["author"].str.lower()
        ok &= low.str.contains(rule["author"].lower(), regex=False, na=False).to_numpy(dtype=bool)
    return ok


def _best(queries: pd.DataFrame, items: pd.DataFrame, k: int, least: float | None, floor: np.ndarray | None = None) -> pd.DataFrame:
    """The ``k`` best items of each question in one block, ties by item id.

    ``floor`` names a similarity per question below which no item can be among its best any more; a question with no more
    than ``k`` items from there on gets these unsorted.
    """
    qids, ids, sims = [], [], []
    if len(queries) and len(items):
        items = items.iloc[np.argsort(items["item_id"].to_numpy(), kind="stable")].reset_index(drop=True)
        qv, iv = _unit(queries["vector"]), _unit(items["vector"])
        names, asked = items["item_id"].to_numpy(), queries["qid"].to_numpy(dtype=object)
        for rule, who in _group_filters(queries):
            order = np.flatnonzero(_allowed(items, rule))
            if not len(order):
                continue
            step = max(1, min(256, BLOCK_SCORES // len(order)))
            near_to = iv if len(order) == len(iv) else iv[order]
            for at in range(0, len(who), step):
                part = who[at : at + step]
                score = qv[part] @ near_to.T
                if floor is not None:
                    high = score >= floor[part, None] - 10.0**-SIM_DIGITS
                    met = high.sum(axis=1)
                    few, many = (met > 0) & (met <= k), met > k
                    at_q, at_i = np.nonzero(high & few[:, None])
                    sim = np.round(score[at_q, at_i], SIM_DIGITS)
                    if least is not None:
                        at_q, at_i, sim = at_q[sim >= least], at_i[sim >= least], sim[sim >= least]
                    qids.extend(asked[part[at_q]])
                    ids.extend(names[order[at_i]])
                    sims.extend(sim)
                    part, score = part[many], score[many]
                np.round(score, SIM_DIGITS, out=score)
                for qi, line in zip(part, score):
                    if k < len(line):
                        edge = np.partition(line, len(line) - k)[len(line) - k]
                        near = np.flatnonzero(line >= edge)
                        near = near[np.argsort(-line[near], kind="stable")][:k]
                    else:
                        near = np.argsort(-line, kind="stable")
                    if least is not None:
                        near = near[line[near] >= least]
                    qids.extend([asked[qi]] * len(near))
                    ids.extend(names[order[near]])
                    sims.extend(line[near])
    return pd.DataFrame(
        {"qid": pd.Series(qids, dtype=object), "item_id": pd.Series(ids, dtype=object), "sim": np.asarray(sims, dtype=np.float64)}
    )


def _columns(queries: DataFrame, items: DataFrame, scope: str | None) -> tuple[DataFrame, DataFrame]:
    meta = [c for c in META if c in queries.columns]
    item_meta = sorted({NEEDS[c] for c in meta})
    key = F.col(scope).alias("scope") if scope else F.lit("").alias("scope")

    def fresh(df: DataFrame, names: list[str]) -> DataFrame:
        # new attributes, because questions and items may come from one table
        return df.select(*[F.col(n).alias(n) for n in names], key).filter("vector is not null and size(vector) > 0")

    return fresh(queries, ["qid", "vector", *meta]), fresh(items, ["item_id", "vector", *item_meta])


def _result_schema(queries: DataFrame, items: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("qid", queries.schema["qid"].dataType),
            T.StructField("item_id", items.schema["item_id"].dataType),
            T.StructField("sim", T.DoubleType()),
        ]
    )


def _small_block(queries: DataFrame) -> pd.DataFrame | None:
    """The questions as one block when there are few of them and they are small; else nothing."""
    rows = queries.limit(BLOCK_QUERIES + 1).toPandas()
    if len(rows) > BLOCK_QUERIES:
        return None
    size = sum(8 * len(v) for v in rows["vector"]) + len(rows) * 64
    return rows if size <= BLOCK_BYTES else None


def _by_scan(block: pd.DataFrame, items: DataFrame, schema: T.StructType, k: int, least: float | None) -> DataFrame:
    by_scope = {s: part.drop(columns="scope").reset_index(drop=True) for s, part in block.groupby("scope")}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        floors = {name: np.full(len(part), -np.inf) for name, part in by_scope.items()}
        seen = 0
        for batch in batches:
            for name, part in batch.groupby("scope"):
                if name not in by_scope:
                    continue
                found = _best(by_scope[name], part.reset_index(drop=True), k, least, floors[name])
                kept = found if kept is None else pd.concat([kept, found], ignore_index=True)
            seen += 1
            # the k-th best so far is taken after 1, 2, 4, ... batches; later items below it are not looked at again
            if kept is not None and (seen & (seen - 1) == 0 or len(kept) > 4 * k * len(block) + 4096):
                kept = _trim(kept, k)
                edge = kept.groupby("qid")["sim"].agg(["size", "min"])
                edge = edge["min"][edge["size"] >= k]
                floors = {name: part["qid"].map(edge).fillna(-np.inf).to_numpy(dtype=float) for name, part in by_scope.items()}
        if kept is not None and len(kept):
            yield _trim(kept, k)

    return items.mapInPandas(score, schema)


def _trim(found: pd.DataFrame, k: int) -> pd.DataFrame:
    best = found.sort_values(["qid", "sim", "item_id"], ascending=[True, False, True])
    return best.groupby("qid", sort=False).head(k)


def _by_grid(queries: DataFrame, items: DataFrame, schema: T.StructType, k: int, least: float | None) -> DataFrame:
    blocks = lambda df, size, name: df.groupBy("scope").agg(
        F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name)
    )
    shape = blocks(items, BLOCK_ITEMS, "ib").join(blocks(queries, BLOCK_QUERIES, "qb"), "scope")
    placed_items = (
        items.join(shape, "scope")
        .withColumn("i", F.pmod(F.xxhash64("item_id"), F.col("ib")).cast("int"))
        .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
        .drop("ib", "qb")
    )
    placed_queries = (
        queries.join(shape, "scope")
        .withColumn("q", F.pmod(F.xxhash64("qid"), F.col("qb")).cast("int"))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ib") - 1)))
        .drop("ib", "qb")
    )

    def cell(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        return _best(q, i, k, least)

    cells = ["scope", "i", "q"]
    return placed_queries.groupBy(*cells).cogroup(placed_items.groupBy(*cells)).applyInPandas(cell, schema)


def nearest(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    scope: str | None = None,
    at_least: float | None = None,
    layout: str = "auto",
) -> DataFrame:
    """Exact ``k`` nearest items per question by cosine: ``(qid, item_id, sim, rnk)``.

    ``queries``: ``qid, vector`` and any of the filter columns ``corpus, tags, date_from, date_to,
    author`` (null = no filter). ``items``: ``item_id, vector`` and the columns those filters need.
    ``scope`` names a column both sides must agree on.
    """
    q, i = _columns(queries, items, scope)
    schema = _result_schema(q, i)
    block = _small_block(q) if layout in ("auto", "scan") else None
    if block is not None:
        unused = [c for c in META if c in block.columns and block[c].isna().all()]
        block, i = block.drop(columns=unused), i.drop(*{NEEDS[c] for c in unused} - {NEEDS[c] for c in META if c in block.columns and c not in unused})
        found = _by_scan(block, i, schema, k, at_least)
    else:
        found = _by_grid(q, i, schema, k, at_least)
    order = Window.partitionBy("qid").orderBy(F.desc("sim"), "item_id")
    return found.withColumn("rnk", F.row_number().over(order)).filter(F.col("rnk") <= k)


def matching_items(queries: DataFrame, items: DataFrame, scope: str, threshold: float, layout: str = "auto") -> DataFrame:
    """Ids of items at least ``threshold`` similar to some question of the same scope.

    Roles are swapped, items ask for their single nearest question, so one row per item leaves a task.
    """
    asking = items.select(F.col("item_id").alias("qid"), "vector", scope)
    offered = queries.select(F.col("qid").alias("item_id"), "vector", scope)
    near = nearest(asking, offered, 1, scope, at_least=threshold, layout=layout)
    return near.select(F.col("qid").alias("item_id")).distinct()


def build_cells(items: DataFrame, cells: int, seed: int = 7, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """Coarse cells for approximate search: ``(items with cell, centroids(cell, vector))``.

    Cells are spherical k-means; the number of centroids is the caller's and stays small.
    """
    ready = items.withColumn("_v", array_to_vector(F.col("vector").cast("array<double>")))
    model = KMeans(
        k=cells, seed=seed, maxIter=rounds, distanceMeasure="cosine", featuresCol="_v", predictionCol="cell"
    ).fit(ready)
    spark = items.sparkSession
    centers = spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, vector array<double>"
    )
    return model.transform(ready).drop("_v"), centers


def nearest_in_cells(
    queries: DataFrame, celled: DataFrame, centers: DataFrame, k: int, nprobe: int, layout: str = "grid"
) -> DataFrame:
    """Approximate ``k`` nearest: each question looks into its ``nprobe`` nearest cells, scored exactly."""
    probes = nearest(
        queries.select("qid", "vector"), centers.select(F.col("cell").alias("item_id"), "vector"), nprobe
    ).select("qid", F.col("item_id").alias("cell"))
    asked = queries.join(probes, "qid").withColumn("scope_cell", F.col("cell").cast("string")).drop("cell")
    held = celled.withColumn("scope_cell", F.col("cell").cast("string"))
    return nearest(asked, held, k, "scope_cell", layout=layout)


