"""A stored approximate index: vectors in cells, one partition folder per cell, searched cell by cell.

The centres are fitted on a bounded sample; every vector is then stored in the folder of its nearest centre. Cells with more than
CELL_ROWS vectors are written by several tasks and scored in several blocks, so one huge cluster is no huge task. A search ranks
the centres for each question, reads only the folders some question probes (a partition filter of at most MAX_CELLS numbers) and
scores their vectors exactly. How many cells to probe is measured when the index is built: exact neighbours of sampled vectors
are found once, and the smallest number of cells that holds the wanted share of them is stored with the index. Probing every
cell gives the exact result.

Small cells share a block of vectors. A question goes to a block once, with the numbers of its cells there, and leaves at most
``k`` rows in it; neither its vector nor its answers are repeated for every cell.

Vectors that are null, empty, of another length than the first, or hold no finite length are not stored and never found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from bookloom.operators.knn import BLOCK_ITEMS, BLOCK_SCORES, META, NEEDS, SIM_DIGITS, _best, _result_schema, _trim, _unit, nearest
from bookloom.session import cut

SAMPLE_VECTORS = 50_000  # fit the centres
MAX_CELLS = 4096
CELL_ROWS = BLOCK_ITEMS
CALIBRATION_QUESTIONS = 200
RECALL = 0.95  # wanted of the calibration questions
NEIGHBOURS = 10
BLOCK_VALUES = 64 * BLOCK_ITEMS  # numbers in the vectors of a block
ASKED_VALUES = 1 << 20  # numbers in the vectors of the questions that meet a block, or leave a task at once
SLICE_ITEMS = 4096  # vectors scored before the k-th best similarity so far is looked at again


def _slices(df: pd.DataFrame, width: int, values: int = BLOCK_SCORES) -> Iterator[pd.DataFrame]:
    """Rows in runs that make at most ``values`` numbers at ``width`` numbers a row."""
    step = max(1, values // max(width, 1))
    for at in range(0, len(df), step):
        yield df.iloc[at : at + step]


def _ranked_cells(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Cells of each vector, nearest first; equally near ones by number."""
    return np.argsort(-np.round(vectors @ centres.T, SIM_DIGITS), axis=1, kind="stable")


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    probes: int  # measured when built
    centres: np.ndarray  # unit vectors, one per cell

    @property
    def items(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        return self.spark.read.schema(schema).parquet(f"{self.path}/items")

    @staticmethod
    def build(items: DataFrame, path: str, cells: int | None = None, recall: float = RECALL, seed: int = 7) -> VectorIndex:
        """Store ``items (item_id, vector, ...)`` below ``path``; ``cells`` defaults to the square root of their number."""
        spark = items.sparkSession
        length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        dim = items.filter("size(vector) > 0").select(F.size("vector")).first()
        good = items.filter((F.size("vector") == (dim[0] if dim else 0)) & (length > 0) & (length < float("inf")))
        count = good.count()
        cells = max(1, min(cells or round(count**0.5), MAX_CELLS, count or 1))
        share = min(1.0, SAMPLE_VECTORS / max(count, 1))
        chosen = F.pmod(F.xxhash64("item_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))
        sample = good.filter(chosen).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features")) if count else None
        if cells > 1:
            model = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(sample.persist())
            sample.unpersist()
            centres = _unit(pd.Series([np.asarray(c) for c in model.clusterCenters()]))
        else:
            centres = np.ones((1, dim[0] if dim else 1)) / np.sqrt(dim[0] if dim else 1)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for part in _slices(batch, len(centres)):
                    yield part.assign(cell=np.argmax(np.round(_unit(part["vector"]) @ centres.T, SIM_DIGITS), axis=1).astype(np.int32))

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in good.schema)
        placed = cut(good.mapInPandas(place, f"{fields}, cell int"))
        placed.limit(0).write.parquet(f"{path}/schema")
        parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("_parts"))
        spread = placed.join(F.broadcast(parts), "cell").withColumn("_part", F.pmod(F.xxhash64("item_id"), F.col("_parts")))  # one row per cell
        spread.repartition("cell", "_part").drop("_parts", "_part").write.partitionBy("cell").option("maxRecordsPerFile", CELL_ROWS).parquet(f"{path}/items")
        index = VectorIndex(spark, path, len(centres), centres)
        index.probes = index.calibrated(recall, seed) if count else 1
        rows = [(i, [float(x) for x in c], index.probes) for i, c in enumerate(centres)]
        spark.createDataFrame(rows, "cell int, centre array<double>, probes int").coalesce(1).write.parquet(f"{path}/centres")
        return index

    @staticmethod
    def open(spark: SparkSession, path: str) -> VectorIndex:
        rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # at most MAX_CELLS
        return VectorIndex(spark, path, rows[0]["probes"], np.array([r["centre"] for r in rows]))

    def calibrated(self, recall: float, seed: int) -> int:
        """The smallest number of cells whose vectors include ``recall`` of the exact neighbours of sampled vectors."""
        stored = self.items
        few = stored.orderBy(F.xxhash64("item_id", F.lit(seed))).limit(CALIBRATION_QUESTIONS)
        asked = few.select(F.col("item_id").alias("qid"), "vector").toPandas()
        order = _ranked_cells(_unit(asked["vector"]), self.centres)
        rank = {(q, c): n for q, cells in zip(asked["qid"], order) for n, c in enumerate(cells, 1)}
        questions = self.spark.createDataFrame(asked, few.select(F.col("item_id").alias("qid"), "vector").schema)
        exact = nearest(questions, stored.select("item_id", "vector"), NEIGHBOURS, layout="scan")
        held = exact.join(stored.select("item_id", "cell"), "item_id").select("qid", "cell").collect()  # at most 200 x 10
        at = np.sort([rank[(r["qid"], r["cell"])] for r in held])
        return int(at[max(int(np.ceil(recall * len(at))) - 1, 0)])

    def probed(self, questions: DataFrame, probes: int) -> list[int]:
        """Numbers of the cells that some question probes, at most MAX_CELLS."""
        centres = self.centres

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for part in _slices(batch, len(centres)):
                    yield pd.DataFrame({"cell": np.unique(_ranked_cells(_unit(part["vector"]), centres)[:, :probes]).astype(np.int32)})

        return [r["cell"] for r in questions.select("vector").mapInPandas(look, "cell int").distinct().collect()]

    def search(self, questions: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """``qid, item_id, sim, rnk``: the ``k`` nearest vectors of the probed cells for ``questions (qid, vector, filters...)``.

        Filter columns are those of :func:`bookloom.operators.knn.nearest`, applied within the cells.
        """
        probes = max(1, min(probes or self.probes, len(self.centres)))
        everywhere, dim = probes == len(self.centres), self.centres.shape[1]
        meta = [c for c in META if c in questions.columns]
        asked = questions.filter(F.size("vector") == dim).select("qid", "vector", *meta)
        items = self.items if everywhere else self.items.filter(F.col("cell").isin(self.probed(asked, probes)))
        sizes = {r["cell"]: r["count"] for r in items.groupBy("cell").count().collect()}  # at most MAX_CELLS
        blocks = _blocks(sizes, max(1, min(BLOCK_ITEMS, BLOCK_VALUES // dim)), 2 * self.spark.sparkContext.defaultParallelism)
        turns = -(-asked.count() * dim // ASKED_VALUES) or 1

        place = self.spark.createDataFrame([(c, at, n) for c, (at, n) in blocks.items()], "cell int, _first int, _parts int")
        held = (
            items.select("item_id", "vector", "cell", *sorted({NEEDS[c] for c in meta}))
            .join(F.broadcast(place), "cell")  # one row per cell
            .withColumn("block", (F.col("_first") + F.pmod(F.xxhash64("item_id"), F.col("_parts"))).cast("int"))
            .withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
            .drop("_first", "_parts")
        )
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)
        sent = asked.mapInPandas(_sender(self.centres, probes, blocks), f"{fields}, block int, cells array<int>")
        sent = sent.withColumn("turn", F.pmod(F.xxhash64("qid"), F.lit(turns)).cast("int"))

        def score(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
            return _best_in_cells(q, i, k, everywhere)

        keys = ["block", "turn"]
        found = sent.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(score, _result_schema(asked, items))
        order = Window.partitionBy("qid").orderBy(F.desc("sim"), "item_id")
        return found.withColumn("rnk", F.row_number().over(order)).filter(F.col("rnk") <= k)


def _blocks(sizes: dict[int, int], most: int, spread: int) -> dict[int, tuple[int, int]]:
    """First block and number of blocks of each cell: small cells share one, a cell of more than ``most`` vectors has several.

    About ``spread`` blocks are made where ``most`` would give fewer.
    """
    room = max(1, min(most, -(-sum(sizes.values()) // spread)))
    out: dict[int, tuple[int, int]] = {}
    block = used = 0
    for cell, n in sorted(sizes.items()):
        if used and used + n > room:
            block, used = block + 1, 0
        parts = -(-n // most)
        out[cell] = (block, parts)
        if parts > 1:
            block += parts
        else:
            used += n
    return out


def _sender(centres: np.ndarray, probes: int, blocks: dict[int, tuple[int, int]]):
    """Batches of questions to rows with ``block`` and ``cells``: one per question and block that holds a cell of it.

    When every cell is probed the numbers are left out.
    """
    first = np.full(len(centres), -1)
    parts = np.ones(len(centres), dtype=int)
    for cell, (at, n) in blocks.items():
        first[cell], parts[cell] = at, n
    all_blocks = np.unique([at + i for at, n in blocks.values() for i in range(n)]).astype(int)
    width = max(len(centres), 1)

    def packed(part: pd.DataFrame, who: np.ndarray, block: np.ndarray, cells: list) -> Iterator[pd.DataFrame]:
        dim = centres.shape[1]
        step = max(1, ASKED_VALUES // max(dim, 1))
        for at in range(0, len(who), step):
            here = part.iloc[who[at : at + step]]
            yield here.assign(block=block[at : at + step].astype(np.int32), cells=pd.Series(cells[at : at + step], index=here.index, dtype=object))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _slices(batch.reset_index(drop=True), width):
                if probes == len(centres):
                    who, block = np.repeat(np.arange(len(part)), len(all_blocks)), np.tile(all_blocks, len(part))
                    yield from packed(part, who, block, [None] * len(who))
                    continue
                cells = _ranked_cells(_unit(part["vector"]), centres)[:, :probes].ravel()
                who = np.repeat(np.arange(len(part)), probes)
                stored = first[cells] >= 0
                cells, who = cells[stored], who[stored]
                times = parts[cells]
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                cells, who = np.repeat(cells, times), np.repeat(who, times)
                block = first[cells] + nth
                order = np.lexsort((block, who))
                cells, who, block = cells[order], who[order], block[order]
                starts = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (block[1:] != block[:-1])]) if len(who) else np.zeros(0, dtype=int)
                yield from packed(part, who[starts], block[starts], np.split(cells.astype(np.int32), starts[1:]) if len(who) else [])

    return send


def _best_in_cells(questions: pd.DataFrame, items: pd.DataFrame, k: int, everywhere: bool) -> pd.DataFrame:
    """The ``k`` best vectors of a block for each question, among the cells it names; later vectors below the ``k``-th best so far
    are not looked at again."""
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    if everywhere:
        pairs = [(np.arange(len(questions)), np.arange(at, min(at + SLICE_ITEMS, len(items)))) for at in range(0, len(items), SLICE_ITEMS)]
    elif len(questions):
        who = np.repeat(np.arange(len(questions)), [len(c) for c in questions["cells"]])
        named = np.concatenate([np.asarray(c) for c in questions["cells"]])
        order = np.argsort(named, kind="stable")
        numbers, starts = np.unique(named[order], return_index=True)
        asked = dict(zip(numbers.tolist(), np.split(who[order], starts[1:])))
        pairs = [(asked[c], where) for c, where in items.groupby("cell").indices.items() if c in asked]
    numbered = questions.assign(qid=np.arange(len(questions)))
    kept = _best(numbered.iloc[:0], items.iloc[:0], k, None)
    floor = np.full(len(questions), -np.inf)
    for n, (who, where) in enumerate(pairs, 1):
        found = _best(numbered.iloc[who], items.iloc[where], k, None, floor[who]).astype({"qid": np.int64})
        kept = pd.concat([kept, found], ignore_index=True) if len(kept) else found
        if n & (n - 1) == 0 or len(kept) > 2 * k * len(questions) + 4096:
            kept = _trim(kept, k)
            edge = kept.groupby("qid")["sim"].agg(["size", "min"])
            edge = edge["min"][edge["size"] >= k]
            floor[edge.index] = edge
    kept = _trim(kept, k)
    return kept.assign(qid=questions["qid"].to_numpy(dtype=object)[kept["qid"].to_numpy(dtype=int)])
