"""The stored vector index: recall, exactness when all cells are probed, folders read, odd vectors, skew."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bookloom.operators import vector_index as vi
from bookloom.operators.knn import nearest
from bookloom.session import scratch_path


def rows_of(df):
    return sorted((r.qid, r.rnk, r.item_id, round(r.sim, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    # every third vector lies in one cluster
    rows = [(i, [float(x) for x in centres[0 if i % 3 == 0 else i % 20] + 0.3 * rng.normal(size=16)], f"s{i % 2}") for i in range(1500)]
    return spark.createDataFrame(rows, "item_id long, vector array<double>, corpus string")


@pytest.fixture(scope="module")
def index(spark, clustered):
    path = scratch_path(spark, "index")
    vi.VectorIndex.build(clustered, path, cells=24)
    return vi.VectorIndex.open(spark, path)


def asked(clustered):
    return clustered.filter("item_id % 50 = 0").select(F.col("item_id").alias("qid"), "vector")


def test_recall_of_the_measured_number_of_cells(index, clustered):
    q = asked(clustered)
    exact = {(r.qid, r.item_id) for r in nearest(q, clustered.select("item_id", "vector"), 10).collect()}
    found = {(r.qid, r.item_id) for r in index.search(q, 10).collect()}
    assert len(found & exact) >= 0.9 * len(exact) and index.probes < len(index.centres)


def test_all_cells_give_the_exact_rows(index, clustered, monkeypatch):
    q = asked(clustered)
    want = rows_of(nearest(q, clustered.select("item_id", "vector"), 10))
    assert rows_of(index.search(q, 10, probes=len(index.centres))) == want
    scoped = q.withColumn("corpus", F.lit("s1"))
    assert rows_of(index.search(scoped, 5, probes=99)) == rows_of(nearest(scoped, clustered, 5))


def test_only_probed_folders_are_read(index, clustered):
    q = asked(clustered).filter("qid = 100")
    found = index.search(q, 3, probes=2)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan
    assert index.items.count() == 1500 and len({f.split("cell=")[1].split("/")[0] for f in index.items.inputFiles()}) == 24


def test_large_cells_are_split(spark, clustered, monkeypatch):
    monkeypatch.setattr(vi, "CELL_ROWS", 40)
    path = scratch_path(spark, "index")
    split = vi.VectorIndex.build(clustered, path, cells=4)
    files = split.items.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert files <= 40 and split.items.count() == 1500
    assert rows_of(split.search(asked(clustered), 5, probes=4)) == rows_of(nearest(asked(clustered), clustered.select("item_id", "vector"), 5))


def test_odd_vectors_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, 2.0, 3.0]), (6, [float("nan"), 1.0]), (7, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "item_id long, vector array<double>")
    index = vi.VectorIndex.build(df, scratch_path(spark, "index"), cells=2)
    q = spark.createDataFrame([("a", [0.0, 1.0]), ("b", None), ("c", [1.0])], "qid string, vector array<double>")
    assert [(r.qid, r.item_id) for r in index.search(q, 1, probes=2).collect()] == [("a", 7)]
    nothing = vi.VectorIndex.build(df.limit(0), scratch_path(spark, "index"))
    assert nothing.search(q, 1).count() == 0


def test_cells_that_share_a_block_are_scored_apart(spark, clustered, monkeypatch):
    monkeypatch.setattr(vi, "BLOCK_ITEMS", 100)  # large cells are split, small ones share a block
    monkeypatch.setattr(vi, "ASKED_VALUES", 160)
    monkeypatch.setattr(vi, "SLICE_ITEMS", 30)
    index = vi.VectorIndex.build(clustered, scratch_path(spark, "index"), cells=40)
    held = index.items.toPandas()
    held["unit"] = list(vi._unit(held["vector"]))
    q = asked(clustered).withColumn("corpus", F.expr("if(qid % 100 = 0, 's0', null)"))
    for probes in (1, 5, 40):
        want = []
        for r in q.collect():
            unit = vi._unit([r.vector])
            near = held[held["cell"].isin(vi._ranked_cells(unit, index.centres)[0, :probes])]
            near = near[near["corpus"] == r.corpus] if r.corpus else near
            best = near.assign(sim=np.round(np.stack(near["unit"]) @ unit[0], 9)).sort_values(["sim", "item_id"], ascending=[False, True]).head(7)
            want += [(r.qid, n, i, round(s, 9)) for n, (i, s) in enumerate(zip(best["item_id"], best["sim"]), 1)]
        assert rows_of(index.search(q, 7, probes=probes)) == sorted(want)


def test_questions_are_not_repeated_for_every_cell(spark, clustered):
    index = vi.VectorIndex.build(clustered, scratch_path(spark, "index"), cells=200)
    q = asked(clustered)
    for probes in (150, 200):
        found = index.search(q, 5, probes=probes)
        found.collect()
        plan, moved = found._jdf.queryExecution().executedPlan().toString(), []
        todo = [found._jdf.queryExecution().executedPlan()]
        while todo:  # rows of every exchange below the answers
            node = todo.pop()
            name = node.getClass().getSimpleName()
            if name == "AdaptiveSparkPlanExec":
                todo.append(node.executedPlan())
            elif name.endswith("QueryStageExec"):
                todo.append(node.plan())
            else:
                if name == "ShuffleExchangeExec":
                    moved.append(node.metrics().apply("shuffleRecordsWritten").value())
                children = node.children()
                todo += [children.apply(i) for i in range(children.size())]
        # 30 questions: with a row for each cell 30 x 150 or more would move, and their answers 5 times as many
        assert moved and max(moved) <= 1500, (plan, moved)


def test_a_batch_of_questions_leaves_in_bounded_frames():
    rng = np.random.default_rng(1)
    centres = vi._unit(list(rng.normal(size=(900, 64))))
    sizes = {c: 1000 for c in range(900) if c != 7} | {3: 200_000}
    blocks = vi._blocks(sizes, 65536, 24)
    assert blocks[3][1] == 4 and 7 not in blocks and max(at + n for at, n in blocks.values()) < 60
    batch = pd.DataFrame({"qid": range(3000), "vector": list(rng.normal(size=(3000, 64)).astype(np.float32))})
    want = vi._ranked_cells(vi._unit(batch["vector"]), centres)[:, :400]
    for probes in (400, 900):
        met = {}
        tracemalloc.start()
        for frame in vi._sender(centres, probes, blocks)(iter([batch])):
            assert len(frame) * 64 <= vi.ASKED_VALUES
            if probes == 400:
                for q, block, cells in zip(frame["qid"], frame["block"], frame["cells"]):
                    met.setdefault(q, {})[block] = set(cells)
            else:
                assert frame["cells"].isna().all()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 300 * 1024 * 1024  # 3,000 x 900 rows with their vectors would be 690 MB as numbers alone
        for q, per_block in met.items():
            for c in set(want[q]) - {7}:
                assert all(c in per_block[blocks[c][0] + i] for i in range(blocks[c][1]))
            assert set().union(*per_block.values()) == set(want[q]) - {7}
