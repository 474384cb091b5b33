import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bookloom.llm import minhash
from bookloom.llm.components import components
from tests.llm.helpers import SMALL, empty, odd_documents, words


def shingles(text, k):
    w = words(text, lower=True)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k):
    sets = [(d, shingles(t, k)) for d, t in rows]
    least = {d: d for d, _ in sets if d is not None}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                least[max(p, q)] = min(p, q)
    return sorted(((d, len(x), find(d) if d is not None else None, d is None or find(d) == d) for d, x in sets), key=str)


def got(docs, k):
    return sorted((tuple(r) for r in minhash.near_duplicates(docs, k).collect()), key=str)


@pytest.mark.parametrize("k", [2, 5])
def test_matches_brute_force(spark, k):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").repartition(3)
    assert got(docs, k) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], k)


def test_families_of_alike_documents(spark):
    """Variants of one text, some linked, many just below the threshold: more pairs than a leaf passes on."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(150):
        w = list(base)
        for i in rng.choice(120, int(rng.integers(0, 16)), replace=False):
            w[i] = f"v{rng.integers(10_000)}"
        rows.append((d * 3 + 1, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 2)
    assert got(docs, 2) == want and 10 < sum(r[3] for r in want) < 140


def test_family_blocks(spark, monkeypatch):
    """Blocks of a family give the components of a whole comparison."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    base = [f"w{i}" for i in range(60)]
    rows = [(d, " ".join(base[: 60 - d % 9] + [f"u{d % 13}{j}" for j in range(d % 9)])) for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ties = spark.createDataFrame([(0, d) for d in range(1, 60)], "a long, b long")
    none = ties.limit(0).select(F.col("a").alias("id"), F.col("b").alias("component"))
    links = minhash.within_families(docs, ties, none, 2, 80)
    label = {r["id"]: r["component"] for r in components(links).collect()}
    assert [(d, label.get(d, d)) for d in range(60)] == [(r[0], r[2]) for r in sorted(brute(rows, 2))]


def test_set_sizes_of_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 90, 40)).astype(np.uint64) for _ in range(12)]
    found = minhash.shared_items(sets[:5], sets[5:], width=16)
    assert found.tolist() == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]


def test_shingle_sets_of_short_texts():
    (_, rows, row, h), = minhash.shingle_sets(pa.array(["a b", "B A", None, "", "a", "a  B", "a b a b"]), 2)
    sets = [frozenset(h[row == i]) for i in range(rows)]
    assert sets[0] == sets[5] != sets[1] and not sets[2] and not sets[3] and len(sets[4]) == 1 and len(sets[6]) == 2


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 200 + i) for i in range(30)] + [(500, 500), (7, 3), (3, 7)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 1 for i in range(1, 61)) and all(found[200 + i] == 100 for i in range(30)) and 500 not in found
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows_and_empty_tables(spark):
    docs = odd_documents(spark)
    assert got(docs, 2) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], 2)
    assert got(empty(docs), 2) == []
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in docs.collect())


def test_crowded_leaves_are_dealt_into_blocks(spark, monkeypatch):
    """No task holds a leaf of more than LEAF_ROWS rows, and the components stay those of a whole comparison."""
    monkeypatch.setattr(minhash, "LEAF_ROWS", 20)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 11)
    dealt = []
    whole = minhash.crowded_ties
    monkeypatch.setattr(minhash, "crowded_ties", lambda found, percent: dealt.append(found.select("key").distinct().count()) or whole(found, percent))
    rng = np.random.default_rng(5)
    rows = []
    for d in range(160):
        w = [f"w{d % 2}x{i}" for i in range(120)]
        for i in rng.choice(120, int(rng.integers(0, 16)), replace=False):
            w[i] = f"v{rng.integers(10_000)}"
        rows.append((d * 3 + 1, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 2)
    assert got(docs, 2) == want and dealt and dealt[0] > 0 and 10 < sum(r[3] for r in want) < 150


@pytest.mark.parametrize("depth", [5, 6])
def test_recall_holds_at_every_depth(depth):
    """Pairs at the threshold are met as often at the depth of large tables as at that of small ones."""
    rng, pairs = np.random.default_rng(11), 6_000
    trees = minhash.trees_for(80, depth)
    lost = 0
    for _ in range(0, pairs, 3000):
        one = rng.integers(0, 2**32, (3000, minhash.POSITIONS), dtype=np.uint32)
        two = np.where(rng.random(one.shape) < 0.8, one, rng.integers(0, 2**32, one.shape, dtype=np.uint32))
        (who, left), (mate, right) = minhash.reached(one, depth, trees), minhash.reached(two, depth, trees)
        a, b = (np.unique(np.stack([w.astype(np.uint64), k], 1), axis=0) for w, k in ((who, left), (mate, right)))
        both, n = np.unique(np.concatenate([a, b]), axis=0, return_counts=True)
        lost += 3000 - len(np.unique(both[n == 2][:, 0]))
    assert lost <= 3 and minhash.missed(80, depth, trees) <= 1 / 30_000 < minhash.missed(80, depth, 12)
