import numpy as np
import pytest

from bookloom.llm import vectors
from tests.llm.helpers import empty

NAN = float("nan")


def brute(rows):
    good = [i for i, (v, label, x) in enumerate(rows) if v is not None and label is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    n, least = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for p, i in enumerate(good):
        for j in good[p + 1 :]:
            a, b = np.array(rows[i][2], float), np.array(rows[j][2], float)
            if rows[i][1] == rows[j][1] and len(a) == len(b) and (a / np.linalg.norm(a)) @ (b / np.linalg.norm(b)) >= 0.98:
                n[i], n[j] = n[i] + 1, n[j] + 1
                p1, p2 = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                least[p2] = p1
    return sorted(((v, n[i], rows[find(i)][0], v is None or rows[find(i)][0] == v) for i, (v, _, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in vectors.near_duplicates(df).collect()), key=str)


def clustered(dim=16, kind="float"):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(60):
        centre = rng.normal(size=dim)
        for _ in range(1 + (c % 5) * (c % 3) * 4):
            rows.append((len(rows) * 7 % 1009, c % 3, [float(np.float32(x)) for x in centre + 0.1 * rng.normal(size=dim) * np.linalg.norm(centre) / np.sqrt(dim)]))
    return rows


@pytest.mark.parametrize("kind", ["float", "double"])
def test_matches_brute_force(spark, kind):
    rows = clustered()
    assert got(spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>")) == brute(rows)


def test_blocks_of_a_list(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 5)
    rows = clustered()
    assert got(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")) == brute(rows)


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, among as many unrelated vectors: nearly all are found, and none below it."""
    rng = np.random.default_rng(8)
    rows, pairs = [], 0
    for i in range(600):
        x = rng.normal(size=64)
        z = rng.normal(size=64)
        x, z = x / np.linalg.norm(x), z - (z @ x) * x / (x @ x)
        c = 0.9801 if i % 2 else 0.9799
        rows += [(2 * i, 0, x.tolist()), (2 * i + 1, 0, (c * x + np.sqrt(1 - c * c) * z / np.linalg.norm(z)).tolist())]
        pairs += i % 2
    out = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    found = [r for r in out if r["n_links"]]
    assert all((r["vec_id"] // 2) % 2 for r in found) and len(found) >= 2 * 0.99 * pairs


def test_odd_vectors_and_empty_tables(spark):
    rows = [
        (1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (3, 1, [2.0, 0.01]), (4, 2, [1.0, 0.0]), (5, None, [1.0, 0.0]), (6, 1, None), (7, 1, [0.0, 0.0]), (8, 1, [NAN, 1.0]),
        (9, 1, [None, 1.0]), (10, 1, [1.0, 0.0, 0.0]), (11, 1, [1.0, 0.0, 0.0]), (None, 1, [1.0, 0.0]), (12, 1, []), (13, 1, [float("inf"), 0.0]),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, pair int, head string")
    assert got(df) == brute(rows)
    assert got(empty(df)) == []


def test_huge_components(spark):
    df = spark.createDataFrame([(1, 1, [1e300, 0.0]), (2, 1, [1e-300, 0.0])], "vec_id long, label int, embedding array<double>")
    assert got(df) == [(1, 1, 1, True), (2, 1, 1, False)]
