import numpy as np

from pyspark.sql import functions as F

from bookloom.llm import contamination as c
from tests.llm.helpers import SMALL, empty, odd_documents, words


def weights(w):
    k = min(5, len(w))
    return {" ".join(w[i : i + k]): len(" ".join(w[i : i + k])) for i in range(len(w) - k + 1)}


def similarity(a, b):
    a, b = weights(a), weights(b)
    both = {**a, **b}
    return sum(both[s] for s in a.keys() & b.keys()) / max(1, sum(both.values()))


def brute(docs, items):
    """Best similarity over the windows of an item's length in which item and text share a shingle at the same place; windows
    are cut at the ends of the text."""
    out = {}
    for d, text in docs:
        w = words(text, lower=True)
        for i, body in items:
            b = words(body, lower=True)
            if not b or not w:
                continue
            k = min(5, len(b))
            aligned = lambda s: any(s + i >= 0 and w[s + i : s + i + k] == b[i : i + k] for i in range(len(b) - k + 1))  # noqa: B023, E731
            best = max((similarity(w[max(0, s) : s + len(b)], b) for s in range(1 - len(b), len(w)) if aligned(s)), default=0)
            if best >= 0.8:
                out[d, i] = max(best, out.get((d, i), 0))
    return out


def found(docs, items, **more):
    return {(r["doc_id"], r["item_id"]): r["similarity"] for r in c.matches(docs, items, **more).collect()}


def test_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"word{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(14, 40))))) for i in range(8)] + [(90, "one two three"), (91, ""), (92, None)]
    docs = []
    for d in range(40):
        w = list(rng.choice(vocabulary, int(rng.integers(0, 80))))
        body = items[d % 8][1].split()
        for _ in range(d % 4 // 2):
            body[int(rng.integers(0, len(body)))] = "changed"
        if d % 3:
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = body
        docs.append((d, " ".join(w).upper() if d % 5 == 0 else " ".join(w)))
    docs += [(50, "zero One  two\tTHREE four"), (51, items[0][1][: len(items[0][1]) * 9 // 10]), (52, "x " + items[1][1])]
    got = found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    assert got.keys() == want.keys() and len(want) > 8
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_table_leaks_are_found(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    got = found(docs, items)
    texts = {r["item_id"]: " ".join(words(r["text"], True)) for r in items.collect()}
    whole = {(r["doc_id"], i) for r in docs.collect() for i, t in texts.items() if t in " ".join(words(r["text"], True))}
    assert whole and whole <= got.keys()
    kept = {r["doc_id"] for r in c.clean(docs, items).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {d for d, _ in got}


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    rng = np.random.default_rng(7)
    for radius in (3, 20):
        rows = []
        for i in range(200):
            a = int(rng.integers(-(2**63), 2**63))
            flips = rng.choice(64, int(rng.integers(0, radius + 1)), replace=False)
            b = a
            for f in flips:
                b ^= (1 << int(f)) if f < 63 else -(1 << 63)
            rows.append((a, b, len(flips)))
        df = spark.createDataFrame(rows, "a long, b long, d int")
        meet = F.arrays_overlap(c.block_keys(F.col("a"), radius), c.block_keys(F.col("b"), radius))
        assert df.filter(meet & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) == F.col("d"))).count() == 200


def test_simhash_is_the_weighted_majority(spark):
    row = spark.createDataFrame([("the quick brown fox jumps over it",)], "text string").select(c.weighted(c.words(F.col("text"))).alias("s"))
    r = row.select("s", c.simhash(F.col("s")).alias("f")).first()
    want = sum(1 << b for b in range(64) if sum(s["w"] * (1 if s["h"] >> b & 1 else -1) for s in r["s"]) > 0)
    assert r["f"] & (2**64 - 1) == want and [s["w"] for s in r["s"]] == [25, 26, 23]


def test_large_item_tables_join_without_broadcast(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    before = found(docs, items)
    monkeypatch.setattr(c, "MAX_BROADCAST_SHINGLES", 0)
    assert found(docs, items) == before


def test_odd_rows_and_empty_tables(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "word", 2), (3, "word", 2), (None, "lazy dog and runs away from all of them today", 3)], "item_id long, text string, n int")
    got = c.matches(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(7, 3), (1, None), (None, None)}
    assert c.matches(empty(docs), items).count() == 0 and c.matches(docs, empty(items)).count() == 0
    assert sorted(str(r["doc_id"]) for r in c.clean(docs, items).collect()) == ["2", "3", "4", "5", "6", "None"]
