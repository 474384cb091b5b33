import hashlib

from bookloom.llm import substrings
from tests.llm.helpers import SMALL, empty, odd_documents, words


def brute(rows):
    least, out = {}, []
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 12) if d is not None else ():
            k = tuple(w[i : i + 13])
            least[k] = min(least.get(k, d), d)
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - 12) if d is not None else ():
            if least[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(docs):
    return sorted((tuple(r) for r in substrings.dedup(docs).collect()), key=str)


def test_cover_serves_every_pair_of_positions():
    c, p = set(substrings.COVER), substrings.PERIOD
    assert all(any((i + s) % p in c and (j + s) % p in c for s in range(p)) for i in range(p) for j in range(p))


def test_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").repartition(5)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(docs) == brute(rows)


def test_copies_shifts_and_repeats(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [
        (5, base), (3, "x " + base), (None, base), (7, ""), (8, None), (5, base), (5, "q " + base + " z"), (9, base), (9, base), (11, "short text"),
        (12, " ".join(f"w{i}" for i in range(20, 33))), (13, "w " * 40), (14, "w " * 50), (15, " ".join(f"w{i}" for i in range(20, 32))), (16, base.replace(" ", "\t\n")),
        *((20 + s, "y " * s + " ".join(f"w{i}" for i in range(10, 30))) for s in range(1, 9)),
    ]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_parts_settled_in_a_task_change_nothing(spark, monkeypatch):
    rows = [(i, " ".join(f"c{j % 40}" for j in range(i, i + 45))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs.repartition(1)) == got(docs.repartition(11)) == brute(rows)


def test_odd_rows_and_empty_tables(spark):
    docs = odd_documents(spark)
    assert got(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got(empty(docs)) == []
