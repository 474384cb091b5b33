import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from bookloom.llm import pieces
from tests.llm.helpers import SMALL, empty, odd_documents


@pytest.fixture(scope="module")
def lattice():
    with open(pieces.MODEL_PATH, "rb") as f:
        return pieces.Lattice(f.read())


def all_segmentations(lattice, text):
    """Every segmentation as (score, ids), best first, by plain recursion."""
    data = (" " + text).encode() if text else b""
    found = []

    def go(i, ids, score):
        if i == len(data):
            found.append((score, ids))
            return
        size = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
        for j in range(i + 1, len(data) + 1):
            if data[i:j] in lattice.plain:
                s, k = lattice.plain[data[i:j]]
                go(j, [*ids, k], score + s)
        if data[i : i + size] not in lattice.plain:
            go(i + size, [*ids, *(int(lattice.byte_id[b]) for b in data[i : i + size])], score + lattice.lowest)

    go(0, [], 0.0)
    return sorted(found, key=lambda x: -x[0])


TEXTS = ["abc", "a b", "the cat", " x  y ", "é 1", "\nab c", "", "aa aa", "日x", "😀a", None, "a\tb", "   ", "<s>", "ﬁ"]


def test_nbest_matches_every_segmentation(lattice):
    ids, totals, best = lattice.encode(pa.array(TEXTS), 6)
    for text, one, total, found in zip(TEXTS, ids.to_pylist(), totals, best):
        every = all_segmentations(lattice, text or "")
        assert [s for s, _ in found] == [s for s, _ in every[:6]]
        assert total == every[0][0] and (total, one) in every and found[0][1].tolist() == one
        ranked = [(s, ids.tolist()) for s, ids in found]
        assert all(r in every for r in ranked) and len({tuple(k) for _, k in ranked}) == len(ranked)
        offered = pa.array([k for _, k in ranked], pa.list_(pa.int32()))
        assert lattice.decode(offered) == [text or ""] * len(ranked)


def test_round_trip_and_rows(spark, lattice):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(odd_documents(spark).select("doc_id", "text"))
    model = pieces.read_model(spark)
    encoded = pieces.encode_documents(docs, model)
    rows = encoded.collect()
    assert len(rows) == docs.count() and all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in rows)
    assert all(a["score"] >= b["score"] for r in rows for a, b in zip(r["nbest"], r["nbest"][1:]))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in pieces.decode_documents(encoded, model).collect()) == sorted((r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
    assert pieces.encode_documents(empty(docs), model).count() == 0


def test_scores_do_not_depend_on_neighbours(lattice):
    plain = lambda best: [(s, ids.tolist()) for s, ids in best]
    alone = [plain(lattice.encode(pa.array([t]), 3)[2][0]) for t in TEXTS]
    assert [plain(b) for b in lattice.encode(pa.array(TEXTS), 3)[2]] == alone


@pytest.mark.parametrize("text", ["ab" * 4_000, "日本語の文" * 1_000, "a" * 5_000])
def test_very_long_runs_without_white_space(lattice, text):
    tracemalloc.start()
    ids, _, (best,) = lattice.encode(pa.array([text]), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20 and len(best) == (1 if text[0] == "日" else 3) and lattice.decode(pa.array([k for _, k in best])) == [text] * len(best)
    assert best[0][1].tolist() == ids.to_pylist()[0] and [x for x, _ in best] == sorted((x for x, _ in best), reverse=True)


def test_segmentations_of_documents(spark, lattice):
    docs = odd_documents(spark).filter("doc_id <> 5 or doc_id is null")
    model = pieces.read_model(spark)
    rows = pieces.segmentations(docs, model, 4)
    assert rows.filter("rank = 1").count() == docs.count() and rows.filter("rank = 4").count() > 0
    texts = {r["text"] or "" for r in docs.collect()}
    assert {r["text"] for r in pieces.decode_documents(rows, model).collect()} == texts
    digests = {(r["doc_id"], n + 1, b["ids_sha256"]) for r in pieces.encode_documents(docs, model, 4).collect() for n, b in enumerate(r["nbest"])}
    assert digests == {(r["doc_id"], r["rank"], pieces.ids_digest(np.array(r["ids"]))) for r in rows.collect()}


def test_size_of_the_model_is_checked(spark, monkeypatch):
    monkeypatch.setattr(pieces, "MAX_MODEL_BYTES", 10)
    with pytest.raises(ValueError):
        pieces.read_model(spark)
