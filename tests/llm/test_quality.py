import numpy as np
import pyarrow as pa

from bookloom.llm import quality
from tests.llm.helpers import SMALL, empty, odd_documents


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    p = np.array(label) == 1
    return (rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


def test_risk_needs_no_negatives():
    """Positives and an unlabelled mixture are enough to tell the two apart."""
    rng = np.random.default_rng(4)
    shift = np.zeros(quality.N_FEATURES)
    shift[:5] = 2
    positive = rng.normal(size=(800, quality.N_FEATURES)) + shift
    label = rng.random(2000) < 0.7
    unlabelled = rng.normal(size=(2000, quality.N_FEATURES)) + np.where(label[:, None], shift, -shift)
    model = quality.minimise(positive.astype(np.float32), unlabelled.astype(np.float32), 0.7)
    score = model.score(unlabelled)
    assert auc(score, label) > 0.99 and np.mean((score >= 0.5) == label) > 0.85


def test_no_positives_give_the_prior():
    model = quality.minimise(np.zeros((0, quality.N_FEATURES)), np.zeros((3, quality.N_FEATURES)), 0.4)
    assert np.allclose(model.score(np.ones((2, quality.N_FEATURES))), 0.4)


def test_statistics_of_a_text_stand_alone():
    texts = ["Hello world.\nHello world.", "", None, "A | B | C!!", "é é", "x" * 3000]
    whole = quality.statistics(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], quality.statistics(pa.array([t], pa.string()))[0], atol=1e-6)
    at = quality.N_CLASS + 64
    assert np.isclose(whole[0, at + 2], 0.5) and np.isclose(whole[0, at + 3], 0.5) or np.isclose(whole[0, at + 3], 1.0)
    assert np.isclose(whole[3, quality.CLASS[ord("|")]] ** 2, 2 / 11)


def test_held_out_quality(spark):
    folder = SMALL.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 40 and auc(np.array([r["score"] for r in held]), [r["quality"] for r in held]) > 0.9


def test_odd_rows_and_empty_tables(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (7, None), (999, 1)], "doc_id long, quality int")
    out = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert quality.score(empty(docs), quality.fit(empty(docs), empty(labels))).count() == 0
