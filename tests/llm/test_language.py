import itertools

import numpy as np
import pyarrow as pa

from bookloom.llm import language
from bookloom.llm.words import slices
from tests.llm.helpers import SMALL, empty, odd_documents


def test_forward_backward_matches_every_labelling():
    rng = np.random.default_rng(2)
    bounds, k = np.array([0, 4, 5, 8]), 3
    e, begin, step = rng.normal(size=(8, k)), rng.normal(size=k), rng.normal(size=(k, k))
    posterior, moves, log_z = language.forward_backward(e, bounds, begin, step)
    want, want_moves, total = np.zeros((8, k)), np.zeros((k, k)), 0.0
    for a, b in zip(bounds, bounds[1:]):
        z, mass, pairs = 0.0, np.zeros((b - a, k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=b - a):
            w = np.exp(begin[path[0]] + sum(e[a + i, y] for i, y in enumerate(path)) + sum(step[x, y] for x, y in zip(path, path[1:])))
            z += w
            for i, y in enumerate(path):
                mass[i, y] += w
            for x, y in zip(path, path[1:]):
                pairs[x, y] += w
        want[a:b] = mass / z
        want_moves += pairs / z
        total += np.log(z)
    assert np.allclose(posterior, want) and np.allclose(moves, want_moves) and np.isclose(log_z, total)


def test_features_do_not_depend_on_neighbours():
    texts = ["Straße Weg", "École ÉCOLE école", "weg", "x1y"]
    rng = np.random.default_rng(0)
    weight = rng.normal(size=(language.BUCKETS, 2))
    whole = np.concatenate([language.words_of(s).emissions(weight) for s in slices(pa.array(texts), language.LETTER)])
    single = np.concatenate([language.words_of(s).emissions(weight) for t in texts for s in slices(pa.array([t]), language.LETTER)])
    assert np.allclose(whole, single)
    assert np.allclose(whole[2], whole[3]) and np.allclose(whole[3], whole[4]) and np.allclose(whole[1], whole[5])


def lines():
    en, de = "the of and to with was for that this these".split(), "der die und mit nicht von ein eine auch wird".split()
    rng = np.random.default_rng(1)
    return [(" ".join(rng.choice(words, 8)), lang) for _ in range(200) for lang, words in (("en", en), ("de", de))]


def test_words_of_code_switched_text():
    model = language.train(lines())
    s, = slices(pa.array(["the of and with nicht von der die und the of"]), language.LETTER)
    w = language.words_of(s)
    posterior, _, _ = language.forward_backward(w.emissions(model.weight), np.array([0, len(w.of)]), model.begin, model.step)
    assert [model.languages[i] for i in posterior.argmax(1)] == ["en"] * 4 + ["de"] * 5 + ["en"] * 2
    assert model.step[0, 0] > model.step[0, 1]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = language.predict(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == docs.count() and len(held) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_odd_rows_and_empty_tables(spark):
    docs = odd_documents(spark)
    letters = spark.createDataFrame([(90, "ΑΒΓ"), (91, "漢字"), (92, "١٢٣"), (93, "…")], "doc_id long, text string")
    model = language.train(lines())
    out = {(r["doc_id"], r["n_words"]): r for r in language.predict(docs.select("doc_id", "text").unionByName(letters), model).collect()}
    by_id = {k[0]: r for k, r in out.items()}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (2, 3, 4, 6, 92, 93))
    assert all(by_id[i]["lang_pred"] in ("en", "de") for i in (1, 5, 7, 90, 91, None))
    assert language.fit(empty(docs)) is None and {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}
    kept = language.identified(docs, model)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "5", "7", "None"]
    assert language.identified(docs, None).count() == 0 and language.predict(empty(docs), model).count() == 0
