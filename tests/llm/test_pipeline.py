import corpus_pipeline
from bookloom.llm import contamination, minhash
from tests.llm.helpers import SMALL, empty, lowered, odd_documents, words


def test_stages_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = set(texts)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "benchmark_decontamination", "secret_scan", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        rows = out.collect()
        now = {r["doc_id"] for r in rows}
        assert len(rows) == len(now) and now <= kept
        if name == "language_id":
            assert now == {d for d in kept if any(c.isalpha() for c in texts[d])}
        elif name == "minhash_near_dedup":
            def sets(d):
                w = words(texts[d], True)
                return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
            seen = {d: sets(d) for d in kept}
            gone = {b for b in kept for a in kept if a < b and 100 * len(seen[a] & seen[b]) >= 80 * len(seen[a] | seen[b])}
            assert now == kept - gone
        elif name == "benchmark_decontamination":
            hits = {r["doc_id"] for r in contamination.matches(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
            assert now == kept - hits
        elif name == "secret_scan":
            assert now == kept and not any("akia" in lowered(r["text"]) for r in rows)
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        else:
            assert now == kept and all(r["round_trip"] for r in rows)
        if name != "sentencepiece":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        kept, docs = now, spark.createDataFrame(rows, out.schema)


def test_run_writes_every_stage(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns[:4] == ["doc_id", "n_pieces", "score", "ids"] and out.count() > 100


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(3, text), (2, text), (9, text + " end"), (5, "other words here now then"), (None, text)], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in minhash.one_of_each(docs).collect()) == ["2", "5", "None"]


def test_stages_on_odd_rows_and_empty_tables(spark):
    """Nulls, blank and very long texts, repeated rows and further columns: every stage keeps what its docstring says."""
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        out = stage(spark, docs, SMALL).collect()
        texts = sorted(str(r["text"]) for r in rows)
        if name == "language_id":
            assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r["doc_id"]) for r in rows if any(c.isalpha() for c in r["text"] or ""))
        elif name == "sentencepiece":
            assert len(out) == len(rows) and all(r["round_trip"] for r in out)
        else:
            assert sorted(str(r["text"]) for r in out) == texts
        if name != "sentencepiece":
            docs = spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long")
        assert stage(spark, empty(docs), SMALL).count() == 0
