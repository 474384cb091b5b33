import datetime as dt
import random

from pyspark.sql import functions as F

from bookloom.functions.vectors import hash_embedding
from bookloom.operators import cache, catalog as ct, contradictions, conversations as cv, documents as docs, evaluation as ev
from bookloom.operators.models import contains_claim, model_map, pair_scorer, batch_embedder
from bookloom.plans import ask, overview, reorganize
from bookloom.session import ranked
from bookloom.sources import files
from bookloom.streaming import ingest as si

def now():
    return F.to_timestamp(F.lit("2024-06-01"))


def day(n, hour=0):
    return dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=n, hours=hour)


def test_ranked_spans_partitions(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 4}", rng.randint(0, 50), i) for i in range(400)]
    got = ranked(spark.createDataFrame(rows, "k string, v int, i int"), ["k"], [F.asc("v"), F.asc("i")]).collect()
    want = {}
    for k in {r[0] for r in rows}:
        for n, r in enumerate(sorted((v, i) for kk, v, i in rows if kk == k), 1):
            want[r[1]] = n
    assert {r.i: r.rnk for r in got} == want
    stats = ct.order_statistics(spark.createDataFrame(rows, "k string, v int, i int"), "k", "v", {"p50": None, "p95": 0.95}).collect()
    for r in stats:
        s = sorted(v for k, v, _ in rows if k == r.k)
        assert (r.p50, r.p95) == (s[len(s) // 2], s[min(len(s) - 1, int(len(s) * 0.95))])


def entries(spark):
    rows = [("e1", "x", "What is a tensor", 1, 3), ("e2", "x", "What is a tensor", 2, 3), ("e3", "x", "old", 1, -1), ("e4", "default", "What is a graph", 0, 3)]
    e = spark.createDataFrame([(a, b, c, v, day(d)) for a, b, c, v, d in rows], "entry_id string, corpus string, question string, corpus_version int, expires_at timestamp")
    return e.withColumn("vector", hash_embedding(F.col("question"))).withColumn("hit_count", F.lit(0)).withColumn("answer", F.lit("stored"))


def test_cache(spark):
    q = spark.createDataFrame([("a", "What is a tensor", "x", 1), ("b", "old", "x", 1), ("c", "What is a graph", None, 0), ("d", "What is a tensor", "x", 9)], "qid string, question string, corpus string, version int").withColumn("vector", hash_embedding(F.col("question")))
    got = {r.qid: (r.entry_id, r.hit) for r in cache.lookup(q, entries(spark), now()).collect()}
    assert got["a"] == ("e1", True) and got["c"] == ("e4", True) and got["d"] == (None, False) and not got["b"][1]
    looked = cache.lookup(q, entries(spark), now())
    assert cache.stats(entries(spark), looked, now()).first().asDict() == {"entries": 3, "hits": 2, "misses": 2, "hit_rate": 0.5}
    assert {r.entry_id: r.hit_count for r in cache.count_hits(entries(spark), looked).collect()} == {"e1": 1, "e2": 0, "e3": 0, "e4": 1}
    bad = spark.createDataFrame([("z", "x", "What is a tensor")], "qid string, corpus string, q string").withColumn("vector", hash_embedding(F.col("q")))
    assert {r.entry_id for r in cache.evict(entries(spark), bad).collect()} == {"e3", "e4"}


def test_prior_question_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(f"m{i:03d}", f"c{rng.randint(0, 2) if i % 2 else 0}", rng.choice(["user", "assistant"]), f"t{i}", day(0, rng.randint(0, 30))) for i in range(150)]
    m = spark.createDataFrame(rows, "message_id string, conversation_id string, role string, content string, created_at timestamp")
    got = {r.message_id: r.question_id for r in cv.prior_questions(m, 3600 * 4).collect()}
    for mid, conv, role, _, at in rows:
        earlier = [(a, i) for i, c, r, _, a in rows if c == conv and r == "user" and a <= at and i != mid]
        assert got[mid] == (mid if role == "user" else max(earlier)[1] if earlier else None)


def test_history_and_feedback(spark):
    m = spark.createDataFrame([(f"m{i:02d}", "c", "user" if i % 2 else "tool" if i == 18 else "assistant", " " if i == 15 else f"t{i}", day(0, i)) for i in range(20)],
                              "message_id string, conversation_id string, role string, content string, created_at timestamp")
    assert [t.content for t in cv.history(m).first().turns] == ["t12", "t13", "t14", "t16", "t17", "t19"]
    fb = spark.createDataFrame([("m1", 1, "a", day(0)), ("m1", -1, "b", day(1)), ("m2", 1, "c", day(0))], "message_id string, rating int, note string, created_at timestamp")
    latest = cv.latest_feedback(fb)
    assert {r.message_id: r.rating for r in latest.collect()} == {"m1": -1, "m2": 1}
    assert cv.feedback_totals(latest).first().asDict() == {"total": 2, "up": 1, "down": 1}


def test_reorg_policy_and_run(spark, tiny):
    cases = [("batch", 0, day(0), True), ("debounced", 2, day(0), False), ("debounced", 3, day(0), True), ("debounced", 0, day(-2), True),
             ("nightly", 9, day(0), False), ("nightly", 0, day(-1), True), ("nightly", 0, None, True)]
    rows = spark.createDataFrame([c[:3] for c in cases], "p string, n int, last timestamp")
    assert [r.run for r in rows.select(ct.should_run(F.col("p"), F.col("n"), F.col("last"), now()).alias("run")).collect()] == [c[3] for c in cases]
    jobs = spark.createDataFrame([("j", "done", day(-1))], "job_id string, status string, created_at timestamp")
    none = spark.createDataFrame([], "run_at timestamp")
    fresh, log = reorganize.run(tiny.graph, tiny.document_meta, jobs, none, None, now())
    first = log.first()
    assert first.ran and first.docs_since == 3 and first.summaries_made == first.communities_after == fresh.count()
    again, log2 = reorganize.run(tiny.graph, tiny.document_meta, jobs, log.select("run_at"), fresh, now())
    assert again is None and not log2.first().ran
    third = reorganize.refresh(tiny.graph, fresh)
    assert third.filter("made").isEmpty()
    q = spark.createDataFrame([("1", "what about nehru"), ("2", "zebra")], "qid string, question string")
    told = overview.global_answers(q, fresh).collect()
    assert [r.qid for r in told] == ["1"] and "[" in told[0].answer and told[0].tokens_in > 0


def test_contradictions(spark):
    h = spark.createDataFrame([("q", 1, "c1", [1.0, 0.0]), ("q", 2, "c2", [0.8, 0.6]), ("q", 3, "c3", [0.0, -1.0]), ("r", 1, "c1", [1.0, 0.0]), ("r", 2, "c3", [0.0, 1.0]), ("s", 1, "c1", [1.0, 0.0])],
                              "qid string, rnk int, chunk_id string, vector array<double>")
    pairs = contradictions.candidate_pairs(h)
    assert {(r.qid, r.a, r.b) for r in pairs.collect()} == {("q", "c1", "c2"), ("r", "c1", "c3")}
    texts = spark.createDataFrame([("c1", "a"), ("c2", "b"), ("c3", "c")], "chunk_id string, text string")
    known = spark.createDataFrame([("c3", "c1")], "a string, b string")
    alerts, new = contradictions.scan(pairs, known, texts, lambda d: d.withColumn("contradicts", F.lit(True)).withColumn("reason", F.lit("model")))
    assert {r.qid: r.reason for r in alerts.collect()} == {"q": "model", "r": "previously detected"} and [(r.a, r.b) for r in new.collect()] == [("c1", "c2")]


def test_metrics(spark):
    v = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, False), ("b", 2, True), ("c", 1, False)], "qid string, rnk int, useful boolean")
    assert {r.qid: r.score for r in ev.context_precision(v).collect()} == {"a": 1.0, "b": 0.5, "c": 0.0}
    a = spark.createDataFrame([("x", "Answer [1] and [2].", 3), ("y", "Answer [1] and [9].", 1), ("z", "none", 1)], "qid string, answer string, n_sources int")
    assert {r.qid: r.score for r in ev.citation_correctness(a).collect()} == {"x": 1.0, "y": 0.5, "z": 0.0}
    ans = spark.createDataFrame([("x", "The sky is blue. Cows eat grass.", "The sky is blue."), ("y", " ", ""), ("z", "No", "Ok")], "qid string, answer string, ground_truth string")
    ctx = spark.createDataFrame([("x", 1, "the sky is blue. today")], "qid string, rnk int, text string")
    assert {r.qid: r.score for r in ev.faithfulness(ans, ctx, contains_claim).collect()} == {"x": 0.5, "y": 0.0, "z": 1.0}
    assert {r.qid: r.score for r in ev.context_recall(ans, ctx, contains_claim).collect()} == {"x": 1.0, "y": 0.0, "z": 0.0}
    report = spark.createDataFrame([("c", "faithfulness", 0.5), ("c", "context_precision", 0.9), ("c", "cost_usd", 0.0)], "config string, metric string, score double")
    assert [r.metric for r in ev.breaches(report).collect()] == ["faithfulness"]


def test_catalog(spark):
    v = ct.bump(spark.createDataFrame([("x", 1)], "corpus string, version int"), spark.createDataFrame([("x",), ("x",), ("y",)], "corpus string"))
    assert {r.corpus: r.version for r in ct.current_versions(v).collect()} == {"x": 2, "y": 1}
    up = spark.createDataFrame([("1", 1, "h"), ("2", 2, "h"), ("3", 3, "g")], "doc_id string, seq long, content_hash string")
    assert {r.doc_id for r in docs.first_copies(up).collect()} == {"1", "3"}
    assert {r.doc_id for r in docs.new_documents(up, spark.createDataFrame([("h",)], "content_hash string")).collect()} == {"3"}
    cost = ct.with_cost(spark.createDataFrame([("llama-3.1-8b-instant", 1000000, 1000000), ("free", 5, 5)], "model string, tokens_in long, tokens_out long"), ct.price_table(spark))
    assert {r.model: round(r.cost_usd, 6) for r in cost.collect()} == {"llama-3.1-8b-instant": 0.13, "free": 0.0}


def test_models(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0)], "t string, n int")
    out = {r.t: (r.half, r.error) for r in model_map(df, "half double", lambda row, m: {"half": m / row["n"]}, load=lambda: 1.0, tasks=2).collect()}
    assert out["a"] == (1.0, None) and out["b"][0] is None and out["b"][1].startswith("ZeroDivisionError")
    emb = batch_embedder(lambda: 2.0, lambda m, ts: [[m, len(t)] for t in ts])
    assert df.select(emb(F.col("t")).alias("v")).first().v == [2.0, 1.0]
    sc = pair_scorer(lambda: None, lambda m, ps: [len(a) + len(b) for a, b in ps])
    assert df.select(sc(F.col("t"), F.lit("xyz")).alias("s")).first().s == 4.0


def test_files_and_stream(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    (box / "one.txt").write_bytes("Gandhi met Nehru in Delhi. \xff".encode("latin-1"))
    (box / "two.md").write_text("Patel wrote to Nehru.")
    (box / "copy.txt").write_text("Patel wrote to Nehru.")
    (box / "empty.txt").write_text("  ")
    (box / "bad.exe").write_text("x")
    ok, bad = files.read_files(spark, str(box))
    assert ok.count() == 4 and [r.reason.split(":")[0] for r in bad.collect()] == ["Unsupported file type"]
    rows = files.document_rows(ok, "x", "job")
    by = {r.title: r for r in rows.collect()}
    assert by["one"].text.endswith("�") and by["empty"].extraction_status == "empty" and by["two"].format == "md"

    root = str(tmp_path / "lib")
    stream = files.document_rows(si.file_stream(spark, str(box), 2).withColumn("format", files.infer_format(F.col("path"))).filter("format is not null"), "x", "job")
    si.ingest_stream(stream, root).awaitTermination()
    stored = spark.read.parquet(f"{root}/documents")
    assert stored.count() == 3 and spark.read.parquet(f"{root}/passages").count() == 2
    assert {r.canonical for r in spark.read.parquet(f"{root}/mentions").collect()} == {"gandhi", "nehru", "delhi", "patel"}
    before = si.versions(spark, root).first().version
    # a batch that runs again writes the same rows once more under its own id
    si.ingest_batch(files.document_rows(ok, "x", "job"), 0, str(tmp_path / "again"))
    si.ingest_batch(files.document_rows(ok, "x", "job"), 0, str(tmp_path / "again"))
    si.ingest_batch(files.document_rows(ok, "x", "job"), 1, str(tmp_path / "again"))
    assert spark.read.parquet(str(tmp_path / "again" / "documents")).count() == 3
    assert si.versions(spark, str(tmp_path / "again")).first().version == 1 and before >= 1


def test_ask(spark, tiny):
    q = spark.createDataFrame([("1", "What is a tensor", "x", "c1"), ("2", "Who met Nehru in Delhi", None, "c1"), ("3", "hi", None, "c1"), ("4", "Compare Patel and Bose", None, None)],
                              "qid string, question string, corpus string, conversation_id string")
    versions = spark.createDataFrame([("x", 1)], "corpus string, version int")
    stored = entries(spark).withColumn("sources", F.lit('[{"n":1}]')).withColumn("citations", F.lit("[1]"))
    out = ask.answer(tiny, q, versions, stored, now())
    by = {r.qid: r for r in out.answers.collect()}
    assert by["1"].cached and by["1"].answer == "stored" and by["3"].lane == "fast" and by["4"].lane == "deep"
    assert by["2"].grounded and by["2"].answer.endswith("[1]") and by["2"].cost_usd > 0
    assert {r.entry_id for r in out.cache_entries.collect()} == {"2", "4"}
    assert {r["mode"] for r in by.values()} == {"cache", "chat", "retrieval"} and out.alerts.count() == 0
    assert by["3"].answer and by["1"].sources == '[{"n":1}]' and by["1"].citations == "[1]"
    said = out.messages.collect()
    assert len(said) == 8 and {r.conversation_id for r in said} == {"c1", "conv-4"}
