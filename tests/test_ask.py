"""Whole answers: history in prompts, questions about the whole library, pictures, contradicting sources, image files."""

import base64

import pytest
from pyspark.sql import functions as F

from bookloom.operators import graph_query as gq
from bookloom.operators import images as im
from bookloom.plans import ask
from bookloom.sources import files
from bookloom.sources.library import Library

PNG = b"\x89PNG\r\n\x1a\n" + bytes(range(60))
ASKED = "qid string, question string, corpus string, conversation_id string, image string"


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    """Two texts, two pictures and a file that is neither, read from a folder."""
    box = tmp_path_factory.mktemp("box")
    (box / "tower.png").write_bytes(PNG)
    (box / "bridge.JPEG").write_bytes(PNG[::-1])
    (box / "india.txt").write_text("Gandhi met Nehru in Delhi. Nehru wrote to Patel.")
    (box / "other.txt").write_text("Patel led the talks with Bose in Delhi.")
    (box / "tool.exe").write_text("x")
    accepted, rejected = files.read_files(spark, str(box))
    rows = files.document_rows(accepted, "past", "job").selectExpr("*", "CAST(NULL AS ARRAY<STRING>) AS tags", "CAST(NULL AS STRING) AS author", "CAST(NULL AS TIMESTAMP) AS doc_date").cache()
    replies = {PNG: '{"caption": "The Eiffel Tower at night", "tags": ["paris", " "]}', PNG[::-1]: "Howrah Bridge over the Hooghly in Delhi"}
    describe = im.vision_model(lambda row, model: model[bytes(row["content"])], load=lambda: replies)
    assert rejected.count() == 1
    return Library(spark, rows, lambda: im.image_files(accepted, rows), describe=describe)


def asked(spark, *rows):
    return spark.createDataFrame(rows, ASKED)


def run(spark, library, questions, **more):
    none = spark.createDataFrame([], "corpus string, version int")
    entries = spark.createDataFrame([], "entry_id string, corpus string, question string, vector array<float>, answer string, sources string, citations string, corpus_version int, hit_count int, created_at timestamp, expires_at timestamp")
    return ask.answer(library, questions, none, entries, F.timestamp_seconds(F.lit(1_700_000_000)), **more)


def test_images_become_rows_and_edges(spark, library):
    by = {r.path.rsplit("/", 1)[1]: r for r in library.images.collect()}
    assert set(by) == {"tower.png", "bridge.JPEG"} and by["tower.png"].caption == "The Eiffel Tower at night" and by["tower.png"].tags == ["paris"]
    assert by["bridge.JPEG"].mime == "image/jpeg" and by["bridge.JPEG"].tags == [] and len(by["tower.png"].vector) == library.dim
    assert library.image_errors.count() == 0
    g = library.graph
    assert {r.canonical for r in g.depicts.collect()} >= {"eiffel", "tower", "howrah", "delhi"}
    names = {r.canonical: r.name for r in g.entities.collect()}
    assert names["howrah"] == "Howrah" and names["gandhi"] == "Gandhi"
    assert {r.label: r["count"] for r in gq.node_counts(g).collect()}["Image"] == 2
    nodes, edges = gq.vault_graph(g)
    assert nodes.filter("label = 'Image'").count() == 2 and {r.target for r in edges.filter("kind = 'DEPICTS'").collect()} == {"Delhi"}
    assert gq.library_graph(g)[0].filter("label = 'Image'").count() == 2
    path = gq.shortest_paths(g, spark.createDataFrame([("q", "Howrah", "Gandhi")], "qid string, source string, target string")).collect()
    assert path and path[0].hops >= 2 and path[0].kinds[0] == "DEPICTS"


def test_a_failing_model_leaves_an_image_without_caption(spark, library):
    def refuse(row):
        raise ValueError("no")

    rows = im.image_table(library.image_files, im.vision_model(refuse)).collect()
    assert len(rows) == 2 and all(r.caption == "" and r.tags == [] and r.error.startswith("ValueError") for r in rows)


def test_files_without_bytes_are_no_images(spark):
    rows = spark.createDataFrame([("i", "d", "c", "/a.png", bytearray()), ("j", "e", "c", "/b.gif", None), ("k", "f", "c", "/c.gif", bytearray(b"x"))], "image_id string, doc_id string, corpus string, path string, content binary")
    assert [r.image_id for r in im.image_table(rows).collect()] == ["k"] and im.image_table(rows).first().mime == "image/gif"
    assert sorted((r.doc_id, r.error) for r in im.quarantined(rows).collect()) == [("d", "Empty file: /a.png"), ("e", "Empty file: /b.gif")]


def test_sweep_takes_images_of_lost_documents(spark, library):
    from dataclasses import replace

    g = library.graph
    left = gq.sweep_orphans(replace(g, documents=g.documents.filter("title <> 'bridge'")))
    assert left.images.count() == 1 and "howrah" not in {r.canonical for r in left.entities.collect()}


def test_picture_question(spark, library):
    url = "data:image/png;base64," + base64.b64encode(PNG).decode()
    seen = []
    q = asked(spark, ("1", "What is shown here?", None, None, url), ("2", "And here, in the picture?", None, None, "data:broken"))
    out = run(spark, library, q, generate=lambda df: seen.append(df.select("qid", "user_text").collect()) or df.withColumn("answer", F.col("first_text")).withColumn("error", F.lit(None).cast("string")))
    by = {r.qid: r for r in out.answers.collect()}
    assert by["1"]["mode"] == "image" and by["1"].answer == "The Eiffel Tower at night" and by["2"].answer is None
    text = {r.qid: r.user_text for r in seen[0]}
    assert "IMAGES:" in text["1"] and "(image: tower) The Eiffel Tower at night tags=['paris']" in text["1"] and "IMAGES:" not in text["2"]
    assert {r.qid for r in out.lookups.collect()} == set() and out.cache_entries.count() == 0


def test_history_reaches_the_prompt(spark, library):
    log = spark.createDataFrame(
        [("m1", "c", "user", "Who met Nehru?", 1), ("m2", "c", "assistant", "Gandhi [1]", 2), ("m3", "c", "tool", "x", 3), ("m4", "d", "user", "other", 1)],
        "message_id string, conversation_id string, role string, content string, t long",
    ).selectExpr("message_id", "conversation_id", "role", "content", "timestamp_seconds(t) AS created_at")
    said = {}

    def generate(df):
        said.update({r.qid: r.turns for r in df.collect()})
        return df.withColumn("answer", F.lit("x")).withColumn("error", F.lit(None).cast("string"))

    run(spark, library, asked(spark, ("1", "Where did they meet Patel?", None, "c", None), ("2", "Who wrote to Patel?", None, None, None)), messages=log, generate=generate).answers.collect()
    assert [(t.role, t.content) for t in said["1"]] == [("user", "Who met Nehru?"), ("assistant", "Gandhi [1]")] and said["2"] == []


def test_question_about_the_whole_library(spark, library):
    communities = spark.createDataFrame([("c0", "People of the themes of independence", 5, ["gandhi"]), ("c1", "Weather", 2, ["rain"])], "cid string, summary string, entity_count long, members array<string>")
    question = "What are the main themes across the whole library?"
    q = asked(spark, ("1", question, None, None, None), ("2", "Who met Nehru in Delhi?", None, None, None))
    assert [r.whole_library for r in ask.route(q).orderBy("qid").collect()] == [True, False]
    routed = q.withColumn("mode", F.when(F.col("qid") == "1", "deep"))
    by = {r.qid: r for r in run(spark, library, routed, communities=communities).answers.collect()}
    assert by["1"]["mode"] == "global" and "independence" in by["1"].answer and '"community_id":"c0"' in by["1"].citations and "c1" not in by["1"].citations
    assert by["2"]["mode"] == "retrieval" and by["1"].tokens_in > 0 and by["1"].grounded
    nobody = communities.withColumn("summary", F.lit("xyz"))
    assert run(spark, library, routed, communities=nobody).answers.filter("qid = '1'").first()["mode"] == "retrieval"


def test_contradicting_sources(spark, library):
    judge = lambda df: df.withColumn("contradicts", F.col("text_a") != F.col("text_b")).withColumn("reason", F.lit("they differ"))
    q = asked(spark, ("1", "Who met Nehru in Delhi?", None, None, None))
    out = run(spark, library, q, judge=judge)
    (alert,) = out.alerts.collect()
    (edge,) = out.contradictions.collect()
    assert alert.reason == "they differ" and {edge.a, edge.b} == {alert.a, alert.b}
    known = run(spark, library, q, known=out.contradictions)
    assert known.alerts.first().reason == "previously detected" and known.contradictions.count() == 0
