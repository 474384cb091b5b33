from pyspark.sql import functions as F

from bookloom.functions import entities as ent
from bookloom.functions import questions as qs
from bookloom.functions import text as tx
from bookloom.functions.vectors import cosine, hash_embedding
from bookloom.sources import files


def test_canonical_names(one):
    for raw in ("Neo4j", "  neo4j  ", "Neo4j,", "Neo4j."):
        assert one(ent.canonical(F.col("n")), n=raw) == "neo4j"
    assert one(ent.canonical(F.col("n")), n="  C++ ") == "c++"
    assert one(ent.canonical(F.col("n")), n="multi   word Name") == "multi word name"


def test_phrases(one):
    got = one(ent.phrases(F.col("t")), t="Mahatma Gandhi led the march. Gandhi met Nehru in Delhi. The Élan x_Foo Bar2 Baré")
    assert got == ["Mahatma Gandhi", "Gandhi", "Nehru", "Delhi"]


def test_caption_entities(one):
    assert one(ent.caption_entities(F.col("t")), t="The Photo of Paris and Rome") == ["Paris", "Rome"]


def test_windows(one):
    got = one(ent.text_windows(F.col("t"), 3, 4), t="abcdefghijkl")
    assert got == ["abcd", "efgh", "ijkl"] and one(ent.text_windows(F.col("t"), 3, 40), t="abc") == ["abc"]


def test_lanes(one):
    cases = {
        "hi": "fast", "Thank you!": "fast", "quantum": "fast", "how are you?": "fast", "Answer with no retrieval please": "fast",
        "don’t search the library for this one": "fast", "Compare Hobbes and Locke": "deep", "What are the main themes here?": "deep",
        "how does entropy relate to information": "deep", "What is the capital of France?": "standard",
    }
    for question, expected in cases.items():
        assert one(qs.lane(F.col("q")), q=question) == expected, question
    assert one(qs.lane(F.col("q"), F.lit(True), F.lit("deep")), q="hi there friend") == "standard"
    assert one(qs.lane(F.col("q"), None, F.lit("deep")), q="hi") == "deep"


def test_guard(one):
    ask = lambda a, b: one(qs.too_different(F.col("a"), F.col("b")), a=a, b=b)
    q = "Do Hobbes and Locke agree on the state of nature"
    assert ask(q, "Do Hobbes and Rousseau agree on the state of nature")
    assert not ask(q, q) and not ask(q, q + "?")
    assert ask("What is the state of nature", "What is the meaning of life") and ask("", "x")


def test_metadata(one):
    assert one(qs.year_range(F.col("q")), q="the 2024 policy").asDict() == {"date_from": "2024-01-01", "date_to": "2024-12-31"}
    assert one(qs.year_range(F.col("q")), q="code 12024 x") is None
    schema = "tags array<string>, date_from string, date_to string, author string"
    reply = '```json\n{"tags": [" ML ", "", "a"], "date_from": "2024-01-01", "date_to": "soon", "author": " Ada "}\n```'
    got = one(qs.clean_metadata(qs.lenient_json(F.col("t"), schema)), t=reply)
    assert got.tags == ["ml", "a"] and got.date_from == "2024-01-01" and got.date_to is None and got.author == "Ada"
    assert one(qs.lenient_json(F.col("t"), schema), t="no json") is None


def test_image_description(one):
    got = one(qs.image_description(F.col("t")), t='{"caption": " A cat ", "tags": ["x", " ", "y"]}')
    assert got.caption == "A cat" and got.tags == ["x", "y"]
    assert one(qs.image_description(F.col("t")), t=" just words ").caption == "just words"


def test_small_texts(one):
    assert one(tx.citation_markers(F.col("t")), t="a [1] b [2][1] [1234]") == [1, 2]
    assert one(tx.claims(F.col("t")), t="Ok. This is a claim. No!") == ["This is a claim."]
    got = one(tx.data_url(F.col("t")), t="data:image/png;base64,aGk=")
    assert got.mime == "image/png" and bytes(got.bytes) == b"hi" and one(tx.data_url(F.col("t")), t="x") is None
    assert one(tx.token_estimate(F.col("t")), t="abc") == 1 and one(tx.word_count(F.col("t")), t=" a  b ") == 2


def test_formats(one):
    assert one(files.infer_format(F.col("p")), p="/a.b/C.MARKDOWN") == "md" and one(files.infer_format(F.col("p")), p="x.exe") is None
    assert one(files.image_mime(F.col("p")), p="a.gif") == "image/gif" and one(files.file_mime(F.col("p")), p="a.gif") == "application/octet-stream"


def test_vectors(one):
    v = one(hash_embedding(F.lit("abc"), 40))
    import hashlib

    raw = [b / 255 for b in (hashlib.sha256(b"abc").digest() * 2)[:40]]
    n = sum(x * x for x in raw) ** 0.5
    assert max(abs(a - b / n) for a, b in zip(v, raw)) < 1e-12
    arr = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert abs(one(cosine(arr(1, 0), arr(1, 1))) - 0.5**0.5) < 1e-12
    assert one(cosine(arr(1, 0), arr(1))) == 0 and one(cosine(arr(0, 0), arr(1, 1))) == 0
