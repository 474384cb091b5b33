import random
import re

from pyspark.sql import functions as F

from bookloom.functions.chunking import chunk_into_parents, chunk_text, passages
from bookloom.functions.text import paragraphs


def plain_sentences(t):
    return [p.strip() for p in re.split(r"(?<=[.!?])\s+", t) if p.strip()]


def plain_pack(units, limit, glue):
    out = []
    for u in units:
        if out and len(out[-1]) + len(u) + len(glue) <= limit:
            out[-1] += glue + u
        else:
            out.append(u)
    return out


def plain_chunks(text, size, overlap, paras):
    """Brute force over the paragraph list of an already clean text."""
    if len(text) <= size:
        return [text] if text else []
    units = []
    for p in paras:
        s = plain_sentences(p)
        units += [p] if len(p) <= size or len(s) <= 1 else plain_pack(s, size, " ")
    out, tail = [], ""
    for u in plain_pack(units, size, "\n\n"):
        piece = tail + u
        rest = piece[max(len(piece) - overlap, 0):] if overlap else ""
        tail = plain_sentences(rest)[0] + " " if len(piece) > size and rest else ""
        out.append(piece)
    return out


def run(one, text, size, overlap=0):
    return one(chunk_text(F.col("t"), size, overlap), t=text)


def test_short_and_blank(one):
    assert run(one, "hello world", 900) == ["hello world"]
    assert run(one, "", 900) == [] and run(one, "   ", 900) == []


def test_sentences_stay_whole(one):
    got = run(one, "A short sentence. " * 60, 30)
    assert len(got) >= 3 and all(c.endswith(".") for c in got)


def test_no_sentence_end_is_one_chunk(one):
    assert len(run(one, " ".join(f"word{i}" for i in range(200)), 200)) == 1


def test_parents_keep_paragraphs(one):
    text = "\n\n".join(f"Paragraph {i}. content of the paragraph goes on and on here." for i in range(10))
    got = one(chunk_into_parents(F.col("t"), 300), t=text)
    assert got[0].startswith("Paragraph 0") and "Paragraph 9" in got[-1] and len(got) > 1
    assert "\n\n".join(got) == text


def test_reflow(one):
    assert one(paragraphs(F.col("t")), t="A.\nB\nC d\n\n  \n\nx") == ["A.B C d", "x"]


def test_random_texts_match_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(120):
        paras = [" ".join("w" * rng.randint(1, 9) + rng.choice(["", "", "", ".", "!", "?"]) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 6))]
        texts.append("\n\n".join(paras))
    for size, overlap in ((80, 20), (40, 60), (200, 0)):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
            "i", chunk_text(F.col("t"), size, overlap).alias("c"), paragraphs(F.col("t")).alias("p")
        ).collect()
        for r in rows:
            assert r.c == plain_chunks(texts[r.i], size, overlap, r.p), (size, overlap, texts[r.i])


def test_passages_index_children(spark):
    text = "\n\n".join(f"Section {i}. " + "Some words that fill the section. " * 8 for i in range(6))
    row = spark.createDataFrame([(text,)], "t string").select(F.posexplode(passages(F.col("t"), 500, 200, 40)).alias("i", "p")).collect()
    parents = {r.p.parent_pos: r.p.parent_text for r in row if r.p.child_pos == 0}
    assert [r.i for r in row] == list(range(len(row))) and sorted(parents) == list(range(len(parents)))
    for r in row:
        assert r.p.text[-40:] in parents[r.p.parent_pos]
