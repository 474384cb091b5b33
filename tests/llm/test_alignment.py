import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from bookloom.llm import alignment
from tests.llm.helpers import SMALL, empty, odd_documents

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(alignment.BYTE_MODEL)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=alignment.PIECE_MODEL)


def ends_of(both, text):
    """(id, end) of every token of either side, from the offsets and bytes the libraries decode; none if bytes are lost."""
    a, b = both
    whole = f" {text}"
    # the byte-level alphabet, from the decoder: what each token alone decodes to, byte by byte
    alphabet = alignment.byte_alphabet()
    left = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(whole, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode()) for i in b.encode(text)]
    out = []
    for side in (left, right):
        if not text or b"".join(x for _, x in side) != whole.encode():
            return [], []
        at, ends = 0, []
        for i, x in side:
            at += len(x)
            ends.append((i, at))
        out.append(ends)
    return out


def brute(both, rows):
    found, count = [], Counter()
    for doc, text in rows:
        a, b = ends_of(both, text or "")
        links = [(i, j) for i, e in a for j, f in b if e == f] if len(a) < 500 else [(i, dict((f, j) for j, f in b)[e]) for i, e in a if e in {f for _, f in b}]
        count.update(links)
        groups, last = [], 0
        for e in sorted({e for _, e in a} & {e for _, e in b}):
            groups.append(",".join(str(i) for i, f in a if last < f <= e) + "|" + ",".join(str(i) for i, f in b if last < f <= e))
            last = e
        found.append((doc, len(a), len(b), groups, links))
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return sorted((
        (doc, n_a, n_b, len(g), len(li), sum(count[x] == most[x[1]] for x in li), sum(count[x] for x in li), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for doc, n_a, n_b, g, li in found
    ), key=str)


def got(df):
    out = alignment.report(df, alignment.read_models(df.sparkSession))
    return sorted((tuple(r) for r in out.select(*COLUMNS).collect()), key=str)


TEXTS = [
    "Hello world", "Hello  world", " lead", "<|endoftext|> and <s> </s> <unk> <0x41>", "caf\u00e9 na\u00efve \u4f60\u597d \U0001f600\u200d!", "\u2581mark \u2581", "tab\tline\nend\r\n", "a", "", None,
    "x" * 300, "\u00a0\u3000 wide", "0123 4567 89,000.00", "nul\x00nul", "e\u0301 combining", "\ufeffbom", "Hello world", "Hello there world",
]


def test_matches_brute_force(spark, both, monkeypatch):
    rows = [(i // 2 if i % 5 else None, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(both, rows)
    assert got(df) == want
    monkeypatch.setattr(alignment, "MAX_PAIRS", 0)
    assert got(df) == want
    monkeypatch.setattr(alignment, "SLICE_BYTES", 1)
    assert got(df) == want


def test_given_documents(spark, both):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) < 1500")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    out = got(df)
    assert out == brute(both, rows)
    assert sum(r[3] for r in out) > 1000


def test_odd_rows_and_empty_tables(spark, both):
    df = odd_documents(spark).selectExpr("*", "1 AS row", "2 AS link_a", "3 AS groups", "4 AS a", "5 AS n")
    out = got(df)
    assert len(out) == df.count()
    assert [r[1:] for r in out if r[0] == 2] == [(0, 0, 0, 0, 0, 0, "")] == [r[1:] for r in out if r[0] == 3]
    long = next(r for r in out if r[0] == 5)
    assert long[1] > 60_000 and long[3] == long[4] > 30_000
    assert got(empty(df)) == []


def test_text_without_white_space(spark):
    df = spark.createDataFrame([(1, "abcdefghij" * 20_000)], "doc_id long, text string")
    (row,) = got(df)
    assert row[3] >= 1 and row[1] > 10_000


def test_ranks_give_the_ids_of_the_merge_list(spark, both):
    """Any mixture of plain characters, and of others, is encoded as by the merge list."""
    a, b = both
    encoders = alignment.read_models(spark).encoders()
    assert encoders.ranked
    rnd = random.Random(5)
    plain = [chr(c) for c in (9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250))]
    spaces = " \n\t\r'"
    texts = []
    for n in range(3000):
        pool = plain if n % 3 else ["a", "b", "s", "t", "'", "'ll", "1", ".", "\u2581", "\u4e00", "\xa0", "\x1c", "\x85"]
        text = "".join(rnd.choice(spaces) if rnd.random() < 0.3 else rnd.choice(pool) for _ in range(rnd.randint(1, 40)))
        texts.append(text)
    for text, got in zip(texts, encoders.encode(texts), strict=True):
        left, right = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        held = b"".join(encoders.b_bytes[i] for i in right) == (" " + text).encode()
        assert got == ((left, right) if held else ([], [])), repr(text)


def test_groups_are_the_ids(spark, both):
    a, b = both
    models = alignment.read_models(spark)
    df = alignment.align(spark.createDataFrame([(1, "Tokenizers disagree, sometimes.")], "doc_id long, text string"), models)
    row = df.withColumn("groups", alignment.parsed(df.groups)).first()
    assert [i for g in row["groups"] for i in g["a"]] == a.encode(" Tokenizers disagree, sometimes.").ids
    assert [i for g in row["groups"] for i in g["b"]] == b.encode("Tokenizers disagree, sometimes.")
    assert row["link_a"] == [g["a"][-1] for g in row["groups"]] and row["link_b"] == [g["b"][-1] for g in row["groups"]]


def test_tokens_without_bytes():
    """Tokens of no bytes end with the token before them, and each of them is linked."""
    a, a_ends, b, b_ends = np.array([1, 2, 3]), np.array([2, 2, 5]), np.array([7, 8, 9]), np.array([2, 5, 5])
    a_cut, b_cut = alignment.cuts(a_ends.tolist(), b_ends.tolist())
    assert (a_cut.tolist(), b_cut.tolist()) == ([2, 3], [1, 3])
    left, right = alignment.linked(a, a_ends, a_cut, b, b_ends, b_cut)
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == [(1, 7), (2, 7), (3, 8), (3, 9)]


def test_links_are_counted_in_slices(monkeypatch):
    rng, n, k = np.random.default_rng(1), 1000, 1000
    flat = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(rng.integers(0, m, n * k, dtype=np.int32)))
    batch = pa.RecordBatch.from_arrays([flat(40), flat(30)], names=["link_a", "link_b"])
    held, pairs_of = [], alignment.pairs_of
    monkeypatch.setattr(alignment, "pairs_of", lambda b: held.append(pairs_of(b)) or held[-1])
    parts = [p.to_pydict() for p in alignment.part_counts(iter([batch, batch]))]
    pair, count = np.unique(pairs_of(batch), return_counts=True)
    assert parts == [{"pair": pair.tolist(), "n": (2 * count).tolist()}]
    assert sum(map(len, held)) == 2 * n * k and max(map(len, held)) <= alignment.SLICE_LINKS < n * k
