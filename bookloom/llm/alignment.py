"""Alignment of the token streams of two tokenizers over the same bytes, and the id pairs it links.

A byte-level vocabulary (A) and a piece vocabulary (B) encode each text after one space. The cumulative byte ends of either
stream become a dictionary from end to index; the intersection of the two key sets, sorted, cuts both id lists into groups that
cover the same bytes. Within each slice the tokens that end where the slice ends are linked, A with B. Counts of linked id pairs
over the whole corpus combine per task, then in a shuffle by pair; no key is hot by then. The counts go back to the documents as
one sorted broadcast while there are at most MAX_PAIRS of them, which is checked; beyond that by a join on the pair.

Defined results: a text that is null or empty, or that either tokenizer does not give back byte by byte, has no tokens: no
groups, no links, zeros. Strings of special tokens are plain text. Very long texts are encoded whole, one at a time. Null or
repeated ``doc_id`` and repeated rows count each time; of equally frequent partners of a B id all are its best. An empty table
gives no row; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bookloom.llm.arrays import batch_of, collected
from bookloom.session import cut, scratch_path

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_MODEL_BYTES = 64 << 20
MAX_PAIRS = 4_000_000  # 17 bytes each
SLICE_BYTES = 256 << 10  # of text encoded at once; a longer text is a slice of its own
SLICE_LINKS = 500_000  # links held as numbers at once; a document with more is a slice of its own
MARK = "▁"
PLAIN = re.compile("[\\t\\n\\r -~\u00a1-\u024f]*")  # letters, digits and marks that no version of Unicode has changed
WORD = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed value


def byte_alphabet() -> dict[str, int]:
    """The character of each byte in a byte-level vocabulary: itself if it prints, else the next one from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Encoders:
    """Both tokenizers and the bytes of their ids.

    A goes through its vocabulary as ranks, several times as fast as its merge list, if that is known to give the same ids: an id
    is the rank of its merge, and each token, taken alone, merges into itself. For neighbours that ranks would join and the merge
    list would not would be stuck in the token they spell as well. Texts with characters beyond PLAIN, about which two versions of
    Unicode might differ, go through the merge list.
    """

    def __init__(self, byte_model: bytes, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given the other cores to other tasks
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_model.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=piece_model)
        alphabet, vocabulary = byte_alphabet(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = self.b.id_to_piece(list(range(self.b.get_piece_size())))
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        named = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        self.names = [named(len(self.a_bytes), ","), named(len(self.a_bytes), "|"), named(len(self.b_bytes), ","), named(len(self.b_bytes), ";")]
        spec = json.loads(byte_model)
        tokens, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        first = len(tokens) - len(merges)
        self.ranked = (
            spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and spec["normalizer"] is None
            and all(tokens.get(a + b) == first + i for i, (a, b) in enumerate(merges)) and all(len(t) == 1 for t, i in tokens.items() if i < first)
            and all([x.id for x in self.a.model.tokenize(t)] == [i] for t, i in tokens.items())
        )
        if self.ranked:
            ranks = {self.a_bytes[i]: i for i in tokens.values()}
            self.by_rank = Encoding("a", pat_str=WORD, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of either side for each text; none where bytes are lost."""
        full = [t for t in texts if t]
        found = []
        for t, b in zip(full, self.b.encode(full, num_threads=1), strict=True):
            whole = f" {t}"
            a = self.by_rank(whole) if self.ranked and PLAIN.fullmatch(whole) else self.a.encode(whole, add_special_tokens=False).ids
            raw = whole.encode()
            same = b"".join([self.a_bytes[i] for i in a]) == raw == b"".join([self.b_bytes[i] for i in b])
            found.append((a, b) if same else ([], []))
        nxt = iter(found)
        return [next(nxt) if t else ([], []) for t in texts]


class Models:
    """Broadcast vocabulary files; each Python worker builds its encoders once."""

    _built: dict[int, Encoders] = {}

    def __init__(self, broadcast, key: int):
        self.broadcast, self.key = broadcast, key

    def encoders(self) -> Encoders:
        if self.key not in self._built:
            self._built.clear()
            self._built[self.key] = Encoders(*self.broadcast.value)
        return self._built[self.key]


def read_models(spark: SparkSession, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> Models:
    """The vocabulary files, read by Spark and sent to every executor; their sizes are checked first."""
    contents = []
    for path in (byte_model, piece_model):
        file = spark.read.format("binaryFile").load(path)
        size = file.select("length").first()["length"]
        if size > MAX_MODEL_BYTES:
            raise ValueError(f"{path} holds {size} bytes; at most {MAX_MODEL_BYTES} are broadcast")
        contents.append(bytes(file.select("content").first()["content"]))
    return Models(spark.sparkContext.broadcast(tuple(contents)), hash(tuple(contents)))


def cuts(a_ends: list[int], b_ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and of B lie before each common end."""
    a_at = dict(zip(a_ends, range(1, len(a_ends) + 1), strict=True))  # of equal ends the last
    b_at = dict(zip(b_ends, range(1, len(b_ends) + 1), strict=True))
    common = sorted(a_at.keys() & b_at.keys())
    a_cut, b_cut = (np.array(list(map(at.__getitem__, common)), np.int64) for at in (a_at, b_at))
    return a_cut, b_cut


def linked(a: np.ndarray, a_ends: np.ndarray, a_cut: np.ndarray, b: np.ndarray, b_ends: np.ndarray, b_cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pairs of tokens that end together, slice by slice. Tokens without bytes end with the token before them."""
    if (np.diff(a_ends) > 0).all() and (np.diff(b_ends) > 0).all():  # one token of either side ends a slice
        return a[a_cut - 1], b[b_cut - 1]
    a_first, b_first = np.searchsorted(a_ends, a_ends[a_cut - 1]), np.searchsorted(b_ends, b_ends[b_cut - 1])
    a_n, b_n = a_cut - a_first, b_cut - b_first
    pairs = a_n * b_n
    within = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    return a[np.repeat(a_first, pairs) + within // np.repeat(b_n, pairs)], b[np.repeat(b_first, pairs) + within % np.repeat(b_n, pairs)]


def group_text(a: np.ndarray, a_cut: np.ndarray, b: np.ndarray, b_cut: np.ndarray, names: list[np.ndarray]) -> str:
    """``a1,a2|b1;a3|b2,b3``: every id with the mark that follows it, put at its place among the ids of both sides."""
    out = np.empty(len(a) + len(b), object)
    a_group, b_group = np.searchsorted(a_cut, np.arange(len(a)), "right"), np.searchsorted(b_cut, np.arange(len(b)), "right")
    before = np.concatenate([[0], b_cut])[a_group]
    out[np.arange(len(a)) + before] = names[0][a]
    out[a_cut - 1 + np.concatenate([[0], b_cut[:-1]])] = names[1][a[a_cut - 1]]
    out[np.arange(len(b)) + a_cut[b_group]] = names[2][b]
    out[b_cut - 1 + a_cut] = names[3][b[b_cut - 1]]
    return "".join(out.tolist())[:-1]


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, groups string, link_a array<int>, link_b array<int>"


def align(docs: DataFrame, models: Models) -> DataFrame:
    """``row, doc_id, n_a, n_b, n_groups, groups, link_a, link_b`` of each document: the ids of either tokenizer in groups of equal
    bytes, as text like ``a1,a2|b1;a3|b2,b3``, and the ids of linked tokens. ``row`` tells rows apart."""

    def aligned(both: Encoders, a: list[int], b: list[int]) -> tuple:
        if not a:
            none = np.zeros(0, np.int64)
            return 0, 0, 0, "", none, none
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(both.a_size[a]), np.cumsum(both.b_size[b])
        a_cut, b_cut = cuts(a_ends.tolist(), b_ends.tolist())
        return len(a), len(b), len(a_cut), group_text(a, a_cut, b, b_cut, both.names), *linked(a, a_ends, a_cut, b, b_ends, b_cut)

    def lists(parts: list[np.ndarray]) -> pa.Array:
        flat = np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = models.encoders()
        for batch in batches:
            for part in runs_of(batch, SLICE_BYTES):
                found = [aligned(both, a, b) for a, b in both.encode(part.column("text").to_pylist())]
                n_a, n_b, n_groups, groups, link_a, link_b = map(list, zip(*found, strict=True))
                counts = [pa.array(n, pa.int64()) for n in (n_a, n_b, n_groups)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), *counts, pa.array(groups, pa.string()), lists(link_a), lists(link_b)],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "groups", "link_a", "link_b"],
                )
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, ALIGNED)


def runs_of(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``size`` bytes of text, or one row."""
    return cut_up(batch, pa.compute.binary_length(batch.column("text").cast(pa.large_string()).fill_null("")), size)


def links_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``SLICE_LINKS`` links, or one row."""
    return cut_up(batch, batch.column("link_a").value_lengths(), SLICE_LINKS)


def cut_up(batch: pa.RecordBatch, lengths: pa.Array, size: int) -> Iterator[pa.RecordBatch]:
    upto, i = np.concatenate([[0], np.cumsum(lengths.to_numpy(zero_copy_only=False), dtype=np.int64)]), 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + size, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def parsed(groups: Column) -> Column:
    """The text of groups as ``array<struct<a: array<int>, b: array<int>>>``."""
    side = lambda text, i: F.split(F.get(F.split(text, r"\|"), i), ",").cast("array<int>")
    cut_up = F.transform(F.split(groups, ";"), lambda g: F.struct(side(g, 0).alias("a"), side(g, 1).alias("b")))
    return F.when(groups == "", F.array().cast("array<struct<a:array<int>,b:array<int>>>")).otherwise(cut_up)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``a, b, n, best``: how often the corpus links two ids, and whether no other A id is linked with this B id more often."""

    part = rows.select("link_a", "link_b").mapInArrow(part_counts, "pair long, n long")
    counts = part.groupBy("pair").agg(F.sum("n").alias("n")).select(F.expr("int(pair >> 32)").alias("a"), F.expr("int(pair & 4294967295)").alias("b"), "n")
    counts = cut(counts)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def part_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``pair, n`` of a task, counted slice by slice; the counts of several slices combine before they leave the task."""

    def counts() -> Iterator[dict[str, np.ndarray]]:
        for batch in batches:
            for part in links_of(batch):
                yield dict(zip(("pair", "n"), np.unique(pairs_of(part), return_counts=True), strict=True))

    for chunk in collected(counts()):
        pair, at = np.unique(chunk["pair"], return_inverse=True)
        n = np.zeros(len(pair), np.int64)
        np.add.at(n, at, chunk["n"])
        yield batch_of({"pair": pair, "n": n})


def pairs_of(batch: pa.RecordBatch) -> np.ndarray:
    """The links of a batch as one number each, document after document."""
    a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("link_a", "link_b"))
    return a << 32 | b


def counted(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows (row, link_a, link_b, ...)`` with ``n_best`` and ``count_sum`` in place of the links."""
    counts = cut(counts)
    others = [f for f in rows.schema if f.name not in ("link_a", "link_b")]
    if counts.count() > MAX_PAIRS:
        links = rows.select("row", F.explode(F.arrays_zip("link_a", "link_b")).alias("l")).select("row", F.col("l.link_a").alias("a"), F.col("l.link_b").alias("b"))
        sums = links.join(counts, ["a", "b"]).groupBy("row").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum"))
        return rows.drop("link_a", "link_b").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
    table = counts.select(F.expr("shiftleft(bigint(a), 32) | bigint(b)").alias("pair"), "n", "best").toArrow()
    pair, n, best = (table.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    known = rows.sparkSession.sparkContext.broadcast((pair[order], n[order], best[order].astype(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = known.value
        for batch in batches:
            for part in links_of(batch):
                at = np.searchsorted(pair, pairs_of(part))
                size = part.column("link_a").value_lengths().to_numpy(zero_copy_only=False)
                ends = np.cumsum(size)
                sums = [np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)]) for x in (best, n)]
                arrays = [part.column(f.name) for f in others] + [pa.array(x[ends] - x[ends - size]) for x in sums]
                yield pa.RecordBatch.from_arrays(arrays, names=[*[f.name for f in others], "n_best", "count_sum"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others)
    return rows.mapInArrow(run, f"{schema}, n_best long, count_sum long")


def report(docs: DataFrame, models: Models) -> DataFrame:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    spark = docs.sparkSession
    path = scratch_path(spark, "aligned")
    digest = F.when(F.col("groups") != "", F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    n_links = F.size("link_a").cast("long").alias("n_links")
    align(docs, models).select("row", "doc_id", "n_a", "n_b", "n_groups", n_links, digest.alias("groups_sha256"), "link_a", "link_b").write.parquet(path)
    rows = spark.read.parquet(path)
    return counted(rows, pair_counts(rows)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
