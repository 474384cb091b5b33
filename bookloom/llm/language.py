"""Language of every word of code-switched text by a linear-chain conditional random field, and of whole documents.

Words are runs of letters. Features of a word: itself (the lexicon), its prefixes and suffixes of one to three bytes, and the
bigrams and trigrams of its bytes with word ends; all are hashed into one table of weights per language. Transitions between
the languages of neighbouring words are learned as well. Sequences are lines. Forward-backward gives each word's posterior; a
document's language has the largest sum over its words.

Defined results: ``und`` with score 0 for a null or empty text, for a text without a letter, and where no labelled document
exists; a text whose only letters are outside this model still gets a learned language; ties go to the first language in
alphabetical order; null ``doc_id`` counts as seen in training; repeated rows get equal results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from bookloom.llm.words import Slice, mixed, prefix_hash, range_hash, slices

BUCKETS = 1 << 16
UNDETERMINED = "und"
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the two-byte Latin letters of Western Europe."""
    out = data + np.uint8(32) * ((data >= 0x41) & (data <= 0x5A))
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    return out + np.uint8(32) * (after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97))


@dataclass
class Words:
    """The words of a slice as indexes into its distinct words, with the features of the latter."""

    of: np.ndarray  # distinct word of each word
    feature: np.ndarray  # buckets, word by word
    first: np.ndarray  # start of each distinct word's features

    def emissions(self, weight: np.ndarray) -> np.ndarray:
        if not len(self.of):
            return np.zeros((0, weight.shape[1]))
        return np.add.reduceat(weight[self.feature], self.first, axis=0)[self.of]


def words_of(s: Slice) -> Words:
    data = folded(s.data)
    hashes = prefix_hash(data)
    whole = range_hash(hashes, s.start, s.end)
    _, pick, of = np.unique(whole, return_index=True, return_inverse=True)
    start, end, n = s.start[pick], s.end[pick], len(pick)
    word, feature = [np.arange(n)], [whole[pick]]
    for kind, k in ((1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)):
        fits = np.flatnonzero(end - start >= k)
        a, b = (start[fits], start[fits] + k) if kind == 1 else (end[fits] - k, end[fits])
        word.append(fits)
        feature.append(range_hash(hashes, a, b) + np.uint64(kind))
    for k in (2, 3):
        room = np.maximum(end - start - k + 1, 0)
        owner = np.repeat(np.arange(n), room)
        at = np.repeat(start, room) + np.arange(len(owner)) - np.repeat(np.cumsum(room) - room, room)
        word.append(owner)
        feature.append(range_hash(hashes, at, at + k) + np.uint64(3))
    word, feature = np.concatenate(word), (mixed(np.concatenate(feature)) >> np.uint64(48)).astype(np.int64)
    order = np.argsort(word, kind="stable")
    return Words(of, feature[order], np.searchsorted(word[order], np.arange(n)))


def lines_of(s: Slice) -> np.ndarray:
    """Start of each line's words, with the number of words at the end; lines without words are left out."""
    breaks = np.concatenate([np.flatnonzero(s.data == 0x0A), s.ends])
    return np.unique(np.concatenate([[0], np.searchsorted(s.start, breaks), [len(s.start)]]))


def forward_backward(emission: np.ndarray, bounds: np.ndarray, begin: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors of all positions, expected transitions, and the log partition of all sequences.

    All sequences move together, longest first, so each step is one operation over those that are still running.
    """
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    start, size = bounds[:-1][order], size[order]
    top = emission.max(1, keepdims=True)
    e = np.exp(emission - top)
    t, alpha, beta, scale = np.exp(step), np.empty_like(e), np.ones_like(e), np.ones(len(e))
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest + 1), "left")  # sequences longer than p
    for p in range(longest):
        at = start[: live[p]] + p
        a = np.exp(begin) * e[at] if p == 0 else (alpha[at - 1] @ t) * e[at]
        scale[at] = a.sum(1)
        alpha[at] = a / scale[at][:, None]
    for p in range(longest - 2, -1, -1):
        at = start[: live[p + 1]] + p
        beta[at] = (e[at + 1] * beta[at + 1]) @ t.T / scale[at + 1][:, None]
    inner = np.ones(len(e), bool)
    inner[bounds[1:] - 1] = False
    left = np.flatnonzero(inner)
    right = (e[left + 1] * beta[left + 1]) / scale[left + 1][:, None]
    return alpha * beta, (alpha[left].T @ right) * t, float(np.log(scale).sum() + top.sum())


@dataclass
class LanguageModel:
    languages: list[str]
    weight: np.ndarray  # BUCKETS x languages
    begin: np.ndarray
    step: np.ndarray


def train(lines: list[tuple[str, str]], epochs: int = 5, batch: int = 1500, rate: float = 0.3) -> LanguageModel:
    """Likelihood ascent over ``(text, language)`` lines. Each sequence joins a line with the next two, whatever their
    languages, so that switches and their likelihoods are learned too."""
    languages = sorted({lang for _, lang in lines})
    code, k = {x: i for i, x in enumerate(languages)}, len(languages)
    model = LanguageModel(languages, np.zeros((BUCKETS, k), np.float64), np.zeros(k), np.eye(k))
    square = [np.full_like(x, 1e-6) for x in (model.weight, model.begin, model.step)]
    prepared = []
    for i in range(0, len(lines), batch):
        part = lines[i : i + batch]
        for s in slices(pa.array([t for t, _ in part]), LETTER):
            label = np.array([code[part[s.first + r][1]] for r in s.row_of_word], np.int64)
            bounds = np.unique(np.concatenate([[0], np.cumsum(s.counts)[2::3], [len(label)]])).astype(np.int64)
            if len(label):
                prepared.append((words_of(s), label, bounds))
    for _ in range(epochs):
        for w, label, bounds in prepared:
            n = len(label)
            posterior, moves, _ = forward_backward(w.emissions(model.weight), bounds, model.begin, model.step)
            wanted = np.zeros((n, k))
            wanted[np.arange(n), label] = 1
            miss = wanted - posterior
            heads = bounds[:-1]
            inner = np.ones(n, bool)
            inner[bounds[1:] - 1] = False
            left = np.flatnonzero(inner)
            seen = np.bincount(label[left] * k + label[left + 1], minlength=k * k).reshape(k, k)
            per_word = np.stack([np.bincount(w.of, miss[:, c], len(w.first)) for c in range(k)], 1)
            owner = np.repeat(np.arange(len(w.first)), np.diff(np.append(w.first, len(w.feature))))
            by_bucket = np.stack([np.bincount(w.feature, per_word[owner, c], BUCKETS) for c in range(k)], 1)
            for x, g, q in zip((model.weight, model.begin, model.step), (by_bucket / n, miss[heads].mean(0), (seen - moves) / n), square, strict=True):
                q += g**2
                x += rate * g / np.sqrt(q)
    return model


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = 600, max_chars: int = 20_000) -> LanguageModel | None:
    """Fit on about ``sample_docs`` labelled documents of each language, none longer than ``max_chars``, chosen by hash outside
    the held-out part (the documented bound). None without labelled documents."""
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(
        F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.length("text").between(1, max_chars)
    )
    counts = seen.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(256).collect()
    if not counts:
        return None
    every = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], max(1, math.ceil(r["count"] / sample_docs)))])
    chosen = seen.filter(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), every[F.col("lang")]) == 0)
    rows = chosen.select("lang", F.posexplode(F.split("text", "\n")).alias("line", "t"), "doc_id").select("lang", "t", F.xxhash64("doc_id", "line").alias("o")).collect()
    return train([(r["t"], r["lang"]) for r in sorted(rows, key=lambda r: (r["o"], r["t"]))])


RESULT = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_other long"


class Predictor:
    """Languages of Arrow batches by a broadcast model (BUCKETS x languages numbers, at most 256 languages)."""

    def __init__(self, spark, model: LanguageModel):
        self.sent = spark.sparkContext.broadcast(model)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language, mean posterior, number of words, and of words labelled otherwise."""
        m = self.sent.value
        n, k = len(texts), len(m.languages)
        mass, total, hard = np.zeros((n, k)), np.zeros(n, np.int64), np.zeros((n, k), np.int64)
        for s in slices(texts, LETTER):
            posterior, _, _ = forward_backward(words_of(s).emissions(m.weight), lines_of(s), m.begin, m.step)
            row = s.row_of_word + s.first
            for c in range(k):
                mass[:, c] += np.bincount(row, posterior[:, c], n)
            hard += np.bincount(row * k + posterior.argmax(1), minlength=n * k).reshape(n, k) if len(row) else 0
            total += np.bincount(row, minlength=n)
        best = mass.argmax(1)
        score = np.clip(np.where(total > 0, mass[np.arange(n), best] / np.maximum(total, 1), 0.0), 0, 1)
        other = total - hard[np.arange(n), best]
        # bytes beyond ASCII count as letters above: look again at texts that have no ASCII letter
        doubtful = pa.compute.invert(pa.compute.match_substring_regex(texts.fill_null(""), "[A-Za-z]")).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(doubtful):
            if not any(c.isalpha() for c in texts[int(i)].as_py() or ""):
                best[i], score[i], total[i], other[i] = k, 0.0, 0, 0
        return np.array([*m.languages, UNDETERMINED], object)[best], score, total, other


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Per document: language, score (mean posterior of its words), number of words, and of words labelled otherwise."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), "text")
    if model is None:
        zero = F.lit(0).cast("long")
        return ids.select("doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), zero.alias("n_words"), zero.alias("n_other"))
    predictor = Predictor(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, total, other = predictor(batch.column("text"))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score),
                pa.array(total, pa.int64()), pa.array(other, pa.int64()),
            ], names=["doc_id", "held_out", "lang_pred", "score", "n_words", "n_other"])

    return ids.mapInArrow(run, RESULT)


def identified(docs: DataFrame, model: LanguageModel | None, min_score: float = 0.35) -> DataFrame:
    """The rows of ``docs`` whose language is determined with ``min_score`` or more; without a model no row is."""
    if model is None:
        return docs.limit(0)
    predictor = Predictor(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, _, _ = predictor(batch.column("text"))
            yield batch.filter(pa.array((lang != UNDETERMINED) & (score >= min_score)))
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)
