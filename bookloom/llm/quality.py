"""Quality scores by positive-unlabelled learning.

A linear model over text statistics minimises the non-negative unbiased risk with logistic loss: trusted positives, unlabelled
text, and the share of positives in the unlabelled text (the class prior). Statistics of every whole text are computed in
Arrow batches; only the statistics of a bounded sample reach the driver for the fit.

Defined results: a null or empty text has all statistics zero and gets the score of such a text; without trusted positives the
score is the prior; null ``doc_id`` counts as seen in training (not held out); repeated rows get equal scores; further columns
do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bookloom.llm.words import mixed, prefix_hash, range_hash, slices

# byte classes: every ASCII byte that is no letter or digit is its own class
LOWER, UPPER, DIGIT, WIDE = 0, 1, 2, 3
_single = [b for b in range(128) if not chr(b).isalnum()]
CLASS = np.full(256, WIDE, np.int64)
for _i, _b in enumerate(_single):
    CLASS[_b] = 4 + _i
CLASS[[b for b in range(128) if chr(b).islower()]] = LOWER
CLASS[[b for b in range(128) if chr(b).isupper()]] = UPPER
CLASS[[b for b in range(128) if chr(b).isdigit()]] = DIGIT
N_CLASS = 4 + len(_single)
# coarse classes for adjacent pairs
COARSE = np.full(256, 7, np.int64)
COARSE[CLASS == LOWER], COARSE[CLASS == UPPER], COARSE[CLASS == DIGIT], COARSE[CLASS == WIDE] = 0, 1, 2, 3
COARSE[0x20], COARSE[0x0A] = 4, 5
COARSE[[ord(c) for c in ".,;:'\"?-"]] = 6
STATS = 8
N_FEATURES = N_CLASS + 64 + STATS


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``N_FEATURES`` numbers per text: byte classes, pairs of coarse classes, and word and line statistics."""
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    for s in slices(texts):
        n, rows = s.rows, slice(s.first, s.first + s.rows)
        size = np.diff(np.concatenate([[0], s.ends]))
        row = np.repeat(np.arange(n), size)
        per_byte = np.maximum(size, 1)[:, None]
        counts = np.bincount(row * N_CLASS + CLASS[s.data], minlength=n * N_CLASS).reshape(n, N_CLASS)
        coarse = COARSE[s.data]
        pair = (row[1:] * 64 + coarse[:-1] * 8 + coarse[1:])[row[1:] == row[:-1]]
        pairs = np.bincount(pair, minlength=n * 64).reshape(n, 64)
        words, word_row, h = np.maximum(s.counts, 1), s.row_of_word, s.hashes(lower=True)
        _, first = np.unique(mixed(h ^ mixed(word_row.astype(np.uint64))), return_index=True)
        distinct = np.bincount(word_row[first], minlength=n)
        length = s.end - s.start
        mean = np.bincount(word_row, length, n) / words
        square = np.bincount(word_row, length.astype(float) ** 2, n) / words
        breaks = np.flatnonzero(s.data == 0x0A)
        start = np.unique(np.concatenate([[0], breaks + 1, s.ends[:-1]]))
        start = start[start < len(s.data)]
        end = np.append(start[1:], len(s.data)).astype(np.int64)
        line_row = row[start] if len(start) else np.zeros(0, np.int64)
        lines = np.maximum(np.bincount(line_row, minlength=n), 1)
        whole = range_hash(prefix_hash(s.data), start, end) if len(start) else np.zeros(0, np.uint64)
        _, first = np.unique(mixed(whole ^ mixed(line_row.astype(np.uint64))), return_index=True)
        new_lines = np.bincount(line_row[first], minlength=n)
        out[rows, :N_CLASS] = np.sqrt(counts / per_byte)
        out[rows, N_CLASS : N_CLASS + 64] = np.sqrt(pairs / per_byte)
        out[rows, N_CLASS + 64 :] = np.stack([
            np.log1p(s.counts), np.log1p(lines), distinct / words, new_lines / lines, mean / 10, np.sqrt(np.maximum(square - mean**2, 0)) / 10,
            np.log1p(s.counts / lines), s.counts == 0,
        ], 1)
    return out


@dataclass
class QualityModel:
    weight: np.ndarray
    bias: float
    centre: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 5.0) -> QualityModel:
    """The non-negative risk: ``prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive))``; where the second part is
    negative, a step goes against it. Weights decay by ``decay`` over the number of positives."""
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    if not len(positive) or not len(unlabelled):
        return QualityModel(np.zeros(N_FEATURES), math.log(prior / (1 - prior)), np.zeros(N_FEATURES), np.ones(N_FEATURES), prior)
    centre, scale = unlabelled.mean(0), np.maximum(unlabelled.std(0), 1e-3)
    p, u = (np.clip((x - centre) / scale, -8, 8).astype(np.float64) for x in (positive, unlabelled))
    decay = decay / len(p)
    w, b = np.zeros(p.shape[1]), math.log(prior / (1 - prior))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        zp, zu = p @ w + b, u @ w + b
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        as_negative = np.append(u.T @ su / len(u) - prior * (p.T @ sp) / len(p), su.mean() - prior * sp.mean())
        if negative >= 0:
            grad = np.append(prior * (p.T @ (sp - 1)) / len(p), prior * (sp - 1).mean()) + as_negative
        else:
            grad = -as_negative
        grad[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return QualityModel(w, b, centre, scale, prior)


def is_held_out(doc_id: Column, parts: int = 5, part: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def _with_statistics(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x binary")


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 25_000) -> QualityModel:
    """Fit on about ``sample_docs`` documents chosen by hash outside the held-out part (the documented bound).

    All of them are the unlabelled text; those marked 1 are the trusted positives. The prior is the share of 1 among all
    training labels.
    """
    seen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter(~is_held_out(F.col("doc_id")) & F.col("quality").isNotNull())
    share = seen.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    prior = 0.5 if share is None else share
    open_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    every = max(1, math.ceil(open_docs.select("doc_id").count() / sample_docs))
    chosen = open_docs.filter(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(every)) == 0)
    trusted = seen.filter("quality = 1 and pmod(xxhash64('quality', doc_id), %d) = 0" % every).select("doc_id").distinct().withColumn("trusted", F.lit(True))
    rows = _with_statistics(chosen).join(trusted, "doc_id", "left").select("x", F.coalesce("trusted", F.lit(False)).alias("trusted")).collect()
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(-1, N_FEATURES)
    return minimise(x[[i for i, r in enumerate(rows) if r["trusted"]]], x, prior)


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(statistics(batch.column("text"))), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
