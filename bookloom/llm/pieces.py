"""N-best segmentation over a piece lattice, and decoding, in Arrow batches.

Encoding follows the white-space rules of the vocabulary files: one space is put before a text, spaces stand for the mark
U+2581, and a piece holds marks at its start only. So a text splits, without loss, into words that begin where a space follows
another character, and its best segmentations are combinations of its words' best segmentations. Distinct words of a slice are
segmented together: a forward Viterbi pass gives the best score of every position, a backward pass the best loss of any other
segmentation. The n best segmentations of a word come from a backward A-star search whose exact heuristic is the forward
score, so they leave the search in order; the same search one step up combines words into the n best of the text.

Characters without a piece of their own are one edge each, scored below every piece, and encoded as their UTF-8 bytes.

Defined results: a null or empty text has no ids and one segmentation of score 0; among equal totals a longer last piece goes
first, then the segmentation that shares most of its end with the one before it; null ``doc_id``, repeated rows, empty tables and
further columns do not matter. A very long text is handled whole, and so is a very long run without white space: the search keeps
``n`` open paths as chains of back pointers, so memory grows with the length and not with its square.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

from bookloom.llm.words import prefix_hash, range_hash

MARK = "▁"
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MAX_MODEL_BYTES = 64 << 20
UNKNOWN_PENALTY = 10.0
SLICE_BYTES = 512 << 10
KEPT_BYTES = 64  # longest word whose segmentations are kept
NEVER = -np.inf

Option = tuple[float, tuple[int, ...]]  # score and ids of a segmentation


class _Table:
    """Hash to row number in vectors: a few levels of direct-mapped slots, each taking what collided before."""

    def __init__(self, hashes: np.ndarray):
        self.levels, rest = [], np.arange(len(hashes))
        bits = max(8, int(len(hashes)).bit_length() + 3)
        self.shift = np.uint64(64 - bits)
        factor = 0x9E3779B97F4A7C15
        while len(rest):
            turn = np.uint64(factor)
            slot = ((hashes[rest] * turn) >> self.shift).astype(np.int64)
            rows = np.full(1 << bits, -1, np.int32)
            rows[slot] = rest
            self.levels.append((turn, rows))
            rest = rest[rows[slot] != rest]
            factor = factor * 0xD1342543DE82EF95 % (1 << 64)
        self.hashes = hashes

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        if not len(self.hashes):
            return out
        for turn, rows in self.levels:
            row = rows[((h * turn) >> self.shift).astype(np.int64)]
            hit = (row >= 0) & (self.hashes[row] == h)
            out[hit] = row[hit]
        return out


def _hash_of(strings: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum([len(s) for s in strings])
    return range_hash(prefix_hash(data), ends - [len(s) for s in strings], ends)


class Lattice:
    """Pieces with scores; finds the best segmentations of words and texts. Marks are spaces in here."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(model)
        plain = {p.piece.replace(MARK, " ").encode(): (p.score, i) for i, p in enumerate(proto.pieces) if p.type in (p.NORMAL, p.USER_DEFINED)}
        self.plain = plain
        self.byte_id = np.full(256, next((i for i, p in enumerate(proto.pieces) if p.type == p.UNKNOWN), 0), np.int32)
        self.bytes_of = [b""] * len(proto.pieces)
        for i, p in enumerate(proto.pieces):
            if p.type == p.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
        for piece, (_, i) in plain.items():
            self.bytes_of[i] = piece
        self.lowest = min((s for s, _ in plain.values()), default=0.0) - UNKNOWN_PENALTY
        self.longest = max(map(len, plain), default=1)
        prefixes = sorted({p[:k] for p in plain for k in range(1, len(p) + 1)})
        self.table = _Table(_hash_of(prefixes))
        self.prefix_score = np.array([plain[p][0] if p in plain else NEVER for p in prefixes])
        self.prefix_id = np.array([plain[p][1] if p in plain else -1 for p in prefixes], np.int32)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.flat_len = np.array([len(b) for b in self.bytes_of])
        self.flat_at = np.cumsum(self.flat_len) - self.flat_len
        held = set(b"".join(plain))
        self.alone = np.zeros(256, bool)  # control characters that no piece holds cut the lattice as well
        self.alone[[b for b in range(0x20) if b not in held]] = True
        self._kept = lru_cache(20_000)(self._nbest)

    def nbest(self, word: bytes, n: int) -> tuple[Option, ...]:
        """The ``n`` best segmentations of one word, best first; those of short words are kept for the next time."""
        return self._kept(word, n) if len(word) <= KEPT_BYTES else self._nbest(word, n)

    def _nbest(self, word: bytes, n: int) -> tuple[Option, ...]:
        """A-star from the end with the forward scores as heuristic.

        The heuristic is exact, so each open path stands for a whole segmentation of just its priority, and no more than the ``n``
        best need to stay open. A path is a chain of back pointers. Among equal totals the path opened last goes on, by its longest
        piece.
        """
        best = [0.0] + [NEVER] * len(word)
        for i in range(len(word)):
            if best[i] > NEVER:
                for j, score, _ in self._edges(word, i):
                    best[j] = max(best[j], best[i] + score)
        lead = [i for i in range(len(word)) if word[i] & 0xC0 != 0x80]
        before = dict(zip([*lead[1:], len(word)], lead, strict=True))  # start of the character that ends here
        out, count = [], 0
        live = [(-best[-1], 0, len(word), 0.0, None)]
        while live and len(out) < n:
            _, _, at, done, path = live.pop(0)
            if at == 0:
                ids = []
                while path is not None:
                    ids.extend(path[0])
                    path = path[1]
                out.append((done, tuple(ids)))
                continue
            char = before[at]
            for i in range(at - 1, max(-1, at - self.longest - 1), -1):
                found = self.plain.get(word[i:at])
                if best[i] == NEVER or (found is None and i != char):
                    continue
                score, ids = (found[0], (found[1],)) if found else (self.lowest, tuple(int(self.byte_id[b]) for b in word[i:at]))
                count += 1
                live.append((-round(best[i] + score + done, 6), -count, i, score + done, (ids, path)))
            live.sort(key=lambda x: x[:2])
            del live[n - len(out) :]
        return tuple(out)

    def _edges(self, word: bytes, i: int) -> Iterator[tuple[int, float, int]]:
        """(end, score, number of ids) of the pieces that begin at a character's first byte, and of the character if it is none."""
        if word[i] & 0xC0 == 0x80:
            return
        size = 1 if word[i] < 0x80 else 2 if word[i] < 0xE0 else 3 if word[i] < 0xF0 else 4
        size = min(size, len(word) - i)
        for j in range(i + 1, min(len(word), i + self.longest) + 1):
            found = self.plain.get(word[i:j])
            if found:
                yield j, found[0], 1
        if word[i : i + size] not in self.plain:
            yield i + size, self.lowest, size

    def combined(self, options: list[tuple[Option, ...]], n: int) -> list[tuple[float, tuple[int, ...]]]:
        """Losses and choices of the ``n`` best combinations, one option of each word; the first takes every word's first."""
        first = (0,) * len(options)
        heap, seen, out = [(0.0, first)], {first}, []
        while heap and len(out) < n:
            loss, choice = heapq.heappop(heap)
            out.append((loss, choice))
            for q, o in enumerate(options):
                nxt = (*choice[:q], choice[q] + 1, *choice[q + 1 :])
                if choice[q] + 1 < len(o) and nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(heap, (sum(p[0][0] - p[c][0] for p, c in zip(options, nxt, strict=True)), nxt))
        return out

    def segment(self, data: np.ndarray, off: np.ndarray):
        """Best segmentations of words ``data[off[w]:off[w+1]]``: scores, losses of the next best, ids and their offsets.

        Words must come longest first.
        """
        n, total = len(off) - 1, int(off[-1])
        size = np.diff(off)
        end = np.repeat(off[1:], size)
        hashes = prefix_hash(data)
        active = np.flatnonzero((data & 0xC0) != 0x80)
        lead = data[active]
        chars = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        chars = np.minimum(chars, end[active] - active)
        starts, single = active, chars
        columns = []
        has_char = np.zeros(total, bool)
        for k in range(1, self.longest + 1):
            active = active[active + k <= end[active]]
            if not len(active):
                break
            row = self.table.find(range_hash(hashes, active, active + k))
            active, row = active[row >= 0], row[row >= 0]
            column = np.full(total, NEVER)
            column[active] = self.prefix_score[row]
            columns.append(column)
        for size_of_char in range(1, 5):
            at = starts[single == size_of_char]
            while len(columns) < size_of_char and len(at):
                columns.append(np.full(total, NEVER))
            lost = at[columns[size_of_char - 1][at] == NEVER] if len(at) else at
            if len(lost):
                columns[size_of_char - 1][lost] = self.lowest
                has_char[lost] = True
        width = len(columns)
        # node of position p of word w: off[w] + w + p
        first = off[:-1] + np.arange(n)
        forward, back = np.full(total + n, NEVER), np.zeros(total + n, np.int16)
        forward[first] = 0.0
        longest = int(size[0]) if n else 0
        live = np.searchsorted(-size, -np.arange(longest + 1), "right")  # words of at least p bytes
        for p in range(1, longest + 1):
            a = live[p]
            node, at = first[:a] + p, off[:a] + p
            best, step = np.full(a, NEVER), np.zeros(a, np.int16)
            for k in range(1, min(p, width) + 1):
                value = forward[node - k] + columns[k - 1][at - k]
                take = (value >= best) & (value > NEVER)
                best[take], step[take] = value[take], k
            forward[node], back[node] = best, step
        chosen = np.zeros(total, np.int16)
        word, at = np.arange(n), size.copy()
        while len(word):
            step = back[first[word] + at]
            at = at - step
            chosen[off[word] + at] = step
            word, at = word[at > 0], at[at > 0]
        backward = np.full(total + n, NEVER)
        backward[first + size] = 0.0
        for back_by in range(1, longest + 1):  # from the ends of the words
            a = live[back_by]
            p = size[:a] - back_by
            node, pos = first[:a] + p, off[:a] + p
            best = np.full(a, NEVER)
            for k in range(1, min(back_by, width) + 1):
                np.maximum(best, columns[k - 1][pos] + backward[node + k], out=best)
            backward[node] = best
        node = np.arange(total) + np.repeat(np.arange(n), size)
        other = np.full(total, NEVER)
        for k in range(1, width + 1):
            through = forward[node] + columns[k - 1] + backward[np.minimum(node + k, total + n - 1)]
            through[chosen == k] = NEVER
            np.maximum(other, through, out=other)
        score = forward[first + size]
        loss = score - np.maximum.reduceat(other, off[:-1]) if n else np.zeros(0)
        edge = np.flatnonzero(chosen)
        lost_edge = has_char[edge] & (chosen[edge] == np.where(data[edge] < 0x80, 1, np.where(data[edge] < 0xE0, 2, np.where(data[edge] < 0xF0, 3, 4))))
        count = np.where(lost_edge, chosen[edge], 1).astype(np.int64)
        row = self.table.find(range_hash(hashes, edge, edge + chosen[edge]))
        ids = np.repeat(np.where(lost_edge, -1, self.prefix_id[row]), count)
        place = np.repeat(edge, count) + np.arange(len(ids)) - np.repeat(np.cumsum(count) - count, count)
        ids = np.where(ids < 0, self.byte_id[data[place]], ids).astype(np.int32)
        upto = np.concatenate([[0], np.cumsum(count)])
        return score, loss, ids, upto[np.searchsorted(edge, off)]

    def encode(self, texts: pa.Array, n: int = 1):
        """Of each text: ids (a list array), score, and (score, ids) of its ``n`` best segmentations."""
        texts = texts.cast(pa.large_string()).fill_null("")
        lengths = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        begin = int(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset])
        raw = raw[begin : begin + int(lengths.sum())]
        full = lengths > 0
        at = np.cumsum(lengths) - lengths
        data = np.insert(raw, at[full], 0x20)  # the space before each text
        text_end = np.cumsum(lengths + full)
        text_start = (text_end - lengths - full)[full]
        space, alone = data == 0x20, self.alone[data]
        cut = alone.copy()
        cut[1:] |= alone[:-1] | (space[1:] & ~space[:-1])
        cut[text_start] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data)).astype(np.int64)
        if not len(start):
            start = end = np.zeros(0, np.int64)
        _, pick, of = np.unique(range_hash(prefix_hash(data), start, end), return_index=True, return_inverse=True)
        order = np.argsort(start[pick] - end[pick], kind="stable")  # longest first
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        of, pick = place[of], pick[order]
        size = end[pick] - start[pick]
        off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        flat = data[np.repeat(start[pick] - off[:-1], size) + np.arange(off[-1])]
        score, loss, ids, id_at = self.segment(flat, off)
        count = np.diff(id_at)[of]
        out = ids[np.repeat(id_at[of] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        words_upto = np.searchsorted(start, text_end)
        ids_upto = np.concatenate([[0], np.cumsum(count)])[words_upto]
        score_upto = np.concatenate([[0.0], np.cumsum(score[of])])[words_upto]
        id_off = np.concatenate([[0], ids_upto])
        totals = np.diff(np.concatenate([[0.0], score_upto]))
        best = []
        of_word = np.concatenate([[0], np.cumsum(count)])
        for i, (a, b) in enumerate(zip(np.concatenate([[0], words_upto[:-1]]), words_upto, strict=True)):
            found = [(float(totals[i]), out[id_off[i] : id_off[i + 1]])]
            if n > 1 and b > a:
                losses = loss[of[a:b]]
                near = np.argpartition(losses, n - 2)[: n - 1] if len(losses) >= n else np.arange(len(losses))
                near = [a + w for w in np.sort(near) if np.isfinite(losses[w])]
                options = [self._from(tuple(out[of_word[w] : of_word[w + 1]].tolist()), self.nbest(data[start[w] : end[w]].tobytes(), n)) for w in near]
                for lost, choice in self.combined(options, n)[1:]:
                    parts, at = [], of_word[a]
                    for w, option, c in zip(near, options, choice, strict=True):
                        if c:
                            parts += [out[at : of_word[w]], np.array(option[c][1], np.int32)]
                            at = of_word[w + 1]
                    found.append((found[0][0] - lost, np.concatenate([*parts, out[at : of_word[b]]])))
            best.append(found)
        return pa.ListArray.from_arrays(pa.array(id_off, pa.int32()), pa.array(out, pa.int32())), totals, best

    @staticmethod
    def _from(first: tuple[int, ...], options: tuple[Option, ...]) -> tuple[Option, ...]:
        """``options`` with the segmentation that the text has got in front; it may tie with others."""
        others = [o for o in options if o[1] != first]
        return ((options[0][0], first), *others[: len(options) - 1])

    def decode(self, ids: pa.Array) -> list[str]:
        """The texts of lists of ids; bytes are joined before they are read as UTF-8."""
        lengths = pa.compute.fill_null(ids.value_lengths(), 0).to_numpy(zero_copy_only=False)
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        size = self.flat_len[flat]
        upto = np.cumsum(size)
        raw = self.flat[np.repeat(self.flat_at[flat] - (upto - size), size) + np.arange(size.sum())].tobytes()
        ends = np.concatenate([[0], upto])[np.cumsum(lengths)]
        return [raw[a + 1 : b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class PieceModel:
    """A broadcast vocabulary file; each Python worker builds its lattice once."""

    _built: dict[int, Lattice] = {}

    def __init__(self, broadcast, key: int):
        self.broadcast, self.key = broadcast, key

    def lattice(self) -> Lattice:
        if self.key not in self._built:
            self._built.clear()
            self._built[self.key] = Lattice(self.broadcast.value)
        return self._built[self.key]


def read_model(spark: SparkSession, path: str = MODEL_PATH) -> PieceModel:
    """The vocabulary file, read by Spark and sent to every executor; its size is checked first."""
    file = spark.read.format("binaryFile").load(path)
    size = file.select("length").first()["length"]
    if size > MAX_MODEL_BYTES:
        raise ValueError(f"{path} holds {size} bytes; at most {MAX_MODEL_BYTES} are broadcast")
    content = bytes(file.select("content").first()["content"])
    return PieceModel(spark.sparkContext.broadcast(content), hash(content))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most SLICE_BYTES of text, or one row."""
    sizes = pa.compute.binary_length(batch.column("text").cast(pa.large_string()).fill_null("")).to_numpy(zero_copy_only=False)
    upto, i = np.concatenate([[0], np.cumsum(sizes)]), 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


ENCODED = "doc_id long, n_pieces long, score double, ids array<int>, nbest array<struct<score:double,n_pieces:int,ids_sha256:string>>, round_trip boolean"
NBEST = pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int32()), ("ids_sha256", pa.string())]))


def ids_digest(ids: np.ndarray) -> str:
    """SHA-256 of ids as little-endian 32-bit integers."""
    return hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()


def encode_documents(docs: DataFrame, model: PieceModel, n: int = 3) -> DataFrame:
    """Per document: the ids of the best segmentation, the scores, sizes and digests of the ``n`` best (see ``segmentations`` for
    their ids), and whether decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = model.lattice()
        for batch in batches:
            for part in _parts(batch):
                ids, scores, best = lattice.encode(part.column("text"), n)
                texts = part.column("text").fill_null("").to_pylist()
                same = [a == b for a, b in zip(lattice.decode(ids), texts, strict=True)]
                listed = [[{"score": s, "n_pieces": len(k), "ids_sha256": ids_digest(k)} for s, k in one] for one in best]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), ids.value_lengths().cast(pa.int64()), pa.array(scores, pa.float64()), ids,
                    pa.array(listed, NBEST), pa.array(same, pa.bool_()),
                ], names=["doc_id", "n_pieces", "score", "ids", "nbest", "round_trip"])
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED)


def segmentations(docs: DataFrame, model: PieceModel, n: int = 3) -> DataFrame:
    """One row per document and segmentation: ``doc_id, rank, score, ids``, for the ``n`` best; ``decode_documents`` reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = model.lattice()
        for batch in batches:
            for part in _parts(batch):
                for doc, best in zip(part.column("doc_id"), lattice.encode(part.column("text"), n)[2], strict=True):
                    flat = pa.array(np.concatenate([k for _, k in best]), pa.int32())
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(k) for _, k in best]]), pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc.as_py()] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()), pa.array([x for x, _ in best], pa.float64()), lists],
                        names=["doc_id", "rank", "score", "ids"],
                    )
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, rank int, score double, ids array<int>")


def decode_documents(encoded: DataFrame, model: PieceModel) -> DataFrame:
    """``doc_id, text`` of encoded documents; a null list of ids gives the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = model.lattice()
        for batch in batches:
            texts = pa.array(lattice.decode(batch.column("ids")), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
