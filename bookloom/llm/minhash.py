"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct word shingles. Documents with equal sets are one node of the join. In each of several
independent trees a document walks from the root along minwise tokens: a tree node picks one position of the signature, or two
for a quarter of the nodes, and the document goes on to the child named by its token there. Two documents of similarity s meet
in a leaf with the survival probability of a branching process of mean 1.25 * a, where a is the share of positions at which their
signatures agree. The trees share the signature, so a pair's misses are not independent: the number of trees is the smallest whose
miss rate, averaged over the binomial agreement, is at most MISSED at the threshold (18 trees at depth four, 23 at five).

First only leaf numbers and row numbers travel, packed by bucket: most leaves are reached by one document, and are dropped there.
Rows that meet within a task are settled in it, so a crowded leaf sends one row per task. Sketches then join what is left.

All pairs of a leaf are compared: in one task up to a fixed number of rows, in blocks dealt to many tasks above it. Comparisons
use byte sketches of the signature with a margin (a pair at 0.8 fails it once in a million times) and the bound that set sizes
put on similarity. A leaf passes on the pairs it finds while they are few. Where they are many, the leaf holds a family of alike
documents, and passes on one tie per document. Every pair and tie is confirmed on the full sets. In a family, the links so far
make components; all documents outside the family's largest component are then compared with the whole family, on full sets,
block by block, and again only ties leave a block. So the rows between steps grow with the documents and not with the pairs of a
family, and no link between documents that met in a leaf is given up.

Defined results: without words or text the set is empty and linked with nothing; fewer words than a shingle are one shingle of
all words; a null ``doc_id`` is linked with nothing and kept; rows that share a ``doc_id`` share a component; further columns do
not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bookloom.llm.arrays import batch_of, carried, groups
from bookloom.llm.components import components
from bookloom.llm.joins import sized, without
from bookloom.llm.words import mixed, prefix_hash, range_hash, slices
from bookloom.session import cut, scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
POSITIONS = 64
MISSED = 1 / 30_000  # share of pairs just at the threshold that no tree may bring together
SMALL = 32  # rows of a leaf that are compared together with other leaves
BUCKETS_PER_PARTITION = 4
LEAF_ROWS = 2048  # rows of a leaf that one task holds; larger leaves are dealt into blocks
CHUNK = 256  # rows that are compared with a whole block at once
LEAF = 8  # rows of unrelated documents that a leaf should hold
UNRELATED = 0.05  # similarity that unrelated documents are expected to stay below
PAIRS_PER_ROW = 2  # more near pairs than this in a leaf make it a family
BLOCK_ROWS, BLOCK_ITEMS = 1024, 2_000_000  # of one side of a comparison within a family
ALIKE = 36  # equal bytes of two sketches that make a candidate
_draw = mixed(np.arange(1, 2 * POSITIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
SALTS, FACTORS = _draw[:POSITIONS], _draw[POSITIONS:] | np.uint64(1)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row, hash) per slice: the distinct shingles of each text, by row and hash."""
    for s in slices(column):
        prefix, row = prefix_hash(s.hashes(lower=True)), s.row_of_word
        first = np.cumsum(s.counts) - s.counts
        left = s.counts[row] - (np.arange(len(row)) - first[row])
        at = np.flatnonzero(left >= k)
        short = np.flatnonzero((s.counts > 0) & (s.counts < k))
        row = np.concatenate([row[at], short])
        h = np.concatenate([range_hash(prefix, at, at + k), range_hash(prefix, first[short], first[short] + s.counts[short])])
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield s.first, s.rows, row[new], h[new]


SIGNED = "row long, doc_id long, n int, c1 long, c2 long, signature binary"


def signed(docs: DataFrame, k: int) -> DataFrame:
    """``row, doc_id, n, c1, c2, signature``: row number, set size, set identity, and minwise tokens (the latter once per batch and
    set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
            n, c1, c2 = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.uint64), np.zeros(len(doc), np.uint64)
            tokens = np.zeros((len(doc), POSITIONS), np.uint32)
            for first, rows, row, h in shingle_sets(batch.column("text"), k):
                size = np.bincount(row, minlength=rows)
                full = np.flatnonzero(size)
                if not len(full):
                    continue
                start = (np.cumsum(size) - size)[full]
                n[first : first + rows] = size
                c1[first + full], c2[first + full] = np.add.reduceat(mixed(h), start), np.add.reduceat(mixed(h ^ SALTS[0]), start)
                for j in range(POSITIONS):
                    tokens[first + full, j] = np.minimum.reduceat(((h ^ SALTS[j]) * FACTORS[j]) >> np.uint64(32), start)
            order = np.lexsort((doc, c2, c1, n))
            start, group = groups(n[order], c1[order], c2[order])
            lead = np.zeros(len(doc), bool)
            lead[order] = doc[order] == doc[order][start][group] if len(doc) else True
            lead &= n > 0
            raw = pa.array([t.tobytes() if keep else None for t, keep in zip(tokens, lead, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int32()), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), raw],
                names=["row", "doc_id", "n", "c1", "c2", "signature"],
            )
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.filter(F.col("doc_id").isNotNull()).mapInArrow(run, SIGNED)


def reached(tokens: np.ndarray, depth: int, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for every leaf that each row of minwise tokens reaches."""
    roots = mixed(np.arange(1, trees + 1, dtype=np.uint64))
    who, key = np.repeat(np.arange(len(tokens)), trees), np.tile(roots, len(tokens))
    for _ in range(depth):
        one = (mixed(key ^ SALTS[1]) % np.uint64(POSITIONS)).astype(np.int64)
        two = (one + 1 + (mixed(key ^ SALTS[2]) % np.uint64(POSITIONS - 1)).astype(np.int64)) % POSITIONS
        second = mixed(key ^ SALTS[3]) % np.uint64(4) == 0
        who, at, parent = np.concatenate([who, who[second]]), np.concatenate([one, two[second]]), np.concatenate([key, key[second]])
        key = mixed(parent + mixed((tokens[who, at].astype(np.uint64) << np.uint64(8)) + at.astype(np.uint64)))
    return who, key


def missed(percent: int, depth: int, trees: int) -> float:
    """Share of pairs of similarity ``percent`` that meet in no leaf."""
    total = 0.0
    for same in range(POSITIONS + 1):
        agree, meet = same / POSITIONS, 1.0
        for _ in range(depth):
            meet = 0.75 * agree * meet + 0.25 * (1 - (1 - agree * meet) ** 2)
        weight = math.comb(POSITIONS, same) * (percent / 100) ** same * (1 - percent / 100) ** (POSITIONS - same)
        total += weight * (1 - meet) ** trees
    return total


def trees_for(percent: int, depth: int) -> int:
    """The smallest number of trees that misses at most MISSED of the pairs at the threshold."""
    trees = 1
    while missed(percent, depth, trees) > MISSED:
        trees += 1
    return trees


PACKED = "bucket int, keys binary, low long, rows binary, settled boolean"


def packed(leaf: np.ndarray, row: np.ndarray, bucket: np.ndarray, settled: bool) -> Iterator[pa.RecordBatch]:
    """One record per bucket: leaf numbers, and row numbers as distances from the lowest. Settled rows need no bucket of their leaf."""
    if not len(leaf):
        return
    order = np.lexsort((row, bucket))
    leaf, row, bucket = leaf[order], row[order], bucket[order]
    start, _ = groups(bucket)
    out = []
    for a, b in zip(start, np.append(start[1:], len(bucket)), strict=True):
        low = row[a]
        far = row[b - 1] - low
        keys = leaf[a:b] if settled else leaf[a:b].astype(np.uint32)  # the bucket names the rest
        out.append((bucket[a], keys.tobytes(), low, (row[a:b] - low).astype(np.uint32 if far < 1 << 32 else np.uint64).tobytes(), settled))
    types = (pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.bool_())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["bucket", "keys", "low", "rows", "settled"])


def unpacked(record: dict) -> dict[str, np.ndarray]:
    keys = np.frombuffer(record["keys"], np.int64 if record["settled"] else np.uint32).astype(np.int64)
    rows = np.frombuffer(record["rows"], np.uint32 if len(record["rows"]) == 4 * len(keys) else np.uint64).astype(np.int64)
    return {"key": keys if record["settled"] else keys + (record["bucket"] << 32), "row": rows + record["low"]}


def crossed(heads: DataFrame, depth: int, trees: int) -> DataFrame:
    """``key, row``: the leaves that more than one row reaches, and these rows.

    Rows of a batch that meet in a leaf are known there; all but one take a way of their own, spread by row, and the one stands
    for them in the bucket of the leaf. So a bucket holds a leaf at most once per batch.
    """
    buckets = BUCKETS_PER_PARTITION * int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 5000) for i in range(0, batch.num_rows, 5000)):
                tokens = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(-1, POSITIONS)
                who, key = reached(tokens, depth, trees)
                bucket = (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
                leaf = (bucket << 32) + (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
                row = part.column("row").to_numpy(zero_copy_only=False)[who]
                order = np.lexsort((row, leaf))
                leaf, row, bucket = leaf[order], row[order], bucket[order]
                new = np.ones(len(leaf), bool)
                new[1:] = (leaf[1:] != leaf[:-1]) | (row[1:] != row[:-1])
                leaf, row, bucket = leaf[new], row[new], bucket[new]
                start, group = groups(leaf)
                head = np.zeros(len(leaf), bool)
                head[start] = True
                yield from packed(leaf[head], row[head], bucket[head], False)
                several = (np.bincount(group)[group] > 1) if len(leaf) else head
                yield from packed(leaf[several], row[several], (mixed(row[several].view(np.uint64)) % np.uint64(buckets)).astype(np.int64), True)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def several():
            if held:
                key, row = (np.concatenate([h[c] for h in held]) for c in ("key", "row"))
                order = np.argsort(key, kind="stable")
                start, group = groups(key[order])
                met = order[np.bincount(group)[group] > 1]
                yield batch_of({"key": key[met], "row": row[met]})
                held.clear()

        for batch in batches:
            for record in batch.to_pylist():
                if record["settled"]:
                    yield batch_of(unpacked(record))
                    continue
                if record["bucket"] != at:
                    yield from several()
                    at = record["bucket"]
                held.append(unpacked(record))
        yield from several()

    dealt = heads.select("row", "signature").mapInArrow(reach, PACKED).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(meet, "key long, row long")


def sketched(heads: DataFrame) -> DataFrame:
    """``row, doc, n, sketch``: one byte of each minwise token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).astype(np.uint8)
            flat = pa.Array.from_buffers(pa.binary(POSITIONS), batch.num_rows, [None, pa.py_buffer(sketch)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("n"), flat], names=["row", "doc", "n", "sketch"])

    return heads.select("row", "doc_id", "n", "signature").mapInArrow(run, "row long, doc long, n int, sketch binary")


def tied(n: int, a: np.ndarray, b: np.ndarray, name: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the smallest name reachable over the links a-b."""
    label = name.copy()
    while len(a):
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        if (least == label).all():
            break
        label = least
    return label


class Leaves:
    """Near pairs and families among rows sorted by leaf."""

    def __init__(self, rows: dict[str, np.ndarray], percent: int):
        self.doc, self.n, self.percent = rows["doc"], rows["n"].astype(np.int64), percent
        self.sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(-1, POSITIONS)
        self.out: list[np.ndarray] = []  # (family?, a, b)

    def near(self, i, j) -> np.ndarray:
        """Whether rows i and j can be similar: sizes first, then sketches."""
        i, j = np.broadcast_arrays(i, j)
        low, high = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        fits = (100 * low >= self.percent * high) & (self.doc[i] != self.doc[j])
        at = np.flatnonzero(fits)
        fits[at] = (self.sketch[i[at]] == self.sketch[j[at]]).sum(1) >= ALIKE
        return fits

    def add(self, family: bool, a: np.ndarray, b: np.ndarray) -> None:
        self.out.append(np.stack([np.full(len(a), int(family)), np.minimum(a, b), np.maximum(a, b)], 1))

    def small(self, start: np.ndarray, size: np.ndarray) -> None:
        """All pairs of many small leaves at once, by distance within the leaf."""
        leaf = np.repeat(np.arange(len(start)), size)
        end, at = (start + size)[leaf], np.arange(size.sum()) + (start - (np.cumsum(size) - size))[leaf]
        left, right, of = [], [], []
        for step in range(1, int(size.max(initial=1))):
            inside = at + step < end
            at, end, leaf = at[inside], end[inside], leaf[inside]
            hit = self.near(at, at + step)
            left.append(at[hit])
            right.append(at[hit] + step)
            of.append(leaf[hit])
        if left:
            left, right, of = map(np.concatenate, (left, right, of))
            many = (np.bincount(of, minlength=len(start)) > PAIRS_PER_ROW * size)[of]
            self.add(False, self.doc[left[~many]], self.doc[right[~many]])
            label = tied(len(self.doc), left[many], right[many], self.doc)
            rows = np.unique(np.concatenate([left[many], right[many]]))
            self.add(True, self.doc[rows], label[rows])

    def large(self, rows: np.ndarray) -> None:
        """All pairs of one leaf of bounded size, in order of set size."""
        rows = rows[np.argsort(self.n[rows], kind="stable")]
        n, sketch, doc = self.n[rows], self.sketch[rows], self.doc[rows]
        label, a, b, family = np.arange(len(rows)), np.zeros(0, np.int64), np.zeros(0, np.int64), False
        for at in range(0, len(rows), CHUNK):
            end = min(at + CHUNK, len(rows))
            upto = int(np.searchsorted(n, 100 * n[end - 1] // self.percent, "right"))
            hit = alike(sketch[at:end], n[at:end], sketch[at:upto], n[at:upto], self.percent)
            if family:
                hit &= label[at:end, None] != label[None, at:upto]
            i, j = np.nonzero(np.triu(hit, 1))
            i, j = i + at, j + at
            other = doc[i] != doc[j]
            a, b = np.concatenate([a, i[other]]), np.concatenate([b, j[other]])
            if len(a) > PAIRS_PER_ROW * len(rows):
                family, label = True, tied(len(rows), a, b, label)
                a = np.flatnonzero(label != np.arange(len(rows)))
                b = label[a]
        self.add(family, doc[a], doc[b])


def alike(one: np.ndarray, n1: np.ndarray, two: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    """Which sketches of ``one`` and of ``two`` can belong to similar sets, as a matrix."""
    left, right = np.ascontiguousarray(one.T), np.ascontiguousarray(two.T)
    equal = np.zeros((len(one), len(two)), np.uint8)
    for x, y in zip(left, right, strict=True):
        equal += x[:, None] == y[None, :]
    low, high = np.minimum(n1[:, None], n2[None, :]), np.maximum(n1[:, None], n2[None, :])
    return (equal >= ALIKE) & (100 * low >= percent * high)


def candidates(found: DataFrame, percent: int) -> DataFrame:
    """``family, a, b`` (a < b): near pairs of leaves, and ties between the members of a family, from ``key, doc, n, sketch``.

    Leaves of more than LEAF_ROWS rows are dealt into blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in carried(batches, ("key",)):
            start, _ = groups(rows["key"])
            size = np.diff(np.append(start, len(rows["key"])))
            leaves = Leaves(rows, percent)
            few = (size > 1) & (size <= SMALL)
            leaves.small(start[few], size[few])
            for a, m in zip(start[size > SMALL], size[size > SMALL], strict=True):
                leaves.large(np.arange(a, a + m))
            if leaves.out:
                pairs = np.unique(np.concatenate(leaves.out), axis=0)
                pairs = pairs[pairs[:, 1] < pairs[:, 2]]
                yield batch_of({"family": pairs[:, 0].astype(np.int32), "a": pairs[:, 1], "b": pairs[:, 2]})

    hot = cut(found.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > LEAF_ROWS))
    crowded = not hot.isEmpty()
    few = found.join(sized(hot.select("key")), "key", "left_anti") if crowded else found
    pairs = few.repartition("key").sortWithinPartitions("key").mapInArrow(run, "family int, a long, b long")
    if crowded:
        pairs = pairs.unionByName(crowded_ties(found.join(sized(hot), "key"), percent))
    return pairs.distinct()


def crowded_ties(found: DataFrame, percent: int) -> DataFrame:
    """``family, a, b`` of leaves too large for one task: ``key, doc, n, sketch, rows``, the latter the size of the leaf.

    Each block of a leaf meets the leaf's first block. What these ties leave outside the leaf's largest component then meets the
    whole leaf, block by block. So any two near rows of a leaf end in one family, and only ties leave a group.
    """
    keys = ["key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in carried(batches, tuple(keys)):
            start, _ = groups(*[rows[c] for c in keys])
            out = []
            for s, e in zip(start, np.append(start[1:], len(rows["doc"])), strict=True):
                outer = s + np.flatnonzero(rows["outer"][s:e] == 1)
                inner = s + np.flatnonzero(rows["outer"][s:e] == 0)
                if not len(outer) or not len(inner):
                    continue
                one, two = (np.frombuffer(b"".join(rows["sketch"][side]), np.uint8).reshape(-1, POSITIONS) for side in (outer, inner))
                n = rows["n"].astype(np.int64)
                name, place = np.unique(np.concatenate([rows["doc"][outer], rows["doc"][inner]]), return_inverse=True)
                at1, at2 = place[: len(outer)], place[len(outer) :]
                label = np.arange(len(name))
                for c in range(0, len(outer), CHUNK):
                    part = slice(c, c + CHUNK)
                    hit = alike(one[part], n[outer[part]], two, n[inner], percent)
                    hit &= rows["component"][outer[part]][:, None] != rows["component"][inner][None, :]
                    some = np.flatnonzero(hit.any(1))
                    first = hit[some].argmax(1)
                    out.append(np.stack([name[at1[c + some]], name[at2[first]]], 1))  # a near pair of each row, likely to be confirmed
                    hit &= label[at1[part]][:, None] != label[at2][None, :]
                    a, b = np.nonzero(hit)
                    label = tied(len(name), np.concatenate([np.arange(len(name)), at1[c + a]]), np.concatenate([label, at2[b]]), label)
                out.append(np.stack([name[label], name], 1))
            if out:
                pairs = np.sort(np.concatenate(out), axis=1)
                pairs = np.unique(pairs[pairs[:, 0] < pairs[:, 1]], axis=0)
                yield batch_of({"family": np.ones(len(pairs), np.int32), "a": pairs[:, 0], "b": pairs[:, 1]})

    def met(outer: DataFrame, inner: DataFrame) -> DataFrame:
        cols = [*keys, "doc", "n", "sketch", "component"]
        both = outer.select(*cols, F.lit(1).alias("outer")).unionByName(inner.select(*cols, F.lit(0).alias("outer")))
        dealt = both.repartition(*keys).sortWithinPartitions(*keys)
        return cut(dealt.mapInArrow(run, "family int, a long, b long").distinct())

    spark = found.sparkSession
    path = scratch_path(spark, "crowded")
    found.withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    alone = rows.withColumn("component", F.col("doc")).withColumn("j", F.lit(0))
    ties = met(alone.withColumn("i", F.col("block")), alone.filter("block = 0").withColumn("i", every("blocks")))
    parts = components(ties.select("a", "b")).select(F.col("id").alias("doc"), "component")
    named = rows.join(parts, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    sizes = named.groupBy("key", "component").count()
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"), (F.sum("count") - F.max("count")).alias("outside"))
    left = named.join(sized(main.filter("outside > 0")), "key").withColumn("outer_blocks", F.ceil(F.col("outside") / BLOCK_ROWS).cast("int"))
    outer = left.filter("component <> main").withColumn("i", F.pmod(F.xxhash64("doc"), "outer_blocks").cast("int")).withColumn("j", every("blocks"))
    inner = left.withColumn("i", every("outer_blocks")).withColumn("j", F.col("block"))
    return ties.unionByName(met(outer, inner))


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``doc, items``: the whole set of each listed document, as sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, row, h in shingle_sets(batch.column("text"), k):
                bounds = np.searchsorted(row, np.arange(rows + 1))
                raw = [h[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, rows), pa.array(raw, pa.binary())], names=["doc", "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sized(ids), "doc_id", "left_semi")
    return texts.mapInArrow(run, "doc long, items binary")


def confirmed(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar: ``100 * intersection >= percent * union``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    held = sets_of(docs, ids, k).repartition("doc")
    left = pairs.join(held.select(F.col("doc").alias("a"), F.col("items").alias("x")), "a")
    return left.join(held.select(F.col("doc").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct()


def within_families(docs: DataFrame, ties: DataFrame, parts: DataFrame, k: int, percent: int) -> DataFrame:
    """``a, b``: ties that join the components ``parts (id, component)`` wherever two documents of one family are similar.

    Both sides are dealt into blocks of bounded rows and items; a group is a block of documents outside the family's largest
    component against a block of the whole family.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ("family", "i", "j")
        for rows in carried(batches, keys):
            start, _ = groups(*[rows[c] for c in keys])
            out = []
            for s, e in zip(start, np.append(start[1:], len(rows["doc"])), strict=True):
                outer = s + np.flatnonzero(rows["outer"][s:e] == 1)
                inner = s + np.flatnonzero(rows["outer"][s:e] == 0)
                if not len(outer) or not len(inner):
                    continue
                one, two = ([np.frombuffer(x, np.uint64) for x in rows["items"][side]] for side in (outer, inner))
                n1, n2 = (np.array([len(x) for x in side]) for side in (one, two))
                common = shared_items(one, two)
                near = (100 * common >= percent * (n1[:, None] + n2[None, :] - common)) & (rows["component"][outer][:, None] != rows["component"][inner][None, :])
                a, b = np.nonzero(near)
                name = np.concatenate([rows["doc"][outer], rows["doc"][inner]])
                label = tied(len(name), a, len(outer) + b, name)
                out.append(np.stack([name, label], 1)[name != label])
            if out:
                pairs = np.unique(np.concatenate(out), axis=0)
                yield batch_of({"a": pairs[:, 0], "b": pairs[:, 1]})

    of = components(ties).select(F.col("id").alias("doc"), F.col("component").alias("family"))
    parts = parts.select(F.col("id").alias("doc"), "component")
    rows = cut(of.join(parts, "doc", "left").withColumn("component", F.coalesce("component", "doc")))
    sizes = rows.groupBy("family", "component").count()
    main = sizes.groupBy("family").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").drop("parts")
    open_rows = rows.join(main, "family").select("doc", "family", "component", (F.col("component") != F.col("main")).alias("outside"))
    sets = sets_of(docs, open_rows.select(F.col("doc").alias("doc_id")).distinct(), k)
    full = open_rows.join(sets, "doc").withColumn("n", F.length("items") / 8)
    path = scratch_path(docs.sparkSession, "families")
    full.write.parquet(path)
    full = docs.sparkSession.read.schema(full.schema).parquet(path)
    blocks = lambda rows, n: F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(n / BLOCK_ITEMS), F.lit(1)).cast("int")
    outside = F.col("outside").cast("int")
    dealt = full.groupBy("family").agg(
        blocks(F.sum(outside), F.sum(outside * F.col("n"))).alias("ni"), blocks(F.count(F.lit(1)), F.sum("n")).alias("nj"),
    )
    placed = full.join(dealt, "family")
    at = lambda count: F.pmod(F.xxhash64("doc"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    outer = placed.filter("outside").select("family", at("ni").alias("i"), every("nj").alias("j"), F.lit(1).alias("outer"), "doc", "component", "items")
    inner = placed.select("family", every("ni").alias("i"), at("nj").alias("j"), F.lit(0).alias("outer"), "doc", "component", "items")
    keys = ["family", "i", "j"]
    return outer.unionByName(inner).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def shared_items(one: list[np.ndarray], two: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections between the sets of two lists: products of membership matrices, some items at a time."""
    flat1, flat2 = np.concatenate(one), np.concatenate(two)
    row1, row2 = (np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (one, two))
    known = np.intersect1d(flat1, flat2)
    out = np.zeros((len(one), len(two)), np.float32)
    at1, at2 = np.searchsorted(known, flat1), np.searchsorted(known, flat2)
    in1, in2 = (known[np.minimum(at, len(known) - 1)] == flat if len(known) else np.zeros(len(flat), bool) for at, flat in ((at1, flat1), (at2, flat2)))
    row1, at1, row2, at2 = row1[in1], at1[in1], row2[in2], at2[in2]
    for low in range(0, len(known), width):
        size = min(width, len(known) - low)
        m1, m2 = np.zeros((len(one), size), np.float32), np.zeros((len(two), size), np.float32)
        for m, row, at in ((m1, row1, at1), (m2, row2, at2)):
            part = (at >= low) & (at < low + size)
            m[row[part], at[part] - low] = 1
        out += m1 @ m2.T
    return out.astype(np.int64)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each document: set size, smallest document reachable by links of ``percent``
    or more, and whether that is the document itself."""
    spark = docs.sparkSession
    path = scratch_path(spark, "signatures")
    signed(docs, k).write.parquet(path)
    rows = spark.read.schema(SIGNED).parquet(path)
    # sets of one document are their own head: only the others take part in the joins by set
    copied = cut(
        rows.filter("n > 0").groupBy("n", "c1", "c2").agg(F.min("doc_id").alias("head"), F.min_by("row", F.struct("doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("rows"))
        .filter("rows > 1")
    )
    sets = ["n", "c1", "c2"]
    many = sized(copied.select(*sets, "head", "first"))
    others = rows.filter("signature is not null").select("row", *sets).join(many, sets).filter("row <> first").select("row")
    heads = rows.filter("signature is not null").select("row", "doc_id", "n", "signature").join(sized(cut(others)), "row", "left_anti")
    count = rows.filter("n > 0").count() - (copied.agg(F.sum(F.col("rows") - 1)).first()[0] or 0)
    depth = max(2, math.ceil(math.log(max(count, 2) / LEAF) / -math.log(UNRELATED)))
    leaves = scratch_path(spark, "leaves")
    crossed(heads, depth, trees_for(percent, depth)).join(sketched(heads), "row").select("key", "doc", "n", "sketch").write.parquet(leaves)
    met = cut(candidates(spark.read.schema("key long, doc long, n int, sketch binary").parquet(leaves), percent))
    parts = components(confirmed(docs, met.select("a", "b").distinct(), k, percent))
    ties = met.filter("family = 1").select("a", "b")
    if not ties.isEmpty():
        more = within_families(docs, ties, parts, k, percent)
        parts = components(more.unionByName(parts.select(F.col("id").alias("a"), F.col("component").alias("b"))))
    found = parts.select(F.col("id").alias("head"), F.col("component").alias("component_id"))
    named = rows.select("doc_id", *sets).join(many, sets, "left").withColumn("head", F.coalesce("head", "doc_id")).join(found, "head", "left")
    reached = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "head"))
    out = named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), reached.alias("component_id"))
    unknown = docs.filter(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long").alias("doc_id"), set_size(F.col("text"), k).alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(unknown).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def set_size(text: Column, k: int) -> Column:
    """Number of distinct shingles, as a column expression."""
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    shingles = F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.when(F.size(words) >= k, F.size(F.array_distinct(shingles))).otherwise((F.size(words) > 0).cast("int")).cast("long")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: the one of the smallest ``doc_id``; rows without ``doc_id`` stay."""
    return without(docs, cut(near_duplicates(docs, k, percent).filter("not kept").select("doc_id").distinct()))
