"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors. Each vector is described by its nearest pivots in order; the
inverted lists are kept under every pair of these pivots, so two vectors meet exactly where they share at least two of them.
Where they meet, the cosine is computed in double precision. A pair that meets in several lists is counted in the list of its
two smallest shared pivots only. A list is cut into blocks of bounded size, and pairs of blocks are separate groups, so a list
of any length is whole and no task holds it. Within a group, links become counts and a spanning label per vector; pairs of
vectors are never rows.

Equal vectors of a label are one class with its number of members. Defined results: a vector with a null label, a null or
non-finite component, zero length, or no vector at all links with nothing; vectors of different dimensions never link; a null
``vec_id`` is linked with nothing and kept; rows that share a ``vec_id`` share a component; an empty table gives an empty result;
further columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bookloom.llm.arrays import batch_of, carried, groups
from bookloom.llm.components import components
from bookloom.llm.joins import sized
from bookloom.session import cut

NEAREST = 6  # pivots that describe a vector
MAX_PIVOTS = 256
APART = 0.8  # cosine that two pivots stay below
BLOCK_ROWS = 1024


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, vector`` (doubles) of the rows that can have links."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("vector"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(good, F.lit(False)))


def classes_of(vectors: DataFrame) -> DataFrame:
    """``label, vector, head, members``: equal vectors of a label, their smallest id and their number."""
    return usable(vectors).groupBy("label", "vector").agg(F.min("vec_id").alias("head"), F.count(F.lit(1)).alias("members"))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, which keeps the squares of huge and tiny components finite."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _sent(x: np.ndarray) -> bytes:
    """The components in four bytes each where that loses nothing, else in eight; the last byte says which."""
    with np.errstate(over="ignore", under="ignore"):
        short = x.astype(np.float32)
    return short.tobytes() + b"f" if (short == x).all() else x.tobytes() + b"d"


def _received(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[:-1], np.float32 if raw[-1:] == b"f" else np.float64).astype(np.float64)


def pivots_of(classes: DataFrame, limit: int = MAX_PIVOTS) -> np.ndarray:
    """At most ``limit`` vectors of the commonest dimension, drawn by hash; their number follows the root of the table's size.

    A vector close to a pivot is no further pivot: pivots from one dense region would be in no stable order for its vectors.
    """
    shape = classes.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if shape is None:
        return np.zeros((0, 1))
    wanted = min(limit, max(2 * NEAREST, math.isqrt(shape["count"])))
    some = classes.filter(F.size("vector") == shape["dim"]).select("vector", F.xxhash64("head").alias("o"), "head")
    part = max(1, shape["count"] // (8 * wanted))
    near = some.filter(F.pmod("o", F.lit(part)) == 0) if part > 1 else some
    rows = near.orderBy("o", "head").limit(4 * wanted).collect()
    found = np.array([r["vector"] for r in rows]).reshape(len(rows), shape["dim"])
    found = unit(found)
    picked: list[np.ndarray] = []
    for x in found:
        if len(picked) < wanted and (not picked or (np.stack(picked) @ x).max() < APART):
            picked.append(x)
    return np.stack(picked)


LISTED = "name long, pair int, head long, members long, near binary, vector binary"


def listed(classes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """One row per vector and list: ``name`` stands for the label, ``pair`` for two of the nearest pivots, ``near`` holds all of
    them, sorted.

    A vector of another dimension than the pivots is listed under that dimension (a negative pair).
    """
    sent = classes.sparkSession.sparkContext.broadcast(pivots)  # at most MAX_PIVOTS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = sent.value
        k = min(NEAREST, len(points))
        first, second = np.triu_indices(k, 1)
        for batch in batches:
            fixed = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("name", "head", "members")}
            size = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            flat, start = batch.column("vector").flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                x = unit(flat[start[at][:, None] + np.arange(dim)])
                if dim == points.shape[1] and k > 1:
                    near = np.sort(np.argsort(-(x @ points.T), axis=1, kind="stable")[:, :k], axis=1).astype(np.uint16)
                    pair = near[:, first].astype(np.int32) * 65536 + near[:, second]
                else:
                    near, pair = np.zeros((len(at), k), np.uint16), np.full((len(at), 1), -int(dim), np.int32)
                raw_near = pa.array([r.tobytes() for r in near], pa.binary())
                raw = pa.array([_sent(r) for r in flat[start[at][:, None] + np.arange(dim)]], pa.binary())
                for c in range(pair.shape[1]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(fixed["name"][at]), pa.array(pair[:, c]), pa.array(fixed["head"][at]), pa.array(fixed["members"][at]), raw_near, raw],
                        names=["name", "pair", "head", "members", "near", "vector"],
                    )

    return classes.select(F.xxhash64(F.col("label").cast("string")).alias("name"), "head", "members", "vector").mapInArrow(run, LISTED)


def _group(rows: dict[str, np.ndarray], at: slice, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Heads, counts of links that belong to this list, and smallest head tied by links of this group: among the rows of one
    block, or between the rows of two."""
    head, members, pair, across = rows["head"][at], rows["members"][at], rows["pair"][at][0], rows["across"][at][0]
    x = unit(np.stack([_received(v) for v in rows["vector"][at]]))
    left = np.flatnonzero(rows["side"][at] == 0) if across else np.arange(len(head))
    right = np.flatnonzero(rows["side"][at] == 1) if across else left
    linked = x[left] @ x[right].T >= limit
    if not across:
        np.fill_diagonal(linked, False)
    a, b = np.nonzero(linked)
    a, b = left[a], right[b]
    own = np.ones(len(a), bool)
    if pair >= 0 and len(a):
        near = np.stack([np.frombuffer(v, np.uint16) for v in rows["near"][at]]).astype(np.int64)
        has = np.zeros((len(near), int(near.max()) + 1), bool)
        has[np.arange(len(near))[:, None], near] = True
        for c in range(0, len(a), 200_000):
            p, q = a[c : c + 200_000], b[c : c + 200_000]
            shared = np.where(has[q[:, None], near[p]], near[p], 1 << 16)
            least = np.sort(shared, axis=1)[:, :2]
            own[c : c + 200_000] = least[:, 0] * 65536 + least[:, 1] == pair
    count = np.bincount(a[own], members[b[own]], len(head))
    if across:
        count += np.bincount(b[own], members[a[own]], len(head))
    label = head.copy()
    while True:  # the smallest head among linked rows, to a fixed point
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        if (least == label).all():
            return head, count.astype(np.int64), label
        label = least


def linked_counts(lists: DataFrame, limit: float) -> DataFrame:
    """``head, n, other`` per group and vector with a link: links counted there, and a smaller vector it is tied to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ("name", "pair", "i", "j")
        for rows in carried(batches, keys):
            start, _ = groups(*[rows[k] for k in keys])
            end = np.append(start[1:], len(rows["pair"]))
            found = [_group(rows, slice(s, e), limit) for s, e in zip(start, end, strict=True) if e - s > 1]
            if found:
                head, n, other = (np.concatenate(c) for c in zip(*found, strict=True))
                keep = (n > 0) | (other != head)
                yield batch_of({"head": head[keep], "n": n[keep], "other": other[keep]})

    keys = ["name", "pair", "i", "j"]
    return lists.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "head long, n long, other long")


def near_duplicates(vectors: DataFrame, similarity: float = 0.98, pivots: int = MAX_PIVOTS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each vector: other vectors linked directly, the smallest reachable one, and
    whether that is the vector itself."""
    classes = cut(classes_of(vectors))
    rows = listed(classes, pivots_of(classes, pivots))
    blocks = rows.groupBy("name", "pair").count().select("name", "pair", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks")).filter("blocks > 1")
    # a list of blocks has BLOCK_ROWS rows at least, so these are few; counted before they are broadcast
    placed = rows.join(sized(blocks), ["name", "pair"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("head"), F.col("blocks")).cast("int"))
    spread = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")).select(
        "name", "pair", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), (F.col("block") != F.col("with")).alias("across"),
        (F.col("block") > F.col("with")).cast("int").alias("side"), "head", "members", "near", "vector",
    )
    found = cut(linked_counts(spread, similarity))
    counted = found.groupBy("head").agg(F.sum("n").alias("n"))
    tied = components(found.select(F.col("head").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "head")
    known = classes.join(counted, "head", "left").join(tied, "head", "left").select(
        "label", "vector", (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component", "head").alias("component_id"),
    )
    good = usable(vectors).join(known, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    rest = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).exceptAll(good.select("vec_id")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
