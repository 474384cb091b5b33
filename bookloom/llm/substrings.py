"""Repeated word windows across documents, found by difference-cover anchors.

Anchors are runs of ``LENGTH - PERIOD + 1`` words at positions whose remainder by PERIOD lies in a difference cover: for any two
positions there is a shift below PERIOD that takes both into the cover, so two equal windows always share an anchor. Anchors
found in more than one text are extended: only windows around them are compared, by 96-bit hashes.

Exact copies travel without their text: a task sends each text once, and a copy of a smaller document needs no windows. Keys
that meet within a task are settled there, so a frequent passage sends one row per task and not one per document.

Defined results: null or empty text has no words; fewer words than a window are never removed; documents without ``doc_id``
neither remove nor lose words; rows that share a ``doc_id`` do not remove each other's words; further columns do not matter; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from bookloom.llm.arrays import Arrays, batch_of, carried, collected, groups
from bookloom.llm.words import mixed, prefix_hash, range_hash, slices

LENGTH = 13
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = LENGTH - PERIOD + 1
KEY_BITS = 32
BUCKETS_PER_PARTITION = 4
def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words; texts of a window or more go on once per batch, with the smallest document."""
    for batch in batches:
        counts = np.zeros(batch.num_rows, np.int64)
        for s in slices(batch.column("text")):
            counts[s.first : s.first + s.rows] = s.counts
        doc, c1, c2 = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("doc_id", "c1", "c2"))
        order = np.lexsort((doc, c2, c1))
        start, group = groups(c1[order], c2[order])
        smallest = np.empty(len(order), bool)
        smallest[order] = doc[order] == doc[order][start][group] if len(order) else True
        text = pa.compute.if_else(pa.array(smallest | (counts < LENGTH)), batch.column("text").fill_null(""), None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("c1"), batch.column("c2"), pa.array(counts), text], names=["doc_id", "c1", "c2", "n_words", "text"])


def anchors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Anchors of whole texts, packed by bucket; those of several texts of this task are settled here."""

    def found() -> Iterator[Arrays]:
        for batch in batches:
            _, once = np.unique(batch.column("c1").to_numpy(zero_copy_only=False), return_index=True)
            batch = batch.take(pa.array(np.sort(once)))
            c1 = batch.column("c1").to_numpy(zero_copy_only=False)
            for s in slices(batch.column("text")):
                prefix, row = prefix_hash(s.hashes()), s.row_of_word
                pos = np.arange(len(row)) - (np.cumsum(s.counts) - s.counts)[row]
                at = np.flatnonzero(np.isin(pos % PERIOD, COVER) & (s.counts[row] - pos >= ANCHOR) & (s.counts[row] >= LENGTH))
                yield {"key": range_hash(prefix, at, at + ANCHOR), "c1": c1[s.first + row[at]], "pos": pos[at].astype(np.int32)}

    for rows in collected(found()):
        order = np.lexsort((rows["pos"], rows["c1"], rows["key"]))
        key, c1, pos = rows["key"][order], rows["c1"][order], rows["pos"][order]
        start, group = groups(key)
        several = (c1[np.append(start[1:], len(key)) - 1] != c1[start])[group]
        head = np.zeros(len(key), bool)
        head[start] = True
        send = ~several | head
        yield from packed(key[send], c1[send], pos[send], buckets)
        # settled here: on their way to their text, spread by it
        yield from packed(None, c1[several], pos[several], buckets)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (((key >> np.uint64(KEY_BITS)) * np.uint64(buckets)) >> np.uint64(64 - KEY_BITS)).astype(np.int64)


PACKED = "bucket int, keys binary, low binary, high binary, texts binary, counts binary"


def packed(key: np.ndarray | None, c1: np.ndarray, pos: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """One row per bucket. Upper key bits name the bucket; KEY_BITS more travel, which is enough for anchors: they only filter,
    and a false meeting costs a comparison of windows. Positions and texts travel as numbers and runs."""
    if not len(c1):
        return
    bucket = bucket_of(mixed(c1.view(np.uint64)) if key is None else key, buckets)
    order = np.lexsort((pos, c1, bucket))
    bucket, c1, pos = bucket[order], c1[order], pos[order].astype(np.uint32)
    low = None if key is None else key[order]
    start, _ = groups(bucket)
    rows = []
    for a, b in zip(start, np.append(start[1:], len(bucket)), strict=True):
        run, _ = groups(c1[a:b])
        k = b"" if low is None else low[a:b].astype(np.uint32).tobytes()
        rows.append((int(bucket[a]), k, pos[a:b].astype(np.uint16).tobytes(), (pos[a:b] >> 16).astype(np.uint16).tobytes(), c1[a:b][run].tobytes(), np.diff(np.append(run, b - a)).astype(np.uint32).tobytes()))
    columns = list(zip(*rows, strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "keys", "low", "high", "texts", "counts"])


def unpacked(row: dict) -> Arrays:
    counts = np.frombuffer(row["counts"], np.uint32)
    pos = np.frombuffer(row["low"], np.uint16).astype(np.int32) | (np.frombuffer(row["high"], np.uint16).astype(np.int32) << 16)
    out = {"c1": np.repeat(np.frombuffer(row["texts"], np.int64), counts), "pos": pos}
    if row["keys"]:
        out["key"] = np.frombuffer(row["keys"], np.uint32)
    return out


def shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of more than one text; rows come sorted by bucket."""
    held: list[Arrays] = []
    at = None

    def settle() -> Iterator[pa.RecordBatch]:
        if held:
            rows = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            order = np.lexsort((rows["c1"], rows["key"]))
            key, c1 = rows["key"][order], rows["c1"][order]
            start, group = groups(key)
            several = (c1[np.append(start[1:], len(key)) - 1] != c1[start])[group]
            yield batch_of({"c1": c1[several], "pos": rows["pos"][order][several]})
            held.clear()

    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != at:
                yield from settle()
                at = row["bucket"]
            rows = unpacked(row)
            if "key" in rows:
                held.append(rows)
            else:
                yield batch_of({"c1": rows["c1"], "pos": rows["pos"]})
    yield from settle()


def runs(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> Arrays:
    """Adjacent positions of a text as (first, number)."""
    order = np.lexsort((pos, tag, doc))
    doc, tag, pos = doc[order], tag[order], pos[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (pos[1:] - pos[:-1] > 1)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(doc))[: len(start)] - 1
    return {"doc": doc[start], "tag": tag[start], "pos": pos[start].astype(np.int32), "n": (pos[end] - pos[start] + 1).astype(np.int32)}


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that hold a shared anchor, of the first document of each text. Those also found in a smaller document of this task
    are settled here."""

    def found() -> Iterator[Arrays]:
        for batch in batches:
            # a filter in the plan would move below the shuffle of the texts and keep it from being shared
            compute = pa.compute
            source = compute.and_(compute.equal(batch.column("doc_id"), batch.column("first_doc")), compute.and_(compute.is_valid(batch.column("text")), compute.greater_equal(batch.column("n_words"), LENGTH)))
            batch = batch.filter(source)
            doc, c1 = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("doc_id", "c1"))
            lists = batch.column("places")
            for s in slices(batch.column("text")):
                h = s.hashes()
                one, two = prefix_hash(h), prefix_hash(mixed(h ^ np.uint64(0xA5A5A5A55A5A5A5A)))
                first = np.cumsum(s.counts) - s.counts
                part = lists.slice(s.first, s.rows)
                size = part.value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(s.rows), size)
                place = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                # starts from place - (LENGTH - ANCHOR) to place, kept inside the text, as marks on the words of the slice
                low = first[row] + np.maximum(place - (LENGTH - ANCHOR), 0)
                high = first[row] + np.minimum(place, s.counts[row] - LENGTH) + 1
                fits = high > low
                level = np.zeros(len(h) + 1, np.int64)
                np.add.at(level, low[fits], 1)
                np.add.at(level, high[fits], -1)
                at = np.flatnonzero(np.cumsum(level[:-1]) > 0)
                owner = s.row_of_word[at]
                yield {
                    "key": range_hash(one, at, at + LENGTH).view(np.int64), "key2": range_hash(two, at, at + LENGTH).astype(np.uint32).view(np.int32),
                    "doc": doc[s.first + owner], "tag": (c1[s.first + owner] & 0x7FFF).astype(np.int16), "pos": (at - first[owner]).astype(np.int32),
                }

    for rows in collected(found()):
        order = np.lexsort((rows["doc"], rows["key2"], rows["key"]))
        start, group = groups(rows["key"][order], rows["key2"][order])
        later = np.empty(len(order), bool)
        later[order] = rows["doc"][order] > rows["doc"][order][start][group]
        # rows leave in the order of the texts: neighbours share most bytes, which a shuffle compresses
        yield batch_of({**{k: v[~later] for k, v in rows.items()}, "n": np.zeros((~later).sum(), np.int32)})
        settled = runs(rows["doc"][later], rows["tag"][later], rows["pos"][later])
        spread = mixed(settled["doc"].view(np.uint64)).view(np.int64)
        yield batch_of({"key": spread, "key2": np.zeros(len(spread), np.int32), **settled})


def repeated_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that a smaller document has too; rows come sorted by (settled, key, key2, doc)."""
    smallest: tuple | None = None
    for batch in batches:
        rows = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        if not batch.num_rows:
            continue
        start, group = groups(rows["n"] > 0, rows["key"], rows["key2"])
        least = rows["doc"][start].copy()
        head = (rows["n"][0] > 0, rows["key"][0], rows["key2"][0])
        if smallest is not None and smallest[0] == head:
            least[0] = smallest[1]
        end = len(group) - 1
        smallest = ((rows["n"][end] > 0, rows["key"][end], rows["key2"][end]), least[-1])
        settled, later = rows["n"] > 0, rows["doc"] > least[group]
        fresh = later & ~settled
        yield batch_of(runs(rows["doc"][fresh], rows["tag"][fresh], rows["pos"][fresh]))
        yield batch_of({k: rows[k][settled] for k in ("doc", "tag", "pos", "n")})


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of words and removed words, and the hash of the kept text."""
    none = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        removed, hashes = [], []
        texts = batch.column("text").cast(pa.binary())
        for text, n, copy, ranges in zip(texts, batch.column("n_words").to_pylist(), batch.column("is_copy").to_pylist(), batch.column("ranges"), strict=True):
            if copy and n >= LENGTH:
                removed.append(n)
                hashes.append(none)
                continue
            words = (text.as_py() or b"").split()
            spans = ranges.as_py() or ()
            if spans:
                gone = np.zeros(n + 1, np.int64)
                for r in spans:
                    gone[r["pos"]] += 1
                    gone[r["pos"] + r["n"] + LENGTH - 1] -= 1
                keep = np.cumsum(gone[:-1]) == 0
                words = [w for w, k in zip(words, keep, strict=True) if k]
            removed.append(n - len(words))
            hashes.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(hashes, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def same(a: str, b: str):
    """Equality that stays a condition of a join and does not become one of its keys, so one shuffle by ``c1`` serves all joins."""
    return F.col(a).bitwiseXOR(F.col(b)) == 0


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("c1"), F.xxhash64(F.lit("again"), text).alias("c2"))
    known = rows.filter(F.col("doc_id").isNotNull())
    outline = known.mapInArrow(thin, "doc_id long, c1 long, c2 long, n_words long, text string")
    first = known.groupBy(F.col("c1").alias("m1"), F.col("c2").alias("m2")).agg(F.min("doc_id").alias("first_doc"))
    buckets = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = (
        known.select("c1", "text").mapInArrow(lambda b: anchors(b, buckets), PACKED)
        .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(shared_anchors, "c1 long, pos int")
        .groupBy(F.col("c1").alias("p1")).agg(F.collect_list("pos").alias("places"))
    )
    by_text = outline.repartition("c1")
    sources = by_text.join(places, F.col("c1") == F.col("p1")).join(first, (F.col("c1") == F.col("m1")) & same("c2", "m2"))
    covered = (
        sources.select("doc_id", "c1", "n_words", "text", "places", "first_doc").mapInArrow(windows, "key long, key2 int, doc long, tag short, pos int, n int")
        .repartition("key").sortWithinPartitions(F.col("n") > 0, "key", "key2", "doc").mapInArrow(repeated_windows, "doc long, tag short, pos int, n int")
        .groupBy(F.col("doc").alias("r_doc"), "tag").agg(F.collect_list(F.struct("pos", "n")).alias("ranges"))
        .join(first.select(F.col("m1").alias("r1"), F.col("first_doc").alias("r_doc"), F.col("m1").bitwiseAND(F.lit(0x7FFF)).cast("short").alias("tag")), ["r_doc", "tag"])
    )
    joined = (
        by_text.join(first, (F.col("c1") == F.col("m1")) & same("c2", "m2"))
        .join(covered, (F.col("c1") == F.col("r1")) & same("doc_id", "r_doc"), "left")
        .select("doc_id", "n_words", "text", (F.col("doc_id") > F.col("first_doc")).alias("is_copy"), "ranges")
    )
    out = joined.mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    w = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    unknown = rows.filter(F.col("doc_id").isNull()).select("doc_id", F.size(w).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.sha2(F.array_join(w, " "), 256).alias("kept_sha256"))
    return out.unionByName(unknown)
