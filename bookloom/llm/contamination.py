"""Benchmark decontamination: item-sized windows, SimHash within a radius, exact weighted-shingle similarity.

Words are runs of characters other than white space, A-Z in lower case; a shingle is five words (a shorter item is one shingle)
and weighs its characters. A window that resembles its item shares a shingle with it at the same place; so windows are formed where
a shingle of an item occurs, at the start that its place in the item implies. A window inside the text that is shifted against
all of these shares fewer shingles with the item than they do. A window
and the items of its length are candidates where their 64-bit fingerprints agree in one of ``radius + 1`` blocks: by the
pigeonhole principle every pair within the radius is found. Candidates within the radius are verified on their weighted
shingles. All of it is column expressions and joins.

Defined results: null or empty texts and items match nothing; rows that share a ``doc_id`` are one document, as are rows without
one; repeated items each match; a window cut off by the start or end of a text is compared as it is; among equal similarities
the first window is reported; further columns do not matter; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bookloom.llm.joins import without
from bookloom.session import cut

SHINGLE = 5
BITS = 64
MAX_BROADCAST_SHINGLES = 500_000  # about 32 bytes each
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def fenced(df: DataFrame, *columns: Column, **one: Column) -> DataFrame:
    """``df.select(*columns, name=expression)`` with the expression evaluated once, whatever is filtered above."""
    (name, expression), = one.items()
    return df.select(*columns, F.explode(F.array(expression)).alias(name))


def grams(w: Column, k: int) -> Column:
    """Hash of every run of ``k`` words, in order; empty for fewer words."""
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(F.size(w) >= k, runs).otherwise(F.array().cast("array<bigint>"))


def weighted(w: Column) -> Column:
    """Distinct shingles of a window or item as (hash, weight)."""
    k = F.least(F.lit(SHINGLE), F.size(w))

    def one(i):
        run = F.array_join(F.slice(w, i + 1, k), " ")
        return F.struct(F.xxhash64(run).alias("h"), F.length(run).alias("w"))

    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - k), one))


def weight(shingles: Column) -> Column:
    return F.aggregate(shingles, F.lit(0).cast("long"), lambda acc, s: acc + s["w"])


def simhash(shingles: Column) -> Column:
    """Bit b is set where the weights of the shingles with bit b outweigh the others."""
    side = lambda b: F.aggregate(shingles, F.lit(0).cast("long"), lambda acc, s: acc + s["w"] * (F.getbit(s["h"], b) * 2 - 1))
    bits = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.when(side(b) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return F.aggregate(F.reverse(bits), F.lit(0).cast("long"), lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(bit))


def block_keys(fingerprint: Column, radius: int) -> Column:
    """``radius + 1`` (number, value) keys over all bits."""
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[
        F.struct(F.lit(i).alias("block"), F.shiftright(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"))
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
    ])


def items_of(benchmark: DataFrame) -> DataFrame:
    rows = fenced(benchmark, "item_id", w=words(F.col("text"))).filter(F.size("w") > 0)
    shingled = fenced(rows, "item_id", "w", shingles=weighted(F.col("w")))
    return cut(shingled.select("item_id", "w", F.size("w").alias("n"), "shingles", simhash(F.col("shingles")).alias("fingerprint")))


def windows_of(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, start, n, w``: windows of an item's length where document and item share a shingle on a diagonal.

    Only the first of a run of shared shingles forms the window, so a copied item gives one row and not one per shingle. The
    item side is broadcast after its size was counted; a larger one is joined by shuffle.
    """
    short = [r["n"] for r in items.filter(F.col("n") < SHINGLE).select("n").distinct().collect()]  # at most four lengths
    sizes = [*short, SHINGLE]
    cut_up = fenced(docs, "doc_id", w=words(F.col("text"))).filter(F.size("w") > 0)
    found = None
    for k in sizes:
        mine = items.filter((F.col("n") >= SHINGLE) if k == SHINGLE else (F.col("n") == k))
        hashed = fenced(mine, "item_id", "n", g=grams(F.col("w"), k))
        places = hashed.select("n", F.posexplode("g").alias("at", "h"), "g").select("h", "n", "at", F.get("g", F.col("at") - 1).alias("before")).distinct()
        if places.count() <= MAX_BROADCAST_SHINGLES:
            places = F.broadcast(places)
        runs = fenced(cut_up, "doc_id", "w", g=grams(F.col("w"), k))
        hits = runs.select("doc_id", "w", "g", F.posexplode("g").alias("pos", "h")).join(places, "h")
        new = (F.col("pos") == 0) | F.col("before").isNull() | (F.get("g", F.col("pos") - 1) != F.col("before"))
        start = F.greatest(F.col("pos") - F.col("at"), F.lit(0))
        end = F.least(F.col("pos") - F.col("at") + F.col("n"), F.size("w"))
        part = hits.filter(new).select("doc_id", start.alias("start"), "n", F.slice("w", start + 1, end - start).alias("w"))
        found = part if found is None else found.unionByName(part)
    return found


def matches(docs: DataFrame, benchmark: DataFrame, radius: int = 20, threshold: int = 80) -> DataFrame:
    """``doc_id, item_id, start, hamming, similarity`` of the best window of each document and item at ``threshold`` percent or more."""
    items = items_of(benchmark)
    windows = fenced(windows_of(docs, items), "doc_id", "start", "n", shingles=weighted(F.col("w"))).distinct()
    windows = cut(windows.select("*", simhash(F.col("shingles")).alias("fingerprint")))
    key = lambda df, *cols: df.select(*cols, F.col("fingerprint"), F.explode(block_keys(F.col("fingerprint"), radius)).alias("key"))
    mine = key(windows.select("n", "fingerprint").distinct(), "n").select("n", "key", F.col("fingerprint").alias("fw"))
    theirs = key(items.select("n", "fingerprint").distinct(), "n").select("n", "key", F.col("fingerprint").alias("fi"))
    hamming = F.bit_count(F.col("fw").bitwiseXOR(F.col("fi")))
    near = mine.join(theirs, ["n", "key"]).select("n", "fw", "fi", hamming.alias("hamming")).filter(F.col("hamming") <= radius).distinct()
    pairs = (
        windows.withColumnRenamed("fingerprint", "fw").join(near, ["n", "fw"])
        .join(items.select("n", F.col("fingerprint").alias("fi"), "item_id", F.col("shingles").alias("theirs")), ["n", "fi"])
    )
    scored = pairs.select(
        "doc_id", "item_id", "start", "hamming",
        weight(F.array_intersect("shingles", "theirs")).alias("common"), weight(F.array_union("shingles", "theirs")).alias("either"),
    ).filter(100 * F.col("common") >= threshold * F.col("either"))
    best = F.max_by(F.struct("start", "hamming", (F.col("common") / F.col("either")).alias("similarity")), F.struct(F.col("common") / F.col("either"), -F.col("start")))
    return scored.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.start", "b.hamming", "b.similarity")


def clean(docs: DataFrame, benchmark: DataFrame, radius: int = 20, threshold: int = 80) -> DataFrame:
    """``docs`` without the documents that hold an item; rows without ``doc_id`` stay."""
    return without(docs, cut(matches(docs, benchmark, radius, threshold).select("doc_id").distinct()))
