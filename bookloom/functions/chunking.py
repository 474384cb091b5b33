"""Paragraph-preserving chunkers as folds over arrays, one document per row and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bookloom import settings as S
from bookloom.functions.text import clean, let, paragraphs, sentences


def _none() -> Column:
    return F.array().cast("array<string>")


def pack(units: Column, limit: int, glue: str) -> Column:
    """Greedy packing: append a unit to the open block while the block stays within ``limit``.

    The length of the open block is carried along, not counted again at every unit.
    """
    start = F.struct(_none().alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n"))

    def block(done: Column, open_: Column, n: Column) -> Column:
        return F.struct(done.alias("done"), open_.alias("open"), n.alias("n"))

    def step(acc: Column, unit: Column) -> Column:
        longer = acc["n"] + F.length(unit) + len(glue)
        return (
            F.when(acc["open"].isNull(), block(acc["done"], unit, F.length(unit)))
            .when(longer > limit, block(F.concat(acc["done"], F.array(acc["open"])), unit, F.length(unit)))
            .otherwise(block(acc["done"], F.concat(acc["open"], F.lit(glue), unit), longer))
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["open"].isNull(), acc["done"]).otherwise(
            F.concat(acc["done"], F.array(acc["open"]))
        )

    return F.aggregate(units, start, step, finish)


def _carry_tail(units: Column, size: int, overlap: int) -> Column:
    """After a piece longer than ``size``, the first sentence of its tail opens the next piece."""
    start = F.struct(_none().alias("done"), F.lit("").alias("tail"))

    def tail_of(piece: Column) -> Column:
        return let(
            F.right(piece, F.lit(overlap)),
            lambda t: F.when(t == "", F.lit("")).otherwise(
                F.concat(F.coalesce(F.get(sentences(t), 0), F.lit("")), F.lit(" "))
            ),
        )

    def step(acc: Column, unit: Column) -> Column:
        return let(
            F.concat(acc["tail"], unit),
            lambda piece: F.struct(
                F.concat(acc["done"], F.array(piece)).alias("done"),
                F.when(F.length(piece) > size, tail_of(piece)).otherwise(F.lit("")).alias("tail"),
            ),
        )

    return F.aggregate(units, start, step, lambda acc: acc["done"])


def chunk_text(text: Column, size: int = 900, overlap: int = 120) -> Column:
    """Array of chunks of about ``size`` characters; whole paragraphs or whole sentences."""

    def unit_list(p: Column) -> Column:
        return F.when(F.length(p) <= size, F.array(p)).otherwise(
            let(sentences(p), lambda s: F.when(F.size(s) <= 1, F.array(p)).otherwise(pack(s, size, " ")))
        )

    def cut_up(t: Column) -> Column:
        units = F.flatten(F.transform(paragraphs(t), unit_list))
        return _carry_tail(pack(units, size, "\n\n"), size, overlap)

    return let(
        clean(text),
        lambda t: F.when(t == "", _none()).when(F.length(t) <= size, F.array(t)).otherwise(cut_up(t)),
    )


def chunk_into_parents(text: Column, size: int = S.PARENT_SIZE) -> Column:
    """Array of parent blocks: paragraphs packed up to ``size``, never cut."""
    return let(
        clean(text),
        lambda t: F.when(t == "", _none())
        .when(F.length(t) <= size, F.array(t))
        .otherwise(pack(paragraphs(t), size, "\n\n")),
    )


def passages(
    text: Column,
    parent_size: int = S.PARENT_SIZE,
    child_size: int = S.CHILD_SIZE,
    child_overlap: int = S.CHILD_OVERLAP,
) -> Column:
    """One struct per child: ``(parent_pos, child_pos, text, parent_text)``.

    ``parent_text`` is set on the first child of each parent only, so a single explode yields the
    chunk table and, filtered on ``child_pos = 0``, the parent table with its first chunk index.
    """

    def children(parent: Column, i: Column) -> Column:
        kids = let(
            chunk_text(parent, child_size, child_overlap),
            lambda c: F.when(F.size(c) == 0, F.array(parent)).otherwise(c),
        )
        return F.transform(
            kids,
            lambda t, j: F.struct(
                i.cast("int").alias("parent_pos"),
                j.cast("int").alias("child_pos"),
                t.alias("text"),
                F.when(j == 0, parent).alias("parent_text"),
            ),
        )

    return F.flatten(F.transform(chunk_into_parents(text, parent_size), children))
