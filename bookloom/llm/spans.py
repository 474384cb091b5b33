"""Positions of pattern matches as column expressions (JVM only)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def any_case(words: str) -> str:
    """A pattern with each ASCII letter in either case, spelled out so that every engine agrees."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in words)


def located(text: Column, matches: Column, pattern: str, kind: str) -> Column:
    """``matches`` (all matches of ``pattern``, in order) with code point positions, end exclusive.

    ``split`` gives the text between matches, so a start is what was passed before it.
    """
    empty = F.array().cast(SPAN)
    pieces = F.split(text, pattern, -1)
    state = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc, i):
        start = acc["at"] + F.length(F.get(pieces, i))
        value = F.get(matches, i)
        end = start + F.length(value)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), value.alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    found = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), state, step, lambda acc: acc["out"])
    return F.when(F.size(matches) > 0, found).otherwise(empty)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
