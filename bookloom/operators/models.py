"""Plug points for models, with deterministic defaults that need no network.

A model runs inside tasks over Arrow batches; it is loaded once per task by ``load``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from bookloom.functions.text import words


def model_map(
    df: DataFrame,
    fields: str,
    call: Callable[[dict], dict],
    load: Callable[[], object] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Append model output columns (``fields``, a DDL string) and ``error`` to every row.

    ``call(row)`` (or ``call(row, model)`` with ``load``) returns the fields as a dict. A row whose
    call fails keeps null fields and carries the message. ``tasks`` bounds how many calls run at once.
    """
    extra = T.StructType.fromDDL(fields)
    names = [f.name for f in extra]
    schema = T.StructType([*df.schema.fields, *extra.fields, T.StructField("error", T.StringType())])
    kept = list(df.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load() if load else None
        for batch in batches:
            replies, errors = [], []
            for row in batch[kept].to_dict("records"):
                try:
                    reply = (call(row, model) if load else call(row)) or {}
                    errors.append(None)
                except Exception as exc:  # noqa: BLE001 - one bad row must not fail the batch
                    reply = {}
                    errors.append(f"{type(exc).__name__}: {exc}")
                replies.append(reply)
            out = batch[kept].copy()
            for n in names:
                out[n] = pd.Series([r.get(n) for r in replies], index=out.index, dtype=object)
            out["error"] = pd.Series(errors, index=out.index, dtype=object)
            yield out

    rows = df.repartition(tasks) if tasks else df
    return rows.mapInPandas(run, schema)


def batch_embedder(load: Callable[[], object], encode: Callable[[object, list], list], batch: int = 16):
    """A user model as an embedding function ``(column, dim) -> array<float>``, loaded once per task."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            out: list = []
            for at in range(0, len(part), batch):
                out.extend([list(map(float, v)) for v in encode(model, list(part.iloc[at : at + batch]))])
            yield pd.Series(out, index=part.index)

    return lambda column, dim=None: embed(column)


def pair_scorer(load: Callable[[], object], score: Callable[[object, list], list]):
    """A cross-encoder as a column ``(question, text) -> double``; texts are cut to 1500 characters."""

    @F.pandas_udf(T.DoubleType())
    def scored(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for question, text in parts:
            yield pd.Series([float(s) for s in score(model, list(zip(question, text)))], index=question.index)

    return lambda question, text: scored(question, F.substring(text, 1, 1500))


def contains_claim(claim: Column, context: Column, share: float = 0.6) -> Column:
    """Default judge: enough of the claim's words occur in the context."""
    return _holds(claim, _context_words(context), share)


def _context_words(context: Column) -> Column:
    return F.array_distinct(words(F.lower(context)))


def _holds(claim: Column, held: Column, share: float = 0.6) -> Column:
    c = F.array_distinct(words(F.lower(claim)))
    return F.size(F.array_intersect(c, held)) / F.greatest(F.size(c), F.lit(1)) >= share


# A judge may read a context once for many claims: what it makes of the context, and its verdict from that.
contains_claim.reads, contains_claim.decides = _context_words, _holds


def never_contradicts(df: DataFrame) -> DataFrame:
    """Default contradiction judge: without a model nothing is called a conflict."""
    return df.withColumn("contradicts", F.lit(False)).withColumn("reason", F.lit(""))


def extractive_answer(context: Column) -> Column:
    """Default generator: the first source block, cited."""
    return F.when(F.size("citations") > 0, F.concat(context, F.lit(" [1]"))).otherwise(
        F.lit("The sources hold no answer.")
    )
