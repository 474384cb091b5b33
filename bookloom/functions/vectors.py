"""Vector expressions: similarity and the deterministic default embedding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bookloom import settings as S
from bookloom.functions.text import let


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def _norm(a: Column) -> Column:
    """Euclidean length; a zero vector counts as length one."""
    return let(F.sqrt(_total(F.transform(a, lambda x: x * x))), lambda n: F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for missing, empty or unequal-length vectors."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = _total(F.zip_with(a, b, lambda x, y: x * y))
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(usable, dot / (_norm(a) * _norm(b))).otherwise(F.lit(0.0))


def hash_embedding(content: Column, dim: int = S.EMBED_DIM) -> Column:
    """Unit vector from the SHA-256 bytes of a text or a byte string, repeated up to ``dim``."""
    digest_bytes = let(
        F.sha2(content.cast("binary"), 256),
        lambda digest: F.transform(
            F.sequence(F.lit(0), F.lit(31)),
            lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0,
        ),
    )
    raw = let(
        digest_bytes, lambda b: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.get(b, i % 32))
    )
    return let(raw, lambda v: let(_norm(v), lambda n: F.transform(v, lambda x: x / n)))
