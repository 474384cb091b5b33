"""Columns of Arrow batches as numpy arrays: collected, grouped, and cut at group borders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

HELD_ROWS = 400_000  # rows a task holds before it settles them; memory, not a limit

Arrays = dict[str, np.ndarray]


def batch_of(arrays: Arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in arrays.values()], names=list(arrays))


def collected(chunks: Iterator[Arrays], size: int = HELD_ROWS) -> Iterator[Arrays]:
    """Chunks put together to about ``size`` rows."""
    held, rows = [], 0
    for chunk in chunks:
        held.append(chunk)
        rows += len(next(iter(chunk.values())))
        if rows >= size:
            yield {k: np.concatenate([c[k] for c in held]) for k in chunk}
            held, rows = [], 0
    if rows:
        yield {k: np.concatenate([c[k] for c in held]) for k in held[0]}


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by ``keys``: start of each group, and the group of each row."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new), np.cumsum(new) - 1


def carried(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[Arrays]:
    """Batches of rows sorted by ``keys``, cut anew so that each group is whole."""
    held: Arrays | None = None
    for batch in batches:
        now = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        if held is not None:
            now = {n: np.concatenate([held[n], now[n]]) for n in now}
        start, _ = groups(*[now[k] for k in keys])
        last = int(start[-1]) if len(start) else 0
        if last:
            yield {n: v[:last] for n, v in now.items()}
            held = {n: v[last:] for n, v in now.items()}
        else:
            held = now
    if held is not None and len(next(iter(held.values()))):
        yield held
