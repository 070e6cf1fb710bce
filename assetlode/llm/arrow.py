"""Small helpers for functions over Arrow batches; columns that are only passed on stay as they are, nulls and all."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


#: Caches that workers keep between tasks.
_caches: list = []


def kept_by_workers(cache):
    """Marks an ``lru_cache`` that tasks of its own module share; workers empty it when they turn to another module's rows."""
    _caches.append(cache)
    return cache


def turn_to(module: str) -> None:
    for cache in _caches:
        if cache.__module__ != module:
            cache.cache_clear()


def give_back() -> None:
    """Free memory goes back to the system: idle workers count against their executor's limit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, pa.Array] | None], schema: str, rows: int = 500) -> DataFrame:
    """``fn`` over slices of at most ``rows`` rows; it returns the columns of ``schema``."""

    module = fn.__module__

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out:
                    yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(module)
        yield from slices(batches)
        give_back()

    return df.mapInArrow(run, schema)


def lists(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column, without copies."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def list_array(rows: list[np.ndarray], kind: pa.DataType = pa.int32()) -> pa.ListArray:
    ends = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    flat = np.concatenate(rows) if rows else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def longs(values) -> pa.Array:
    return pa.array(values, pa.int64())


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The groups of a stream that is sorted by ``keys``, each as one batch; a group may begin in one batch and end in another."""
    pending: list[pa.RecordBatch] = []
    last = None

    def joined() -> pa.RecordBatch:
        return pending[0] if len(pending) == 1 else pa.Table.from_batches(pending).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, z in zip(starts[:-1], starts[1:]):
            key = tuple(c[a] for c in columns)
            if pending and key != last:
                yield joined()
                pending = []
            last = key
            pending.append(batch.slice(a, z - a))
    if pending:
        yield joined()
        pending = []
    give_back()
