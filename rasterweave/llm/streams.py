"""Helpers for Arrow tasks: memory given back between batches and operators, and rows sorted by a key read a group at a
time."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa


_kept: list[tuple[str | None, dict]] = []  # the module of the tasks that filled each, and what it holds for more of them
_module: str | None = None  # whose task this worker runs


def keep(cache: dict) -> None:
    """Notes that the worker holds ``cache`` for later tasks of the operator at work; a task of another one empties it."""
    if not any(c is cache for _, c in _kept):
        _kept.append((_module, cache))


def _begin(module: str) -> None:
    """Empties what other operators than ``module`` hold in this worker."""
    global _module
    _module = module
    for owner, cache in _kept:
        if owner != module:
            cache.clear()
    _kept[:] = [x for x in _kept if x[0] == module]


def _release() -> None:
    """Gives freed memory back to the system; a worker lives on for other tasks, beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run):
    """``run`` for mapInArrow, with memory released after each batch that it has done with, and at the end."""

    @functools.wraps(run)
    def wrapped(batches):
        def read():
            for batch in batches:
                yield batch
                del batch
                _release()

        _begin(run.__module__)
        try:
            yield from run(read())
        finally:
            _release()

    return wrapped


def runs(batches, keys: int):
    """Yields (key tuple, rows) for each run of rows of a batch that agree in their first ``keys`` columns, integers."""
    for batch in batches:
        if batch.num_rows:
            names = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(keys)], 1)
            at = np.flatnonzero(np.append(True, (names[1:] != names[:-1]).any(1)))
            for a, b in zip(at, np.append(at[1:], len(names)), strict=True):
                yield tuple(names[a].tolist()), batch.slice(a, b - a)


def sorted_groups(batches, keys: int):
    """Yields (key tuple, pa.Table of the group's rows) from batches sorted by their first ``keys`` columns, integers."""
    held: list[pa.RecordBatch] = []
    now = None
    for name, part in runs(batches, keys):
        if name != now:
            if held:
                yield now, pa.Table.from_batches(held)
            held, now = [], name
        held.append(part)
    if held:
        yield now, pa.Table.from_batches(held)
