"""Helpers for functions over Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of sorted batches regrouped: one batch for each run of equal (integer) keys."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not len(b):
            continue
        k = np.stack([np.asarray(b.column(c), np.int64) for c in keys])
        at = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1), len(b)]
        for lo, hi in zip(at[:-1], at[1:]):
            key = tuple(k[:, lo])
            if held and key != now:
                yield pa.concat_batches(held)
                held = []
            now = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.concat_batches(held)


def give_back() -> None:
    """Memory that a task has freed goes back to the machine, as workers live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass
