"""Words and their hashes, as several operators take them from texts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo `modulus`; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def word_ids(text: bytes) -> np.ndarray:
    """64-bit ids of the words of a text: A-Z in lower case, split at space and the control characters 9 to 13.

    `bytes.lower` and `bytes.split` know only ASCII, which is what is wanted.
    """
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all 64 bits, one to one."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_1
    h = (h ^ (h >> np.uint64(27))) * _MIX_2
    return h ^ (h >> np.uint64(31))


def chained(parts: Iterable[np.ndarray], seed: int = 0) -> np.ndarray:
    """Hashes of the sequences that the parts hold position by position; the order of the parts counts."""
    h = np.array([seed], np.uint64)
    for part in parts:
        h = h * _MULTIPLIER + part
    return mixed(h)


def shingles(ids: np.ndarray, size: int) -> np.ndarray:
    """The distinct runs of `size` words, sorted; a shorter text is one run as a whole, an empty one has none."""
    if not len(ids):
        return ids
    if len(ids) < size:
        return chained([ids[i : i + 1] for i in range(len(ids))], seed=len(ids))
    ends = len(ids) - size + 1
    return np.unique(chained([ids[i : i + ends] for i in range(size)]))


def repeated(values: Iterable[np.ndarray], share: int | None, block: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Values that may be frequent in the whole data, with their counts here, and the number of values looked at.

    Works on blocks of about `block` values. A value that makes up 1/`share` of all data makes up as much of at least
    one block, so no such value is missed, whatever the order of the data; the rest is left out to save shuffling.
    Without a share all values come out, and their counts add up to the exact ones.
    """
    held, size = [], 0
    for part in values:
        held.append(part)
        size += len(part)
        if size >= block:
            yield _block(held, size, share)
            held, size = [], 0
    if size:
        yield _block(held, size, share)


def _block(held: list[np.ndarray], size: int, share: int | None) -> tuple[np.ndarray, np.ndarray, int]:
    found, counts = np.unique(np.concatenate(held), return_counts=True)
    if share is None:
        return found, counts, size
    often = counts >= max(2, size // share)
    return found[often], counts[often], size


def rows_of(batches: Iterable[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `size` rows, so that what a step makes of them stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def freed() -> None:
    """Give memory back at the end of a task: Spark keeps its Python workers, and they keep what they ever held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)  # where the C library can


def freeing(build: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of a group that gives memory back once its own variables are gone."""

    def own(table: pa.Table) -> pa.Table:
        try:
            return build(table)
        finally:
            freed()

    return own
