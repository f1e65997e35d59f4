"""Words, shingles and their 64-bit hashes.

Words are the maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE = 5
#: A process keeps the hashes of so many words at most, then starts again.
CACHE_WORDS = 150_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


#: Values of a column that are Python objects at once.
_SLICE = 256


def texts_of(column: pa.Array) -> Iterator:
    """The values of a column, some at a time, so that a batch of long texts isn't held twice."""
    for a in range(0, len(column), _SLICE):
        yield from column.slice(a, _SLICE).to_pylist()


def tidy(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same for mapInArrow; at a task's end its worker, which waits for others beside the JVM, gives freed memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        _hashes.clear()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of other systems may have none
        if trim is not None:
            trim(0)

    return run


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; each seed gives another order of the same values."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(text: str | None) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, in text order, repeats included."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total += hashes[i : i + n] * _ODD[i % 5]
    return mix(total, 77)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of 1 to k-1 words is one shingle, a text without words has none."""
    hashes = word_hashes(text)
    return np.unique(grams(hashes, min(k, len(hashes)))) if len(hashes) else np.empty(0, np.uint64)
