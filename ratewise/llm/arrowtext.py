"""Words and lines of Arrow string columns, in numpy; used inside tasks only."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A word, and what separates words: the same six characters for Java, RE2 and Arrow.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

#: Text handled at once inside a task. It bounds memory; results do not depend on it.
SLICE_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut batches where the text exceeds ``size`` (``SLICE_BYTES`` by default); a longer single text goes alone.

    A worker lives on between the stages of a job, so what a task has freed is given back at its end.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        at, total = 0, np.cumsum(sizes)
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + (size or SLICE_BYTES), "right")))
            yield batch.slice(at, end - at)
            at = end
    give_back()


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as strings with buffers of their own (not all kernels heed a slice's); null counts as empty."""
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.take(pa.array(np.arange(len(column)))).cast(pa.large_string()).fill_null("")


class Words:
    """Words of a slice: ``codes`` into ``vocabulary``, row i at ``codes[starts[i]:starts[i + 1]]``."""

    def __init__(self, column: pa.Array, lower: bool = False):
        lists = pc.ascii_split_whitespace(column)
        flat = lists.flatten()
        row = pc.list_parent_indices(lists).to_numpy()
        full = pc.binary_length(flat).to_numpy() > 0
        if not full.all():
            flat, row = flat.filter(pa.array(full)), row[full]
        encoded = flat.dictionary_encode()
        self.vocabulary: pa.Array = encoded.dictionary
        self.codes = encoded.indices.to_numpy().astype(np.int64)
        if lower:  # A-Z, on the distinct words only
            again = pc.ascii_lower(self.vocabulary).dictionary_encode()
            self.vocabulary, self.codes = again.dictionary, again.indices.to_numpy().astype(np.int64)[self.codes]
        self.row = row.astype(np.int64)
        self.counts = np.bincount(self.row, minlength=len(column)).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection on 64-bit words that spreads any input evenly (splitmix64's finalizer)."""
    x = values.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` hashes, in order."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C17) + hashes[k : k + n]
    return mix(out)


def rows_sum(row: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weights=weights, minlength=n).astype(np.int64)


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and both allocators keep what they once got."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
