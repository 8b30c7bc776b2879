"""Five-word shingles of Arrow text columns, as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from .arrowtext import Words, mix, rolling

SIZE = 5


def shingles(column: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, ordered by row and hash.

    A text with fewer words than a shingle has one shingle, all its words; a text without words
    has none.
    """
    words = Words(column)
    if not len(words.codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    digest = np.fromiter(map(xxhash.xxh64_intdigest, words.vocabulary.cast(pa.large_binary()).to_pylist()), np.uint64, len(words.vocabulary))
    of = digest[words.codes]
    at = np.arange(max(0, len(of) - size + 1))
    row = words.row[at]
    inside = at + size <= words.starts[row + 1]
    row, hashes = row[inside], rolling(of, size)[inside]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        whole = np.array([int(rolling(of[words.starts[i] : words.starts[i + 1]], int(words.counts[i]))[0]) for i in short], np.uint64)
        row, hashes = np.concatenate([row, short]), np.concatenate([hashes, mix(whole, 77)])
    order = np.argsort(hashes)
    order = order[np.argsort(row[order], kind="stable")]
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[new], hashes[new]
