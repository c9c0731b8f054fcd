"""Words of whole texts as NumPy arrays, for task functions that get Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes that a task works on at once; one longer text is worked on alone.
SLICE_BYTES = 4_000_000

_UPPER = bytes(range(0x41, 0x5B))
#: Keeps ASCII digits, lower-cased ASCII letters and all bytes beyond ASCII; the rest becomes a space.
ALNUM_TABLE = bytes(
    32 if b < 0x30 or 0x39 < b < 0x41 or 0x5A < b < 0x61 or 0x7A < b < 0x80 else b + 32 if b in _UPPER else b
    for b in range(256)
)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a piece stay below ``limit`` bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> pa.Array:
    """A text column with null as the empty text."""
    column = column if pa.types.is_string(column.type) else column.cast(pa.string())
    return pc.fill_null(column, "")


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """Replace single ASCII bytes of all texts by ``table``; bytes from 0x80 on have to stay as they are."""
    if not len(texts):
        return texts
    texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    data = pa.py_buffer((data.to_pybytes() if data is not None else b"").translate(table))
    return pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, data], 0, texts.offset)


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space (space and bytes 9 to 13).

    Returns the n + 1 bounds of the texts in the run of all words, each word's place in the
    vocabulary, and the vocabulary. ``lower`` changes A-Z only.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(int(bounds[0]), int(bounds[-1] - bounds[0])).dictionary_encode()
    ids, vocabulary = words.indices.to_numpy(zero_copy_only=False), words.dictionary
    bounds = bounds - bounds[0]
    empty = pc.index(vocabulary, "").as_py()
    if empty >= 0:  # white space at the edges leaves empty words
        real = ids != empty
        bounds = np.concatenate(([0], np.cumsum(real)))[bounds]
        ids = ids[real]
    return bounds, ids, vocabulary


def word_hashes(vocabulary: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every task."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in vocabulary.to_pylist()), np.uint64, len(vocabulary))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that each bit depends on all bits of the input."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of ``size`` words from each place on; the last size - 1 places have none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    weights = np.random.RandomState(size).randint(0, 2**62, size).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for i in range(size):
            total += hashes[i : i + n] * weights[i]
    return mixed(total)


def text_of(bounds: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
