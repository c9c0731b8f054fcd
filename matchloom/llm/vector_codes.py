"""Vector code compression: each part of a vector becomes the index of its nearest codebook entry, exactly.

Components become floor(256 * x); a vector is cut into ``PARTS`` equal consecutive parts. The codebook of
each part position starts as that part of the ``ENTRIES`` smallest ids, and each round replaces an entry by
the floored mean of the parts nearest to it. All numbers are whole, so every run gives the same codes.

Distances come from matrix products in doubles that are exact: whole numbers are broken into limbs so
narrow that a product of two limbs, summed over a part, stays at or below 2**53. The products of limb pairs
are shifted and added in int64, and the first smallest squared distance wins.

A round is one pass over all vectors: tasks add up the parts of each entry and return a row per entry and
position, whatever the table's size. Codebooks (entries x components) are the only thing sent to tasks.

Defined results: a vector that is null, or holds a null or non-finite component, takes no part. Shorter
vectors count as if filled up with zeros, to the longest length or the next multiple of the parts. Rows of
one id are vectors of their own; where they start a codebook, the lesser vector comes first, and rows
without an id come last. With fewer rows than entries the codebooks are shorter. Components too large for
64-bit distances stop the job by name. An empty table gives an empty one. Other columns stay; one named
``code`` or ``error`` is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components that a task works on at once.
SLICE_CELLS = 1 << 19


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Signed whole numbers as doubles of ``bits`` bits each, the lowest first; the last one has the sign."""
    out, rest = [], values
    while np.abs(rest).max(initial=0) > 1 << bits:
        out.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits
    return [*out, rest.astype(np.float64)]


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two int64 matrices, exact wherever they fit into 64 bits."""
    bits = (53 - max(left.shape[1] - 1, 0).bit_length()) // 2
    high = limbs(right, bits)
    total = np.zeros((len(left), len(right)), np.int64)
    for i, a in enumerate(limbs(left, bits)):
        for j, b in enumerate(high):
            if (i + j) * bits < 64:
                total += (a @ b.T).astype(np.int64) << ((i + j) * bits)
    return total


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first of its nearest entries, and the squared distance to it."""
    apart = (entries**2).sum(axis=1) - 2 * products(rows, entries)
    first = apart.argmin(axis=1)
    return first, apart[np.arange(len(rows)), first] + (rows**2).sum(axis=1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix, filled up with zeros."""
    sizes = column.value_lengths().to_numpy()
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _slices(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, SLICE_CELLS // max(1, width))
    return (batch.slice(i, step) for i in range(0, batch.num_rows, step))


def integer_vectors(rows: DataFrame, vector: str, parts: int = PARTS) -> tuple[DataFrame, int]:
    """The rows that take part, written with whole components, and the length that their vectors count as."""
    values = F.col(vector).cast("array<double>")
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = rows.where(F.col(vector).isNotNull() & F.forall(values, good))
    longest, top = kept.agg(F.max(F.size(vector)), F.max(F.array_max(F.transform(values, F.abs)))).first()
    width = -(-max(longest or 0, 1) // parts) * parts
    if 4.0 * width * (256 * (top or 0) + 1) ** 2 >= 2.0**63:
        raise ValueError(f"vector components up to {top} are too large for exact 64-bit distances over {width} components")
    return stored(kept.withColumn(vector, F.transform(values, lambda x: F.floor(x * 256).cast("bigint")))), width


def _sums(vector: str, books: np.ndarray) -> Callable:
    """A task's totals by part and entry, one row per position and one for the count."""
    parts, entries, size = books.shape

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((parts, entries, size + 1), np.int64)
        for batch in batches:
            for piece in _slices(batch, parts * size):
                cut = _matrix(piece.column(vector), parts * size).reshape(-1, parts, size)
                for p in range(parts):
                    code = nearest(cut[:, p], books[p])[0]
                    order = np.argsort(code, kind="stable")
                    used, starts = np.unique(code[order], return_index=True)
                    totals[p, used, :size] += np.add.reduceat(cut[order, p], starts, axis=0)
                    totals[p, used, size] += np.bincount(code, minlength=entries)[used]
        flat = totals.reshape(-1)
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(flat[some])], ["slot", "total"])

    return added


def train(
    kept: DataFrame, vec_id: str, vector: str, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> np.ndarray:
    """Codebooks as an array by part, entry and position."""
    first = kept.orderBy(F.col(vec_id).asc_nulls_last(), vector).select(vector).limit(entries).toArrow()
    start = _matrix(first.column(vector).combine_chunks(), width) if len(first) else np.zeros((0, width), np.int64)
    books = start.reshape(len(start), parts, width // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(start) else 0):
        sums = kept.select(vector).mapInArrow(_sums(vector, books), "slot int, total bigint")
        # Totals of tasks fit into 64 bits, those of all tasks together get more.
        found = sums.groupBy("slot").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect()
        totals = np.zeros((*books.shape[:2], books.shape[2] + 1), object)
        totals.reshape(-1)[[r.slot for r in found]] = [int(r.total) for r in found]
        used = totals[:, :, -1] > 0
        books[used] = (totals[used][:, :-1] // totals[used][:, -1:]).astype(np.int64)
    return books


def encoded(kept: DataFrame, vector: str, books: np.ndarray) -> DataFrame:
    """Adds ``code`` (an index per part) and ``error`` (squared distances of all parts); the vector goes."""
    rest = kept.drop("code", "error")
    names = [c for c in rest.columns if c != vector]
    schema = ", ".join(f"`{c}` {rest.schema[c].dataType.simpleString()}" for c in names)
    parts, entries, size = books.shape

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _slices(batch, parts * size):
                cut = _matrix(piece.column(vector), parts * size).reshape(-1, parts, size)
                found = [nearest(cut[:, p], books[p]) for p in range(parts)]
                codes = np.stack([c for c, _ in found], axis=1).astype(np.int32)
                offsets = np.arange(len(cut) + 1, dtype=np.int32) * parts
                yield pa.RecordBatch.from_arrays(
                    [
                        *(piece.column(c) for c in names),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.reshape(-1))),
                        pa.array(sum(far for _, far in found)),
                    ],
                    [*names, "code", "error"],
                )

    return rest.mapInArrow(coded, ", ".join(filter(None, [schema, "code array<int>, error bigint"])))


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """Adds ``vector``, the whole components that a code stands for."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in part]) for part in books])
    return codes.withColumn("vector", F.flatten(F.transform("code", lambda c, p: entries[p][c])))


def books_text(books: np.ndarray) -> str:
    """All entries' components as decimal numbers, by part, entry and position."""
    return ",".join(map(str, books.reshape(-1).tolist()))
