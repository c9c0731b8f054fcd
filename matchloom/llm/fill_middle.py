"""Fill-in-middle transformation over seekable compressed texts.

``framed`` stores each text as independent zstandard frames of ``FRAME`` code points with their cumulative
counts, so any place is found by bisection and read by decompressing one frame. ``transformed`` cuts a text
in three and puts the parts behind markers: whole frames go into the output as they are, only the two cut
ones are opened and closed again. The output is such a list of frames, too; one behind the other they are
a valid zstandard stream. ``digests`` reads frames in order and holds one at a time; ``texts`` opens all.

Cuts come from the sha256 of ``seed:doc_id``, so they stay the same whatever the partitions or retries.
A text is left plain if it is empty, holds a marker, or its hash says so. Of the others a share stands with
the suffix first (spm), the rest with the prefix first (psm).

Defined results: a null text counts as empty, a null id as an empty id. Rows are independent of each other,
so equal rows give equal rows and an empty table an empty one. Other columns stay, apart from the text;
one named as a column of the result is replaced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import texts as words

FRAME = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, these stay plain; of 100 others, these have the suffix first.
PLAIN_SHARE, SUFFIX_FIRST_SHARE = 10, 20
#: Order of the parts behind the markers.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
_FRAMES = "ends array<bigint>, frames array<binary>"
_OWN = ("n", "marked", "ends", "frames", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output")

Framed = tuple[list[int], list[bytes]]


class Codec:
    """Compresses and opens single frames."""

    def __init__(self) -> None:
        self._out, self._in = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()

    def closed(self, text: str) -> bytes:
        return self._out.compress(text.encode())

    def opened(self, frame: bytes) -> str:
        return self._in.decompress(frame).decode()


def frames_of(text: str, codec: Codec, size: int = FRAME) -> Framed:
    """Cumulative code points and frames of a text."""
    pieces = [text[i : i + size] for i in range(0, len(text), size)]
    return list(accumulate(map(len, pieces))), [codec.closed(x) for x in pieces]


def span_texts(ends: list[int], frames: list[bytes], start: int, stop: int, codec: Codec) -> Iterator[str]:
    """The code points from ``start`` to ``stop``, frame by frame."""
    for i in range(bisect_right(ends, start), len(frames)):
        first = ends[i - 1] if i else 0
        if first >= stop:
            return
        yield codec.opened(frames[i])[max(0, start - first) : stop - first]


def span_frames(ends: list[int], frames: list[bytes], start: int, stop: int, codec: Codec) -> Iterator[tuple[int, bytes]]:
    """The same code points as frames with their counts; frames wholly inside are taken unopened."""
    for i in range(bisect_right(ends, start), len(frames)):
        first = ends[i - 1] if i else 0
        if first >= stop:
            return
        if start <= first and ends[i] <= stop:
            yield ends[i] - first, frames[i]
        else:
            piece = codec.opened(frames[i])[max(0, start - first) : stop - first]
            yield len(piece), codec.closed(piece)


def rearranged(ends: list[int], frames: list[bytes], form: str, cut: int, end: int, codec: Codec) -> Framed:
    """The output of a text with its middle from ``cut`` to ``end``."""
    if form not in ORDERS:
        return ends, frames
    spans = {PREFIX: (0, cut), MIDDLE: (cut, end), SUFFIX: (end, ends[-1])}
    pieces: list[tuple[int, bytes]] = []
    for mark in ORDERS[form]:
        pieces.append((len(mark), codec.closed(mark)))
        pieces += span_frames(ends, frames, *spans[mark], codec)
    return list(accumulate(n for n, _ in pieces)), [x for _, x in pieces]


def restored_texts(ends: list[int], frames: list[bytes], form: str, codec: Codec) -> Iterator[str]:
    """The text that an output stands for, in pieces: its markers are found by reading, its parts by seeking."""
    if form not in ORDERS:
        yield from map(codec.opened, frames)
        return
    marks, found, tail, done = list(ORDERS[form]), [], "", 0
    for frame in frames:
        piece = codec.opened(frame)
        seen, at = tail + piece, 0
        while len(found) < len(marks) and (hit := seen.find(marks[len(found)], at)) >= 0:
            found.append(done - len(tail) + hit)
            at = hit + len(marks[0])
        done += len(piece)
        tail = seen[max(at, len(seen) - len(marks[0]) + 1) :]
        if len(found) == len(marks):
            break
    stops = [*found[1:], ends[-1]]
    spans = {mark: (a + len(mark), b) for mark, a, b in zip(marks, found, stops)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from span_texts(ends, frames, *spans[mark], codec)


def _passed(rows: DataFrame, drop: tuple[str, ...]) -> tuple[list[str], str]:
    """Columns that stay as they are, and their schema."""
    names = [c for c in rows.columns if c.lower() not in drop]
    return names, "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in names)


def _framed_columns(made: list[Framed]) -> list[pa.Array]:
    return [
        pa.array([ends for ends, _ in made], pa.list_(pa.int64())),
        pa.array([frames for _, frames in made], pa.list_(pa.binary())),
    ]


def framed(documents: DataFrame, text: str = "text", size: int = FRAME) -> DataFrame:
    """Each text as frames, with ``n`` code points and whether it holds a marker (``marked``)."""
    value = F.coalesce(F.col(text), F.lit(""))
    marked = value.contains(PREFIX) | value.contains(SUFFIX) | value.contains(MIDDLE)
    rows = documents.drop(*[c for c in documents.columns if c.lower() in _OWN and c != text]).select(
        "*", F.char_length(value).cast("bigint").alias("n"), marked.alias("marked")
    )
    names, schema = _passed(rows, (text.lower(),))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for batch in batches:
            for piece in words.slices(batch, text):
                cut = [frames_of(x, codec, size) for x in words.utf8(piece.column(text)).to_pylist()]
                columns = [piece.column(c) for c in names] + _framed_columns(cut)
                yield pa.RecordBatch.from_arrays(columns, [*names, "ends", "frames"])

    return rows.mapInArrow(made, schema + _FRAMES)


def hash_numbers(doc_id: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hex sha256 of ``seed:doc_id`` as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def with_cuts(store: DataFrame, doc_id: str = "doc_id", seed: int = 1) -> DataFrame:
    """Adds ``form``, ``prefix_chars`` and ``middle_chars`` (null where plain)."""
    h1, h2, h3, h4 = hash_numbers(F.col(doc_id), seed)
    places = F.col("n") + 1
    plain = (F.col("n") == 0) | F.col("marked") | (h3 % 100 >= 100 - PLAIN_SHARE)
    form = F.when(plain, "plain").when(h4 % 100 < SUFFIX_FIRST_SHARE, "spm").otherwise("psm")
    first, last = F.least(h1 % places, h2 % places), F.greatest(h1 % places, h2 % places)
    return store.select(
        "*", form.alias("form"), F.when(~plain, first).alias("prefix_chars"), F.when(~plain, last - first).alias("middle_chars")
    )


def transformed(store: DataFrame, doc_id: str = "doc_id", seed: int = 1) -> DataFrame:
    """What ``framed`` gave, with the frames of the output in place of those of the text."""
    rows = with_cuts(store, doc_id, seed).drop("marked")
    names, schema = _passed(rows, ("ends", "frames"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for batch in batches:
            for piece in _frame_slices(batch):
                each = (piece.column(c).to_pylist() for c in ("ends", "frames", "form", "prefix_chars", "middle_chars"))
                out = [rearranged(e, f, form, a or 0, (a or 0) + (m or 0), codec) for e, f, form, a, m in zip(*each)]
                columns = [piece.column(c) for c in names] + _framed_columns(out)
                yield pa.RecordBatch.from_arrays(columns, [*names, "ends", "frames"])

    return rows.mapInArrow(made, schema + _FRAMES)


def _frame_slices(batch: pa.RecordBatch, limit: int = words.SLICE_BYTES // 4) -> Iterator[pa.RecordBatch]:
    """Rows whose frames take ``limit`` bytes together, one row at least."""
    start, held = 0, 0
    for i, frames in enumerate(batch.column("frames")):
        size = sum(len(x.as_buffer()) for x in frames.values)
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def _read(outputs: DataFrame, columns: str, of: object) -> DataFrame:
    """Replaces frames by what ``of(ends, frames, form, codec)`` makes of them."""
    names, schema = _passed(outputs, ("ends", "frames"))
    kinds = [c.split()[0] for c in columns.split(", ")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for batch in batches:
            for piece in _frame_slices(batch):
                each = (piece.column(c).to_pylist() for c in ("ends", "frames", "form"))
                values = [of(e, f, form, codec) for e, f, form in zip(*each)]
                columns = [pa.array(x, pa.string()) for x in zip(*values)]
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in names] + columns, [*names, *kinds])

    return outputs.mapInArrow(made, schema + columns)


def _sha256(pieces: Iterator[str]) -> str:
    digest = hashlib.sha256()
    for piece in pieces:
        digest.update(piece.encode())
    return digest.hexdigest()


def digests(outputs: DataFrame) -> DataFrame:
    """Hashes of the output and of the text rebuilt from it, frame by frame."""

    def both(ends: list[int], frames: list[bytes], form: str, codec: Codec) -> tuple[str, str]:
        return _sha256(map(codec.opened, frames)), _sha256(restored_texts(ends, frames, form, codec))

    return _read(outputs, "output_sha256 string, restored_sha256 string", both)


def texts(outputs: DataFrame) -> DataFrame:
    """The output texts themselves, as ``output``."""

    def whole(ends: list[int], frames: list[bytes], form: str, codec: Codec) -> tuple[str]:
        return ("".join(map(codec.opened, frames)),)

    return _read(outputs, "output string", whole)
