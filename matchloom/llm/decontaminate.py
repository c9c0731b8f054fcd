"""Benchmark decontamination: windows of benchmark items found in training texts.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all characters beyond ASCII. A
window is ten consecutive words of an item; an item of fewer words, but not none, is one window.

The benchmark goes to the tasks as a hash set of windows, in parts of at most ``part_bytes`` of its
text. A larger benchmark makes more parts: the documents are scanned and written once for each, with what
was found so far, and a part's broadcast is gone before the next one is made. Hashes only propose a
window; a hit is confirmed word by word.

Defined results: a null text, or one without words, has no words and no hits. Items without words
or with a null text have no windows; an item with a null id marks words but is not named. Repeated
documents are judged each by itself, repeated items are named once. An empty benchmark hits nothing.
Other columns stay as they are; one named as the hits is replaced by them.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dropped, stored, unused_name
from .texts import ALNUM_TABLE, SLICE_BYTES, slices, split_words, text_of, translated, utf8

WINDOW = 10
#: Bytes of benchmark text in one broadcast.
PART_BYTES = 8_000_000
#: A word in a text as it is, before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOUND = "array<struct<start:bigint,end:bigint,item:string>>"


class WindowSet:
    """The windows of some items: word numbers, and sorted hashes that point at them."""

    def __init__(self, items: list[tuple[str | None, str]], window: int) -> None:
        texts = translated(utf8(pa.array([t for _, t in items], pa.string())), ALNUM_TABLE)
        bounds, self.words, self.vocabulary = split_words(texts, lower=False)
        self.words = self.words.astype(np.int64)
        self.names = [i for i, _ in items]
        places: dict[int, list[tuple[int, int]]] = {}
        for item, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            size = min(window, b - a)
            if size:
                places.setdefault(size, []).extend((s, item) for s in range(a, b - size + 1))
        self.by_size = {}
        for size, rows in places.items():
            starts, owners = np.array(rows, np.int64).T
            order = np.lexsort((owners, keys := self.key(self.words, starts, size)))
            self.by_size[size] = keys[order], starts[order], owners[order]

    @staticmethod
    def key(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        keys = np.zeros(len(starts), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(size):
                keys = (keys ^ words[starts + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                keys ^= keys >> np.uint64(29)
        return keys

    def hits(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and item of each occurrence; ``words`` are numbers of this set's vocabulary or -1."""
        ends = bounds[1:][text_of(bounds)]
        unknown = np.concatenate(([0], np.cumsum(words < 0)))
        found = [np.zeros((3, 0), np.int64)]
        for size, (keys, starts, owners) in self.by_size.items():
            at = np.arange(max(0, len(words) - size + 1))
            at = at[(unknown[at + size] == unknown[at]) & (at + size <= ends[at])]
            wanted = self.key(words, at, size)
            low, high = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, side="right")
            at, low, high = at[high > low], low[high > low], high[high > low]
            many = high - low
            place = np.repeat(at, many)
            entry = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            same = np.ones(len(place), bool)
            for i in range(size):
                same &= words[place + i] == self.words[starts[entry] + i]
            found.append(np.stack([place[same], place[same] + size, owners[entry[same]]]))
        return tuple(np.concatenate(found, axis=1))


def _parts(benchmark: DataFrame, item_id: str, text: str, window: int, part_bytes: int) -> Iterator[WindowSet]:
    """The window sets of the benchmark; what the driver holds at once is one part."""
    items = benchmark.where(F.col(text).isNotNull()).select(
        F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text")
    )
    items = stored(items.distinct())  # repeated rows would all fall into one part
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    count = max(1, -(-2 * total // part_bytes)) if total > part_bytes else 1
    for part in range(count):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == part) if count > 1 else items
        yield WindowSet([tuple(r) for r in rows.collect()], window)


def _scanned(rows: DataFrame, text: str, found: str, shared: Broadcast[bytes]) -> DataFrame:
    """Append the hits of one window set to column ``found``: word ranges with the item's id."""
    schema = rows.schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(shared.value)
        for batch in (piece for b in batches for piece in slices(b, text, SLICE_BYTES)):
            bounds, ids, vocabulary = split_words(translated(utf8(batch.column(text)), ALNUM_TABLE), lower=False)
            numbers = pc.fill_null(pc.index_in(vocabulary, value_set=known.vocabulary), -1)
            words = numbers.to_numpy(zero_copy_only=False).astype(np.int64)[ids] if len(ids) else np.zeros(0, np.int64)
            start, end, item = known.hits(words, bounds)
            column = batch.column(found)
            if len(start):
                rows, number = column.to_pylist(), text_of(bounds)[start]
                for n, s, e, i in zip(number.tolist(), start.tolist(), end.tolist(), item.tolist(), strict=True):
                    base = int(bounds[n])
                    rows[n] = [*(rows[n] or []), {"start": s - base, "end": e - base, "item": known.names[i]}]
                column = pa.array(rows, column.type)
            at = batch.schema.get_field_index(found)
            yield batch.set_column(at, batch.schema.field(at), column)

    return rows.mapInArrow(scan, schema)


def with_hits(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    found: str = "found",
    window: int = WINDOW,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Documents with column ``found``: every occurrence of a window, as words start to end and item id."""
    rows = documents.drop(found).withColumn(found, F.lit(None).cast(_FOUND))
    before: DataFrame | None = None
    shared: Broadcast[bytes] | None = None
    for windows in _parts(benchmark, item_id, item_text, window, part_bytes):
        if shared is not None:  # one part at a time is with the tasks
            rows = stored(rows)
            shared.destroy()
            if before is not None:
                dropped(before)
            before = rows
        shared = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps(windows))
        rows = _scanned(rows, text, found, shared)
    return rows


def clean_documents(documents: DataFrame, benchmark: DataFrame, text: str = "text", **options: object) -> DataFrame:
    """Documents without any hit, with the columns they came with."""
    found = unused_name(documents, "found")
    rows = with_hits(documents, benchmark, text, found=found, **options)
    return rows.where(F.col(found).isNull()).drop(found)


def clean_spans(documents: DataFrame, benchmark: DataFrame, text: str = "text", **options: object) -> DataFrame:
    """All documents, their texts without the characters from the first to the last word of each hit."""
    found = unused_name(documents, "found")
    rows = with_hits(documents, benchmark, text, found=found, **options)
    word = re.compile(WORD)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for i, hits in enumerate(batch.column(found).to_pylist()):
                if hits:
                    spans = [m.span() for m in word.finditer(texts[i])]
                    kept, last = [], 0
                    for start, end in sorted({(h["start"], h["end"]) for h in hits}):
                        kept.append(texts[i][last : max(last, spans[start][0])])
                        last = max(last, spans[end - 1][1])
                    texts[i] = "".join([*kept, texts[i][last:]])
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return rows.mapInArrow(cut, rows.schema).drop(found)


def contamination(
    documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: object
) -> DataFrame:
    """Per document: its id, n_words, n_hit, the items with occurring windows, sorted as strings, and their spans."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = with_hits(rows, benchmark, "text", **options)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words bigint, n_hit bigint, items array<string>, found {_FOUND}"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for b in batches for piece in slices(b)):
            bounds, _, _ = split_words(translated(utf8(batch.column("text")), ALNUM_TABLE), lower=False)
            n_words, found = np.diff(bounds), batch.column("found")
            n_hit, items = np.zeros(len(n_words), np.int64), [[]] * len(n_words)
            hit_rows = np.flatnonzero(pc.is_valid(found).to_numpy(zero_copy_only=False))
            for i, hits in zip(hit_rows.tolist(), found.drop_null().to_pylist(), strict=True):
                marked = np.zeros(n_words[i] + 1, np.int64)
                np.add.at(marked, [h["start"] for h in hits], 1)
                np.add.at(marked, [h["end"] for h in hits], -1)
                n_hit[i] = (np.cumsum(marked) > 0).sum()
                items[i] = sorted({h["item"] for h in hits if h["item"] is not None})
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words), pa.array(n_hit), pa.array(items, pa.list_(pa.string())), found],
                ["doc_id", "n_words", "n_hit", "items", "found"],
            )

    return rows.mapInArrow(counted, schema)
