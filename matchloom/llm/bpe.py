"""Byte-level BPE: texts to token ids by a rank file, and ids back to bytes.

Each pre-token (a match of the pattern) is merged by itself. The adjacent pairs of all pre-tokens that a
task has not met wait in one queue of merge ranks: one bucket per rank holds the places of the pairs in a
linked list of symbols, a bitmap of 256 bits tells which ranks of a block have a bucket, and a bitmap
above it which blocks have any. Find-first-set on both picks the lowest rank, which is the lowest one of
every pre-token that has it; all its places are merged at once, and entries whose pair has changed
meanwhile are skipped. A pre-token of n bytes takes at most 3 n entries, however long it is.

Defined results: a null or empty text has no ids, an array with no items; null ids decode to empty
bytes. Equal texts get equal ids. Other columns stay as they are; one named as the result is
replaced by it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import slices, utf8

#: Pre-tokens that a task remembers before it starts anew, and bytes of text that it works on at once.
KEPT_WORDS, SLICE = 300_000, 6_000_000
#: The common pattern of these rank files.
COMMON_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LATIN = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
#: The same pattern for texts of Latin letters, and what such a text does not have.
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+"
BEYOND = rf"[^\x00-\x1b\x20-\x7e¡¿«»×÷{_LATIN}‐-‧]"


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: One bit for each place of a bitmap word and for each block of 256 ranks.
BIT = [1 << i for i in range(1 << 12)]


class RankQueue:
    """Places by merge rank, lowest rank first."""

    def __init__(self) -> None:
        self.places: dict[int, list[np.ndarray]] = {}
        self.bits: dict[int, int] = {}  # rank // 256 -> bitmap of its ranks with a bucket
        self.top = 0  # bitmap of the bitmaps that are not empty

    def push(self, rank: int, places: np.ndarray) -> None:
        bucket = self.places.get(rank)
        if bucket is not None:
            bucket.append(places)
            return
        self.places[rank] = [places]
        block = rank >> 8
        self.bits[block] = self.bits.get(block, 0) | BIT[rank & 255]
        self.top |= BIT[block]

    def push_all(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """Push places by their ranks; those with rank -1 have no pair that merges."""
        real = ranks >= 0
        ranks, places = ranks[real], places[real]
        if not len(ranks):
            return
        if len(ranks) > 1:
            order = ranks.argsort(kind="stable")
            ranks, places = ranks[order], places[order]
        cuts = (ranks[1:] != ranks[:-1]).nonzero()[0] + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ranks)], strict=True):
            self.push(int(ranks[start]), places[start:stop])

    def pop(self) -> tuple[int, list[np.ndarray]]:
        block = (self.top & -self.top).bit_length() - 1
        word = self.bits[block]
        first = word & -word
        rank = (block << 8) + first.bit_length() - 1
        self.bits[block] = word ^ first
        if word == first:
            self.top ^= BIT[block]
        return rank, self.places.pop(rank)


class Merger:
    """Merges pre-tokens by rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        get = ranks.get
        splits = [
            (a << 32 | b, rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None
        ]
        keys, values = np.array(splits, np.int64).reshape(-1, 2).T
        order = keys.argsort()
        self.keys, self.values = np.r_[keys[order], np.iinfo(np.int64).max], np.r_[values[order], -1].astype(np.int32)
        self.single = np.array([get(bytes([b]), -1) for b in range(256)], np.int32)
        self.bytes_ahead = self.pair_ranks(np.repeat(self.single, 256), np.tile(self.single, 256))
        # Merging into such a token can make a pair of lower rank, which then comes before the next merge.
        self.careful = {r for r in np.r_[keys[values < keys >> 32] >> 32, keys[values < (keys & 2**32 - 1)] & 2**32 - 1].tolist()}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, or -1."""
        wanted = left.astype(np.int64) << 32 | right
        at = self.keys.searchsorted(wanted)
        return np.where(self.keys[at] == wanted, self.values[at], -1)

    def many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in one run, and the number of each one's."""
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int32)
        open_ = whole < 0
        sizes = np.ones(len(pieces), np.int64)
        merged, sizes[open_] = self._merged([p for p, w in zip(pieces, open_.tolist(), strict=True) if w])
        ids = np.repeat(whole, sizes)
        ids[ids < 0] = merged
        return ids, sizes

    def ids(self, piece: bytes) -> list[int]:
        return self.many([piece])[0].tolist()

    def _merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n, ends = len(data), np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        starts = np.r_[0, ends[:-1]]
        # A linked list of symbols: place n stands before the first and behind the last of each piece.
        symbol = np.r_[self.single[data], np.int32(-1)]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = before[starts] = n
        ahead = np.full(n + 1, -1, np.int32)  # rank of the pair that starts here
        ahead[: n - 1] = self.bytes_ahead[data[:-1].astype(np.int64) << 8 | data[1:]]
        ahead[ends - 1] = -1
        queue = RankQueue()
        queue.push_all(ahead[:n], np.arange(n))
        while queue.top:
            rank, bucket = queue.pop()
            at = bucket[0]
            if len(bucket) > 1:
                at = np.unique(np.concatenate(bucket))
            at = at[ahead[at] == rank]  # the others are stale: a neighbour was merged since the push
            if len(at) > 1:
                if rank in self.careful:  # only the first of each piece for now
                    piece = ends.searchsorted(at, side="right")
                    first = np.r_[True, piece[1:] != piece[:-1]]
                    if not first.all():
                        queue.push(rank, at[~first])
                        at = at[first]
                else:  # of overlapping pairs every other one, from the left
                    new_run = np.r_[True, after[at[:-1]] != at[1:]]
                    if not new_run.all():
                        place = np.arange(len(at))
                        at = at[(place - np.maximum.accumulate(np.where(new_run, place, 0))) % 2 == 0]
            elif not len(at):
                continue
            gone = after[at]
            behind = after[gone]
            symbol[at], ahead[gone], after[at], before[behind] = rank, -1, behind, at
            front = before[at]  # which may just have been merged itself
            there = np.concatenate([at, front])
            found = self.pair_ranks(symbol[there], symbol[np.concatenate([behind, at])])
            found[there == n] = -1
            ahead[there] = found
            queue.push_all(found, there)
        alive = self._alive(after, starts, n)
        return symbol[:n][alive], np.diff(np.r_[0, np.cumsum(alive)[ends - 1]])

    @staticmethod
    def _alive(after: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """Which places still begin a symbol: those that a place of the list leads to."""
        alive = np.zeros(n + 1, bool)
        while len(starts):
            alive[starts] = True
            starts = after[starts]
            starts = starts[starts < n]
        return alive[:n]


class Remembered(dict):
    """Number of each pre-token met lately, with the ids of all of them in one array."""

    def __init__(self, ids_of: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> None:
        self.ids_of = ids_of
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number

    def text_ids(self, texts: list[str], split: Callable[[str], list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one run, and the n + 1 bounds of the texts in it."""
        if len(self) > KEPT_WORDS:
            self.forget()
        look_up = self.__getitem__
        numbers = [np.array(list(map(look_up, split(t))), np.int32) for t in texts]
        if self.new:
            ids, sizes = self.ids_of(self.new)
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.new = []
        flat = np.concatenate([np.zeros(0, np.int32), *numbers])
        sizes = (self.ends[1:] - self.ends[:-1])[flat]
        ends = np.cumsum(sizes)
        places = np.repeat((self.ends[flat] - (ends - sizes)).astype(np.int32), sizes)
        places += np.arange(len(places), dtype=np.int32)
        return self.ids[places], np.r_[0, ends][np.cumsum([0, *map(len, numbers)])]


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Pre-tokens of a text: the matches of ``pattern``, where white space is Unicode's."""
    if pattern != COMMON_PATTERN:
        return regex.compile(pattern).findall
    every, latin, beyond = regex.compile(pattern).findall, re.compile(LATIN_PATTERN).findall, re.compile(BEYOND).search
    return lambda text: every(text) if beyond(text) else latin(text)


def _shared_file(spark: SparkSession, path: str) -> str:
    """Give the rank file to all executors; its name there."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encoded(documents: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Documents with column ``ids`` (array of int) made of their whole texts."""
    documents = documents.drop(ids)
    schema = T.StructType([*documents.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False))])
    name = _shared_file(documents.sparkSession, ranks)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, merger = splitter(pattern), Merger(read_ranks(SparkFiles.get(name)))
        known = Remembered(lambda pieces: merger.many([p.encode() for p in pieces]))
        item = pa.list_(pa.field("element", pa.int32(), nullable=False))
        for batch in (piece for b in batches for piece in slices(b, text, SLICE)):
            values, ends = known.text_ids(utf8(batch.column(text)).to_pylist(), split)
            column = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values), type=item)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, ids])

    return documents.mapInArrow(encode, schema)


def decoded(documents: DataFrame, ranks: str, ids: str = "ids", data: str = "data") -> DataFrame:
    """Documents with column ``data`` (binary): the bytes of all their ids. Unknown ids stop the job."""
    documents = documents.drop(data)
    schema = T.StructType([*documents.schema.fields, T.StructField(data, T.BinaryType())])
    name = _shared_file(documents.sparkSession, ranks)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in read_ranks(SparkFiles.get(name)).items()}
        table = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        known = np.array([i in tokens for i in range(len(table))])
        sizes = np.array([len(t) for t in table], np.int64)
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(table), np.uint8)
        for batch in (piece for b in batches for piece in _some_ids(b, ids)):
            lists = batch.column(ids)
            bounds, row_ids = _flat(lists)
            if len(row_ids) and not (0 <= row_ids.min() and row_ids.max() < len(table) and known[row_ids].all()):
                raise ValueError("an id is not in the rank file")
            ends = np.cumsum(sizes[row_ids])
            shift = np.repeat(starts[row_ids] - (ends - sizes[row_ids]), sizes[row_ids])
            offsets = np.concatenate(([0], ends))[bounds].astype(np.int32)
            out = flat[np.arange(len(shift)) + shift]
            column = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, data])

    return documents.mapInArrow(decode, schema)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the rows' ids in the run of all ids, and the ids; a null row has none."""
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate(([0], np.cumsum(counts))), lists.flatten().to_numpy(zero_copy_only=False)


def _some_ids(batch: pa.RecordBatch, ids: str, limit: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with at most ``limit`` ids, or one row."""
    ends, start = _flat(batch.column(ids))[0], 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def digests(documents: DataFrame, ids: str = "ids", data: str = "data") -> DataFrame:
    """Digest columns of encoded and decoded documents: ids in decimals joined by a space, and the bytes."""
    return documents.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(data), 256).alias("decoded_sha256"),
    )
