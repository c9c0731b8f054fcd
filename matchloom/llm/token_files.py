"""Token-id files compressed by a Re-Pair grammar per shard.

Documents are encoded by a tokenizer file, get the end id appended and stand in ascending order of their
ids. A range shuffle gives each task a run of that order, which it cuts into shards of about
``SHARD_TOKENS`` tokens at document ends. In a shard frequent pairs of neighbouring symbols are replaced
by nonterminals, many pairs a round and from left to right, until a round saves little.

The format is a Parquet folder with one row per shard: ``part`` and ``shard`` (their order is the order of
documents), ``first`` (tokens of the part before the shard), ``doc_ids``, ``doc_tokens``, and little-endian
unsigned numbers of ``width`` bytes: ``rules`` (the left and then the right symbols of nonterminals base,
base + 1, ...), ``symbols``; ``lengths`` holds how many tokens each nonterminal expands to, as 4 bytes each,
so that a document is found and decoded without expanding what stands before it (``tokens_at``).

Defined results: a null or empty text has the end id only. Rows of one id follow each other in the order of
a hash of their texts; rows without an id come first. Extra columns are not written. An empty table gives
an empty folder that reads as no documents. A single document of more tokens than a shard is a shard.
"""

from __future__ import annotations

import codecs
import json
import os
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import COMMON_PATTERN, Remembered, splitter
from .texts import slices, utf8

SHARD_TOKENS = 2_000_000
#: Pairs seen less often stay; a round takes at most so many pairs, and there are at most so many rounds.
LEAST_COUNT, ROUND_PAIRS, ROUNDS = 24, 4096, 3
#: Bytes of text that are encoded at once.
SLICE = 4_000_000
FORMAT = (
    "part int, shard int, first bigint, doc_ids array<bigint>, doc_tokens array<bigint>, base int, width int, "
    "rules binary, lengths binary, symbols binary"
)


class Encoder:
    """Ids of texts by the tokenizers library.

    A byte-level tokenizer encodes each match of its pattern by itself, so the library's model gets every
    new match once; any other tokenizer, and a text with a special token's string, gets whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            known = json.load(file)
        before = known.get("pre_tokenizer") or {}
        self.by_piece = (
            before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
            and not known.get("normalizer")
        )
        self.special = [t["content"] for t in known.get("added_tokens") or []]
        self.split = splitter(COMMON_PATTERN)
        self.known, self.tokenize = Remembered(self.pieces), self.tokenizer.model.tokenize
        # Byte-level tokenizers write a byte as a character: printable ones as they are, others from 256 on.
        printable = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
        others = iter(range(256, 512))
        self.characters = "".join(chr(b if b in printable else next(others)) for b in range(256))

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        write, tokenize, characters = codecs.charmap_decode, self.tokenize, self.characters
        rows = [[token.id for token in tokenize(write(t.encode(), "strict", characters)[0])] for t in texts]
        return np.array(list(chain.from_iterable(rows)), np.int32), np.fromiter(map(len, rows), np.int64, len(rows))

    def runs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one run, and the texts' bounds in it."""
        plain = [self.by_piece and not any(s in t for s in self.special) for t in texts]
        if not all(plain):
            rows = [self.ids(t, p) for t, p in zip(texts, plain, strict=True)]
            return np.concatenate([np.zeros(0, np.int32), *rows]), np.cumsum([0, *map(len, rows)])
        return self.known.text_ids(texts, self.split)

    def ids(self, text: str, plain: bool) -> np.ndarray:
        return self.runs([text])[0] if plain else np.array(self.whole(text), np.int32)


def compress(tokens: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: first nonterminal, rules (left, right), tokens per nonterminal, and the symbols left.

    Symbols stay below 2 ** 16 where the token ids allow it.
    """
    base = int(tokens.max(initial=0)) + 1
    narrow = base < 2**16
    room = 2**16 - base if narrow else 2**31 - base
    seq = tokens.astype(np.uint16 if narrow else np.uint32)
    left, right = np.zeros((2, 0), seq.dtype)
    lengths = np.zeros(0, np.uint32)
    key = (np.uint32, np.uint32(16)) if narrow else (np.uint64, np.uint64(32))
    for _ in range(ROUNDS):
        pairs = (seq[:-1].astype(key[0]) << key[1]) | seq[1:]
        ordered = np.sort(pairs)
        edges = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[edges, len(ordered)])
        often = np.flatnonzero(counts >= LEAST_COUNT)
        take = min(ROUND_PAIRS, room - len(left), len(often))
        if take <= 0:
            break
        chosen = often[np.argpartition(-counts[often], take - 1)[:take]]
        chosen = np.sort(ordered[edges[chosen]])
        a, b = (chosen >> key[1]).astype(seq.dtype), (chosen & key[0]((1 << int(key[1])) - 1)).astype(seq.dtype)
        first = base + len(left)
        # A table by left and right symbol tells each place's chosen pair; row and column 0 have none.
        row, column = np.zeros((2, first), np.int32)
        lefts, rights = np.unique(a), np.unique(b)
        row[lefts], column[rights] = np.arange(1, len(lefts) + 1), np.arange(1, len(rights) + 1)
        table = np.full((len(lefts) + 1, len(rights) + 1), -1, np.int16)
        table[row[a], column[b]] = np.arange(take)
        which = table.reshape(-1)[row[seq[:-1]] * table.shape[1] + column[seq[1:]]]
        at = np.flatnonzero(which >= 0)
        which = which[at].astype(np.int64)
        # In a run of overlapping matches every other one counts, from the left.
        new_run = np.r_[True, np.diff(at) != 1] if len(at) else np.zeros(0, bool)
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        good = (np.arange(len(at)) - run_start) % 2 == 0
        at, which = at[good], which[good]
        size = np.r_[np.ones(base, np.uint32), lengths]
        lengths = np.r_[lengths, size[a] + size[b]]
        left, right = np.r_[left, a], np.r_[right, b]
        before = len(seq)
        seq[at] = (first + which).astype(seq.dtype)
        stay = np.ones(before, bool)
        stay[at + 1] = False
        seq = seq[stay]
        if before - len(seq) < before // 50:
            break
    return base, np.concatenate([left, right]), lengths, seq


def _expansions(base: int, rules: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all symbols in one run, with the start and the size of each symbol's."""
    left, right = rules[: len(lengths)].tolist(), rules[len(lengths) :].tolist()
    made: list[list[int]] = []
    tokens = lambda s: [s] if s < base else made[s - base]
    for a, b in zip(left, right, strict=True):
        made.append(tokens(a) + tokens(b))
    flat = np.concatenate([np.arange(base), np.array([t for m in made for t in m], np.int64)]).astype(np.uint32)
    sizes = np.r_[np.ones(base, np.int64), lengths.astype(np.int64)]
    return flat, np.cumsum(sizes) - sizes, sizes


def expand(base: int, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """All tokens of a shard."""
    flat, starts, sizes = _expansions(base, rules, lengths)
    many = sizes[symbols]
    return flat[np.arange(many.sum()) + np.repeat(starts[symbols] - (np.cumsum(many) - many), many)]


def tokens_at(base: int, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Tokens start to stop of a shard; only the symbols that hold them are expanded."""
    ends = np.cumsum(np.r_[np.ones(base, np.int64), lengths.astype(np.int64)][symbols])
    low, high = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop) + 1
    before = int(ends[low - 1]) if low else 0
    return expand(base, rules, lengths, symbols[low:high])[start - before : stop - before]


def unpacked(row: dict[str, object]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Base, rules, lengths and symbols of a row of the format."""
    kind = f"<u{row['width']}"
    return (
        row["base"],
        np.frombuffer(row["rules"], kind),
        np.frombuffer(row["lengths"], "<u4"),
        np.frombuffer(row["symbols"], kind),
    )


def write(documents: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the token files of all documents (integer id and text) to a new folder."""
    spark = documents.sparkSession
    spark.sparkContext.addFile(tokenizer)
    name = tokenizer.rsplit("/", 1)[-1]
    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("turn", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "turn").sortWithinPartitions("doc_id", "turn")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(SparkFiles.get(name)), TaskContext.get().partitionId()
        ids: list[int | None] = []
        runs: list[np.ndarray] = []
        sizes: list[int] = []
        done = shard = first = 0

        def closed() -> pa.RecordBatch:
            base, rules, lengths, symbols = compress(np.concatenate(runs))
            width = symbols.dtype.itemsize
            packed = [rules.astype(f"<u{width}"), lengths.astype("<u4"), symbols.astype(f"<u{width}")]
            values = [part, shard, first, ids, sizes, base, width, *(p.tobytes() for p in packed)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int32()]
            columns = [pa.array([v], k) for v, k in zip(values, [*kinds, *[pa.binary()] * 3], strict=True)]
            return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in FORMAT.split(", ")])

        for batch in (piece for b in batches for piece in slices(b, "text", SLICE)):
            tokens, bounds = encoder.runs(utf8(batch.column("text")).to_pylist())
            many = np.diff(bounds) + 1
            whole = np.insert(tokens, bounds[1:], end_id)  # the end id after each document
            names, cut = batch.column("doc_id").to_pylist(), 0
            ends = np.cumsum(many)
            while cut < len(names):
                before = int(ends[cut - 1]) if cut else 0
                stop = min(len(names), max(cut + 1, int(np.searchsorted(ends, before + SHARD_TOKENS - done)) + 1))
                ids += names[cut:stop]
                sizes += many[cut:stop].tolist()
                runs.append(whole[before : ends[stop - 1]])
                done += int(ends[stop - 1]) - before
                cut = stop
                if done >= SHARD_TOKENS:
                    yield closed()
                    first, shard, done = first + done, shard + 1, 0
                    ids, runs, sizes = [], [], []
        if ids:
            yield closed()

    ordered.select("doc_id", "text").mapInArrow(shards, FORMAT).write.parquet(path)


def read(spark: SparkSession, path: str, of_document: Callable[[np.ndarray], object], kind: str) -> DataFrame:
    """Documents of the files: doc_id, start (tokens of all before it), n_tokens, and ``value`` of its tokens.

    The parts' offsets go to all tasks: one small row for each task that wrote.
    """
    files = spark.read.schema(FORMAT).parquet(path)
    totals = files.groupBy("part").agg(F.sum(F.aggregate("doc_tokens", F.lit(0).cast("bigint"), lambda s, n: s + n)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                tokens = expand(*unpacked(row))
                ends = np.cumsum(row["doc_tokens"])
                starts = ends - row["doc_tokens"]
                values = [of_document(tokens[s:e]) for s, e in zip(starts, ends, strict=True)]
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts + (row["offset"] + row["first"])),
                    pa.array(row["doc_tokens"], pa.int64()),
                ]
                value = pa.array(values, pa.int64() if kind == "bigint" else pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*columns, value], ["doc_id", "start", "n_tokens", "value"])

    return files.join(F.broadcast(offsets), "part").mapInArrow(
        decoded, f"doc_id bigint, start bigint, n_tokens bigint, value {kind}"
    )


def crc32(tokens: np.ndarray) -> int:
    """Unsigned crc32 of tokens as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(tokens.astype("<u4").tobytes())
