"""Substring dedup: words covered by passages that a document with a smaller id has as well.

Words are what stands between ASCII white space, unchanged. A window is ``WINDOW`` consecutive words of
one document; every word that a window covers is removed where the same window starts in a document
with a smaller id. Windows are judged on the input.

1. Documents of one word sequence: all but the smallest id lose all words, if they have a window at all.
   The rest of the work is done for one document of each sequence.
2. Every window is given the phrase of ``PHRASE`` words with the least hash in it, so equal windows have
   equal phrases. A phrase that two documents have is a recurring one: only windows around it can
   recur. There is about one phrase for 20 words, counted under its hash and combined before the shuffle.
3. Tasks take the documents with recurring phrases in shards, compile the shard's phrases into an
   Aho-Corasick automaton and stream the shard's texts through it: each occurrence is located, and the
   windows around it get two 64-bit hashes.
4. The least id of each window hash confirms which windows recur; their starts make ranges of words.

Defined results: a null or empty text has no words. Documents of fewer than ``WINDOW`` words lose none.
Rows of one id are never compared with each other, and each loses words by its own text; a row without
an id is not compared at all.
Repeated windows inside a document are no reason to remove words. The kept text is the kept words joined
by one space. Two different windows pass for the same with a probability of 2 ** -128.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .texts import gram_hashes, slices, split_words, text_of, utf8, word_hashes

WINDOW, PHRASE = 50, 8
#: Bytes of a table that may go to all tasks; a larger one is joined by a shuffle.
SENT_BYTES = 24_000_000
#: Text of a shard, in bytes.
SHARD_BYTES = 3_000_000
_RANGES = "array<struct<start:int,end:int>>"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` values."""
    done, least = 1, values
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    return least


def phrases(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and word place of the least phrase of each window, once where neighbours share it."""
    grams = gram_hashes(words, PHRASE)
    reach = WINDOW - PHRASE + 1
    none = np.zeros(0, np.int64)
    if len(grams) < reach:
        return none, none, none
    least, owner = sliding_least(grams, reach), text_of(bounds)
    starts = np.arange(len(least))
    inside = starts + WINDOW <= bounds[1:][owner[: len(least)]]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1 : len(least)] != owner[: len(least) - 1]) | ~inside[:-1]
    at = starts[inside & new]
    place = at + (grams[at[:, None] + np.arange(reach)] == least[at][:, None]).argmax(axis=1)
    return owner[at], least[at].view(np.int64), place - bounds[owner[at]]


def window_hashes(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the windows that start at ``starts``, from running sums of weighted words."""
    out = []
    with np.errstate(over="ignore"):
        for base in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
            inverse = pow(base, -1, 2**64)
            power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(words), base, np.uint64)])
            back = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(words), inverse, np.uint64)])
            total = np.r_[np.uint64(0), np.cumsum(words * power[:-1])]
            out.append(((total[starts + WINDOW] - total[starts]) * back[starts]).view(np.int64))
    return out[0], out[1]


def _described(documents: DataFrame) -> DataFrame:
    """Per document: its text's key, number of words, 128 bits of the word sequence, and its phrases."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for b in batches for piece in slices(b)):
            bounds, ids, vocabulary = split_words(utf8(batch.column("text")), lower=False)
            words = word_hashes(vocabulary)[ids] if len(ids) else np.zeros(0, np.uint64)
            digests = [
                xxhash.xxh3_128_intdigest(words[s:e].tobytes()) for s, e in zip(bounds[:-1], bounds[1:], strict=True)
            ]
            a, b = (np.array([d >> k & 2**64 - 1 for d in digests], np.uint64).view(np.int64) for k in (0, 64))
            owner, grams, places = phrases(words, bounds)
            cuts = pa.array(np.searchsorted(owner, np.arange(len(digests) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(np.diff(bounds)),
                    pa.array(a),
                    pa.array(b),
                    pa.ListArray.from_arrays(cuts, pa.array(grams)),
                    pa.ListArray.from_arrays(cuts, pa.array(places.astype(np.int32))),
                ],
                ["doc_id", "text_key", "n_words", "a", "b", "phrases", "places"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.mapInArrow(
        made, f"doc_id {kind}, text_key string, n_words bigint, a bigint, b bigint, phrases array<bigint>, places array<int>"
    )


def _sent(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` with the hint to send them to all tasks, if their size in bytes allows it."""
    return F.broadcast(rows) if (sizes.head()[0] or 0) <= SENT_BYTES else rows


def _windows(marked: DataFrame) -> DataFrame:
    """Windows around every occurrence of a shard's phrases: doc_id and text (ta, tb), starts and two hashes."""

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for b in batches for piece in slices(b, "text", SHARD_BYTES)):
            texts = [t.split() for t in pc.cast(utf8(batch.column("text")), pa.binary()).to_pylist()]
            shard = ahocorasick.Automaton()
            for words, places in zip(texts, batch.column("places").to_pylist(), strict=True):
                for p in places:
                    shard.add_word(f" {b' '.join(words[p : p + PHRASE]).decode()} ", 0)
            shard.make_automaton()
            bounds, ids, vocabulary = split_words(utf8(batch.column("text")), lower=False)
            hashes = word_hashes(vocabulary)[ids]
            near = np.zeros(len(ids) + 1, np.int64)  # +1 where windows around an occurrence begin, -1 behind them
            for base, end, words in zip(bounds[:-1].tolist(), bounds[1:].tolist(), texts, strict=True):
                line = f" {b' '.join(words).decode()} "
                begins = np.cumsum([1, *(len(w.decode()) + 1 for w in words)])
                stops = np.fromiter((stop for stop, _ in shard.iter(line)), np.int64)
                place = np.searchsorted(begins, stops + 1) - PHRASE
                first = np.maximum(place - (WINDOW - PHRASE), 0)
                last = np.minimum(place, end - base - WINDOW)
                good = first <= last
                np.add.at(near, base + first[good], 1)
                np.add.at(near, base + last[good] + 1, -1)
            starts = np.flatnonzero(np.cumsum(near) > 0)
            owner = text_of(bounds)[starts]
            a, b = window_hashes(hashes, starts)
            # A window that a document repeats is one row with all its starts.
            order = np.lexsort((starts, b, a, owner))
            a, b, owner, starts = a[order], b[order], owner[order], starts[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (owner[1:] != owner[:-1])
            first = np.flatnonzero(new)
            places = pa.array((starts - bounds[owner]).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(a)].astype(np.int32)), places)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(pa.array(owner[first])) for c in ("doc_id", "ta", "tb")),
                    lists,
                    pa.array(a[first]),
                    pa.array(b[first]),
                ],
                ["doc_id", "ta", "tb", "starts", "a", "b"],
            )

    kind = marked.schema["doc_id"].dataType.simpleString()
    return marked.select("doc_id", "ta", "tb", "text", "places").mapInArrow(
        located, f"doc_id {kind}, ta bigint, tb bigint, starts array<int>, a bigint, b bigint"
    )


def _as_ranges(starts: DataFrame) -> DataFrame:
    """Ranges of words that the windows of each document cover."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.column("starts"):
                at = np.unique(row.values.flatten().to_numpy())
                cut = np.flatnonzero(np.diff(at) > WINDOW) + 1
                rows.append([{"start": int(p[0]), "end": int(p[-1]) + WINDOW} for p in np.split(at, cut)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            names = ["doc_id", "ta", "tb"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(rows, kind)], [*names, "ranges"])

    rows = starts.groupBy("doc_id", "ta", "tb").agg(F.collect_list("starts").alias("starts"))
    kind = starts.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(joined, f"doc_id {kind}, ta bigint, tb bigint, ranges {_RANGES}")


def repeated_ranges(documents: DataFrame) -> DataFrame:
    """Of documents (doc_id, text, text_key) that lose words: doc_id, text_key and the ranges of words."""
    described = stored(_described(documents))
    long = described.where((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
    first = long.groupBy("a", "b").agg(F.min("doc_id").alias("first"))
    copies = long.join(first, ["a", "b"]).where(F.col("doc_id") > F.col("first"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))).alias("ranges")
    copies = copies.select("doc_id", F.col("a").alias("ta"), F.col("b").alias("tb"), whole)
    # One document of each sequence: its phrases.
    name = F.struct("doc_id", "text_key", F.col("a").alias("ta"), F.col("b").alias("tb"), "phrases", "places")
    firsts = long.groupBy("a", "b").agg(F.min_by(name, F.struct("doc_id", "text_key")).alias("d"))
    pairs = F.explode(F.arrays_zip("phrases", "places")).alias("pair")
    single = firsts.select("d.*").select("doc_id", "text_key", "ta", "tb", pairs)
    single = stored(single.select("doc_id", "text_key", "ta", "tb", F.col("pair.phrases").alias("phrase"), F.col("pair.places").alias("place")))
    recurring = single.groupBy("phrase").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    recurring = recurring.where("least <> most").select("phrase")
    marks = single.join(recurring, "phrase").groupBy("doc_id", "text_key", "ta", "tb").agg(F.collect_set("place").alias("places"))
    marks = stored(marks)
    size = marks.agg(F.sum(F.size("places") * 4 + 100))
    windows = stored(_windows(documents.join(_sent(marks, size), ["doc_id", "text_key"])))
    owners = windows.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    found = windows.join(owners.where("least <> most"), ["a", "b"]).where(F.col("doc_id") > F.col("least"))
    ranges = copies.unionByName(_as_ranges(found.select("doc_id", "ta", "tb", "starts")))
    # Texts of one id and the same words lose the same, whatever their white space.
    texts = long.select("doc_id", "text_key", F.col("a").alias("ta"), F.col("b").alias("tb")).distinct()
    return ranges.join(texts, ["doc_id", "ta", "tb"]).select("doc_id", "text_key", "ranges")


def without_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_removed and kept_text, the words that stay."""
    value = F.col(text).cast("string")
    key = F.md5(F.coalesce(value, F.lit("")).cast("binary"))
    documents = documents.select(F.col(doc_id).alias("doc_id"), value.alias("text"), key.alias("text_key"))
    ranges = stored(repeated_ranges(documents))
    ranges = ranges.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    size = ranges.agg(F.sum(F.size("ranges") * 24 + 80))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for b in batches for piece in slices(b)):
            kept, counts, removed = [], [], []
            texts = pc.cast(utf8(batch.column("text")), pa.binary()).to_pylist()
            for words, ranges in zip(map(bytes.split, texts), batch.column("ranges").to_pylist(), strict=True):
                stay = words
                if ranges:
                    covered = np.zeros(len(words) + 1, bool)
                    for r in ranges:
                        covered[r["start"] : r["end"]] = True
                    stay = [words[i] for i in np.flatnonzero(~covered[:-1])]
                kept.append(b" ".join(stay))
                counts.append(len(words))
                removed.append(len(words) - len(stay))
            columns = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", "kept_text"])

    rows = documents.join(_sent(ranges, size), ["doc_id", "text_key"], "left").drop("text_key")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string")
