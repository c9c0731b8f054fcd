"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures.

Words are what stands between ASCII white space, A-Z lower-cased; a document's set holds its distinct
runs of ``SHINGLE`` words, or the whole sequence where there are fewer. Documents are linked when the
sets have a Jaccard similarity of 0.75 or more; a group is what links connect.

1. Documents of equal sets are one class. Each class has a signature of 48 MinHash symbols of 16 bits.
2. The signature is cut into 12 chunks of 4 symbols. By the pigeonhole principle two signatures with at
   most 23 different symbols agree in some chunk but for one symbol, so each class stands under 48
   keys: every chunk without one of its symbols. All pairs within that distance share a key. At a
   similarity of 0.75 a pair without a shared key has a probability of 1e-7.
3. Each class is compared with the least class under each of its keys, on full sets, and what is linked
   is joined to components. Copies of one text are so found by one link each, not by all pairs.
4. Under a key with classes of several components, pairs across them are compared: pair by pair where
   there are few. The classes under crowded keys meet by prefixes of their sets, rarest shingles first,
   which all linked pairs share; a passage that thousands have stands last there and proposes nothing.
   Nothing is left out, and no pairs of one component are formed.

Defined results: an empty or null text has an empty set, is linked with nothing and is kept. Rows with
one id count as one document. A row without an id is not compared: no component, kept. Ties go to the
smallest id. Of an empty table nothing is returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import components
from .storage import stored
from .texts import gram_hashes, mixed, slices, split_words, text_of, utf8, word_hashes

SHINGLE = 5
#: Symbols of a signature, bits of a symbol, and symbols of a chunk.
SYMBOLS, SYMBOL_BITS, CHUNK = 48, 16, 4
#: Links need PART[0] * intersection >= PART[1] * union.
PART = (100, 75)
#: Text bytes whose sets a task holds at once.
SET_BYTES = 1_000_000
#: Pairs across components under one key that are compared as rows; with more, classes meet by rare shingles.
ROW_PAIRS = 500
#: Slots of the table of shingle counts that goes to all tasks, and slots that are added up together.
RARITY_SLOTS, RARITY_BLOCK = 1 << 20, 1 << 11
_rng = np.random.RandomState(75)
_A = _rng.randint(0, 2**62, SYMBOLS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.randint(0, 2**62, SYMBOLS).astype(np.uint64)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the texts' sets, and the sorted distinct shingles of each as 64-bit hashes."""
    bounds, ids, vocabulary = split_words(utf8(texts))
    words = word_hashes(vocabulary)[ids] if len(ids) else np.zeros(0, np.uint64)
    owner, ends = text_of(bounds), bounds[1:]
    grams = gram_hashes(words, SHINGLE)
    inside = np.arange(len(grams)) + SHINGLE <= ends[owner[: len(grams)]]
    rows, values = [owner[: len(grams)][inside]], [grams[inside]]
    sizes = np.diff(bounds)
    for size in range(1, SHINGLE):  # short texts: the whole sequence as one
        short = np.flatnonzero(sizes == size)
        if len(short):
            rows.append(short)
            values.append(gram_hashes(words, size)[bounds[short]] ^ np.uint64(size))
    rows, values = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    rows, values = rows[first], values[first]
    return np.searchsorted(rows, np.arange(len(sizes) + 1)), values


def signatures(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """b-bit MinHash of each set that is not empty, a row of 16-bit symbols each."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(starts), SYMBOLS), np.uint16)
    step = 1 << 15
    with np.errstate(over="ignore"):
        cut = 0
        while cut < len(starts):  # sets of about ``step`` shingles at once
            stop = max(cut + 1, int(np.searchsorted(starts, starts[cut] + step)))
            end = starts[stop] if stop < len(starts) else len(values)
            part = values[starts[cut] : end]
            for k in range(SYMBOLS):
                least = np.minimum.reduceat(part * _A[k] + _B[k], starts[cut:stop] - starts[cut])
                out[cut:stop, k] = (mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)
            cut = stop
    return out


def _similar(n: Column, m: Column) -> Column:
    """Sizes that allow a link."""
    return PART[0] * F.least(n, m) >= PART[1] * F.greatest(n, m)


def _linked(common: Column, n: Column, m: Column) -> Column:
    return PART[0] * common >= PART[1] * (n + m - common)


def _described(documents: DataFrame) -> DataFrame:
    """Per document: set size, 128 bits of the set, and the signature."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for b in batches for piece in slices(b, "text", SET_BYTES)):
            bounds, values = shingle_sets(batch.column("text"))
            sizes = np.diff(bounds)
            rows = np.flatnonzero(sizes)
            a, b = np.zeros((2, len(sizes)), np.int64)
            for i in rows:
                digest = xxhash.xxh3_128_intdigest(values[bounds[i] : bounds[i + 1]].tobytes())
                a[i], b[i] = np.array([digest & 2**64 - 1, digest >> 64], np.uint64).view(np.int64)
            signs = signatures(bounds, values)
            # An empty set has an empty signature.
            ends = np.concatenate(([0], np.cumsum((sizes > 0) * signs.itemsize * SYMBOLS))).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(signs)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(a), pa.array(b), packed],
                ["doc_id", "n_shingles", "a", "b", "signature"],
            )

    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, a bigint, b bigint, signature binary"
    return documents.mapInArrow(made, schema)


def _keys(classes: DataFrame) -> DataFrame:
    """48 keys of each class: a chunk's number, the number of the symbol left out, and the other three."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sign = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            keys = np.zeros((len(sign), SYMBOLS), np.uint64)
            for out in range(SYMBOLS):
                first = out - out % CHUNK
                key = np.full(len(sign), out, np.uint64)
                for i in range(first, first + CHUNK):
                    if i != out:
                        key = key << np.uint64(SYMBOL_BITS) | sign[:, i].astype(np.uint64)
                keys[:, out] = key
            take = pa.array(np.repeat(np.arange(len(sign)), SYMBOLS))
            columns = [batch.column(c).take(take) for c in ("class", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), *columns], ["key", "class", "n"])

    kind = classes.schema["class"].dataType.simpleString()
    return classes.mapInArrow(made, f"key bigint, class {kind}, n bigint")


def _sets(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """Full sets of the classes: the sorted shingles of the document that names the class."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for b in batches for piece in slices(b, "text", SET_BYTES)):
            bounds, values = shingle_sets(batch.column("text"))
            sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sets], ["class", "shingles"])

    rows = documents.join(classes.select(F.col("class").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(made, f"class {kind}, shingles array<bigint>")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) whose full sets are linked."""
    left = sets.select(F.col("class").alias("x"), F.col("shingles").alias("left"))
    right = sets.select(F.col("class").alias("y"), F.col("shingles").alias("right"))
    rows = pairs.select("x", "y").join(left, "x").join(right, "y")
    common = F.size(F.array_intersect("left", "right"))
    return rows.where(_linked(common, F.size("left"), F.size("right"))).select("x", "y")


def _rarity(sets: DataFrame) -> np.ndarray:
    """How often shingles stand in ``sets``, counted in ``RARITY_SLOTS`` slots by their hash.

    A task gives one row for each block of slots that it has counts in, so rows do not grow with the sets.
    """

    def rows_of(counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        some = np.flatnonzero(counts)
        cuts = np.flatnonzero(np.diff(some // RARITY_BLOCK)) + 1
        for at in np.split(some, cuts) if len(some) else ():
            yield int(at[0] // RARITY_BLOCK), at, counts[at]

    def packed(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> list[pa.Array]:
        ends = pa.array(np.cumsum([0, *(len(at) for _, at, _ in rows)]).astype(np.int32))
        flat = lambda k: pa.array(np.concatenate([np.zeros(0, np.int64), *(r[k] for r in rows)]))
        lists = [pa.ListArray.from_arrays(ends, flat(k)) for k in (1, 2)]
        return [pa.array([block for block, *_ in rows], pa.int32()), *lists]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(RARITY_SLOTS, np.int64)
        for batch in batches:
            values = batch.column("shingles").flatten().to_numpy().view(np.uint64)
            counts += np.bincount((values % RARITY_SLOTS).astype(np.int64), minlength=RARITY_SLOTS)
        yield pa.RecordBatch.from_arrays(packed(list(rows_of(counts))), ["block", "slots", "n"])

    def summed(rows: pa.Table) -> pa.Table:
        slots, n = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("slots", "n"))
        block = rows.column("block")[0].as_py()
        counts = np.bincount(slots - block * RARITY_BLOCK, n, RARITY_BLOCK).astype(np.int64)
        at = np.flatnonzero(counts)
        return pa.table(packed([(block, at + block * RARITY_BLOCK, counts[at])]), ["block", "slots", "n"])

    schema = "block int, slots array<bigint>, n array<bigint>"
    found = sets.select("shingles").mapInArrow(counted, schema).groupBy("block").applyInArrow(summed, schema).toArrow()
    out = np.zeros(RARITY_SLOTS, np.int64)  # no more than the slots come to the driver
    if len(found):
        slots, n = (found.column(c).combine_chunks().flatten().to_numpy() for c in ("slots", "n"))
        out[slots] = n
    return out


def _prefixes(sets: DataFrame, rarity: np.ndarray) -> DataFrame:
    """Rows (s, class, label, n, i): the rarest shingles of each set with their places in its order.

    Of two sets of n <= m shingles that are linked, the first n - ceil(6 n / 7) + 1 of the one and the first
    m - ceil(3 m / 4) + 1 of the other share one, in any order that is the same for both. Rarest first keeps
    what all sets have out of the prefixes. A shingle that is alone in its slot is in no other set.
    """
    shared = sets.sparkSession.sparkContext.broadcast(rarity)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, rows, out = batch.column("shingles"), [], []
            bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            for row, (start, end) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                mine = values[start:end]
                often = shared.value[(mine % RARITY_SLOTS).astype(np.int64)]
                first = np.lexsort((mine, often))[: _prefix(len(mine), PART[1], PART[0])]
                places = np.flatnonzero(often[first] > 1)
                rows.append(np.full(len(places), row))
                out.append((mine[first[places]].view(np.int64), np.full(len(places), len(mine)), places))
            take = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            s, n, i = (pa.array(np.concatenate(x)) for x in zip(*out, strict=True)) if out else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays(
                [s, batch.column("class").take(take), batch.column("label").take(take), n, i], ["s", "class", "label", "n", "i"]
            )

    kind = sets.schema["class"].dataType.simpleString()
    return sets.select("class", "label", "shingles").mapInArrow(cut, f"s bigint, class {kind}, label {kind}, n bigint, i bigint")


def _prefix(n: int, part: int, whole: int) -> int:
    """Length of a prefix that leaves fewer than part / whole of n behind it."""
    return n + (-part * n) // whole + 1


def _crowded_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across components among the classes under crowded keys, found by their rarest shingles.

    Under each such shingle every class is first compared with the least one, and components are joined by
    what is linked. Then pairs that still lie in different components are compared, as far as their sizes
    and the places of the shingle allow a link at all.
    """
    full = stored(sets.join(rows.select("class", "label").distinct(), "class"))
    prefixes = stored(_prefixes(full, _rarity(full)))
    lead = prefixes.groupBy("s").agg(
        F.min(F.struct("class", "label", "n")).alias("lead"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    stars = (
        prefixes.join(lead.where("low <> high").select("s", "lead"), "s")
        .where((F.col("label") != F.col("lead.label")) & _similar(F.col("n"), F.col("lead.n")))
        .select(F.col("lead.class").alias("x"), F.col("class").alias("y"))
    )
    near = stored(_links(stars.distinct(), sets))
    label_of = lambda c: full.select(F.col("class").alias(c), F.col("label").alias(f"{c}_label"))
    bridges = near.join(label_of("x"), "x").join(label_of("y"), "y").select(F.col("x_label").alias("x"), F.col("y_label").alias("y"))
    joined = components(bridges).select(F.col("node").alias("label"), F.col("label").alias("top"))
    prefixes = prefixes.join(joined, "label", "left").select("s", "class", F.coalesce("top", "label").alias("label"), "n", "i")
    short = F.col("i") < F.col("n") - F.ceil(F.col("n") * 2 * PART[1] / (PART[0] + PART[1])) + 1
    side = lambda kept, end: kept.select("s", *[F.col(c).alias(f"{c}{end}") for c in ("class", "label", "n", "i")])
    # What the sets can still have in common from the shingle on, and what a link takes.
    rest = F.least(F.col("n1") - F.col("i1"), F.col("n2") - F.col("i2"))
    least = F.ceil((F.col("n1") + F.col("n2")) * PART[1] / (PART[0] + PART[1]))
    pairs = (
        side(prefixes.where(short), 1)
        .join(side(prefixes, 2), "s")
        .where("n1 < n2 OR (n1 = n2 AND class1 < class2)")
        .where((F.col("label1") != F.col("label2")) & _similar(F.col("n1"), F.col("n2")) & (rest >= least))
        .select(F.col("class1").alias("x"), F.col("class2").alias("y"))
    )
    return near.union(_links(pairs.distinct(), sets))


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id of its group) and kept."""
    documents = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    described = stored(_described(documents))
    classes = described.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).groupBy("a", "b").agg(
        F.min("doc_id").alias("class"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")
    )
    classes = stored(classes)
    keys = _keys(classes)
    least = F.min(F.struct("class", "n"))
    shared = keys.groupBy("key").agg(least.alias("lead"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many")
    members = stored(keys.join(shared, "key"))
    sets = stored(_sets(documents, members.select("class").distinct()))
    stars = members.where((F.col("class") != F.col("lead.class")) & _similar(F.col("n"), F.col("lead.n")))
    links = _links(stars.select(F.col("lead.class").alias("x"), F.col("class").alias("y")).distinct(), sets)
    labels = components(links)

    named = labels.select(F.col("node").alias("class"), "label")
    members = members.join(named, "class", "left").select("key", "class", "n", F.coalesce("label", "class").alias("label"))
    pairs = (
        members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
        .groupBy("key").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("across"))
        .where("across > 0")
    )
    mixed_keys = stored(members.join(pairs, "key"))
    few = mixed_keys.where(F.col("across") <= ROW_PAIRS)
    one, two = (few.select("key", *[F.col(c).alias(f"{c}{i}") for c in ("class", "n", "label")]) for i in (1, 2))
    rows = (
        one.join(two, "key")
        .where("class1 < class2 AND label1 <> label2")
        .where(_similar(F.col("n1"), F.col("n2")))
        .select(F.col("class1").alias("x"), F.col("class2").alias("y"))
        .distinct()
    )
    more = _links(rows, sets).union(_crowded_links(mixed_keys.where(F.col("across") > ROW_PAIRS).drop("across", "n"), sets))
    # What these links join are components: their labels are the nodes of a small second graph.
    label_of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    bridges = (
        more.join(label_of("x"), "x", "left").join(label_of("y"), "y", "left")
        .select(F.coalesce("x_label", "x").alias("x"), F.coalesce("y_label", "y").alias("y"))
    )
    joined = components(bridges.where("x <> y")).select(F.col("node").alias("label"), F.col("label").alias("final"))
    of_class = (
        classes.select("a", "b", "class")
        .join(named, "class", "left")
        .withColumn("label", F.coalesce("label", "class"))
        .join(joined, "label", "left")
        .select("a", "b", F.coalesce("final", "label").alias("component_id"))
    )
    known = F.col("doc_id").isNotNull()
    return (
        described.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("a")).alias("a"), "b")
        .join(of_class, ["a", "b"], "left")
        .select("doc_id", "n_shingles", F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"))
        .withColumn("kept", ~known | (F.col("doc_id") == F.col("component_id")))
    )


def deduplicated(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with the columns it came with."""
    found = near_duplicates(documents, doc_id, text)
    dropped = found.where(~F.col("kept")).select(F.col("doc_id").alias(doc_id)).distinct()
    return documents.join(dropped, doc_id, "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])
