"""Language-model scoring by a hierarchical Pitman-Yor model: word pairs over words over letters.

Tokens are words between ASCII white space, A-Z lower-cased, and one end per text. Each word, and the start
of a text, is a context with a restaurant of its own, which seats the words that follow it in the training
texts. The tables of all contexts are customers of one restaurant of words, which they share; each of its tables
orders the word's spelling once from the restaurants of letters. The end of a text has no context: its
probability is its share of the tokens, and the restaurants are of what is no end. A letter (a byte, or the end of a word) is seated under its context of the two
letters before it; the tables of a context are customers of the context one letter shorter, which all
contexts with that last letter share, down to the uniform distribution over 257 letters.

Seating is sampled by Gibbs sweeps. In a sweep each word's customers are seated anew, given the tables of all
other words and the letters' probabilities of the sweep before; then the letters' customers, from the longest
contexts to the shortest; then the customers of each pair, given the words' probabilities and the context's
tables. Random numbers are hashes of the word or pair, the sweep and the customer, so a repeated task gets the
same seating. After ``BURN_IN`` sweeps the words' probabilities, the pairs' tables and the contexts' tables of
``SAMPLES`` sweeps are averaged, and these give the scores.

Pairs are counted in buckets: a part of the texts sends a bucket one row with its distinct pairs and their
counts. A bucket has whole contexts, but pairs of a context with more than a bucket's share of the tokens are
spread over all buckets. A pair that occurs once always has one table, so only pairs that occur more often
have rows in the sweeps; how many of the others a context or a word has follows from its tokens. Words and
pairs are named by 64-bit hashes.

All words that the training texts do not have are one outcome, as in the base score: its probability is
what new tables give to spellings of no known word.

Counts come from all training texts, by shuffles on the word and the bucket. The letter tables are what the driver
and all tasks hold: at most 256 ** 2 + 257 contexts of 257 letters, whatever the corpus.

Defined results: a null or empty text is the end alone. Rows of one id are scored each by itself. Without
training texts all words are unknown. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import dropped, stored
from .texts import mixed, slices, split_words, text_of, utf8, word_hashes

BURN_IN, SAMPLES = 1, 3
#: Discount and strength of the contexts' restaurants of words, of the words' restaurant they share, and of the letters' restaurants by length of context.
PAIR_DISCOUNT, PAIR_STRENGTH = 0.8, 1.0
WORD_DISCOUNT, WORD_STRENGTH = 0.6, 100.0
LETTER_DISCOUNT, LETTER_STRENGTH = (0.5, 0.5, 0.5), (1.0, 1.0, 1.0)
#: The end of a word as a letter, and the number of letters.
STOP, LETTERS = 256, 257
#: Text of a part, in bytes: the words of one part meet their counts in one task.
PART_BYTES = 12_000_000
#: Training tokens for each bucket of pairs: the pairs of one bucket are counted in one task.
BUCKET_TOKENS = 1_000_000
#: Keys of sums that are not of letters: all tables, the known words' probability, and all customers.
TABLES, MASS, CUSTOMERS = -1, -2, -3
#: Customers seated one by one; beyond that steps grow by an eighth of what is seated.
SINGLE = 32


def uniform(keys: np.ndarray, turn: int) -> np.ndarray:
    """Random numbers in [0, 1) that depend on the keys and the turn only."""
    with np.errstate(over="ignore"):
        return (mixed(keys + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)).astype(float) * 2.0**-53


def seat(customers: np.ndarray, fresh: np.ndarray, discount: float, keys: np.ndarray, turn: int) -> np.ndarray:
    """Tables after seating each dish's customers; ``fresh`` is the weight of a new table with the dish.

    A customer opens a table with probability fresh / (fresh + seated - discount * tables). Where many are
    seated, a step takes several customers, whose number of new tables is rounded at random.
    """
    tables = np.minimum(customers, 1).astype(float)
    open_, seated, round_ = np.flatnonzero(customers > 1), 1, 0
    while len(open_):
        step = 1 if seated < SINGLE else seated // 8
        many = np.minimum(step, customers[open_] - seated)
        chance = fresh[open_] / (fresh[open_] + seated - discount * tables[open_])
        tables[open_] += np.floor(many * chance + uniform(keys[open_], turn * 1000 + round_))
        seated, round_ = seated + step, round_ + 1
        open_ = open_[customers[open_] > seated]
    return np.minimum(tables, customers)


def spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all letters of all words: the word's number, the context of two letters, and the letter."""
    words = words.cast(pa.binary())
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes + 1)
    letters = np.full(int(ends[-1]) if len(ends) else 0, STOP, np.int64)
    inside = np.ones(len(letters), bool)
    inside[ends - 1] = False
    letters[inside] = np.frombuffer(b"".join(words.to_pylist()), np.uint8)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    place = np.arange(len(letters)) - np.repeat(ends - sizes - 1, sizes + 1)
    # The stop letter stands before the first one.
    back = lambda k: np.where(place >= k, np.r_[np.zeros(k, np.int64), letters[:-k]][: len(letters)], STOP)
    return owner, back(2) * LETTERS + back(1), letters


class Letters:
    """Letter probabilities of one sweep: a row of 257 logarithms for each context met, and shorter ones."""

    def __init__(self, contexts: np.ndarray, letters: np.ndarray, customers: np.ndarray, turn: int) -> None:
        levels = [(contexts, letters, customers)]
        seats = []
        for length in (2, 1, 0):
            contexts, letters, customers = levels[-1]
            keys = mixed((contexts * LETTERS + letters).astype(np.uint64) + np.uint64(length << 40))
            # A first guess of the parent's probability: its customers if each dish had one table.
            shorter = contexts % LETTERS if length == 2 else np.zeros_like(contexts)
            groups, at = np.unique(shorter * LETTERS + letters, return_inverse=True)
            dishes = np.bincount(at)
            whole = np.bincount((groups // LETTERS).astype(np.int64), dishes, LETTERS)
            parent = dishes[at] / whole[shorter] if length else np.full(len(letters), 1 / LETTERS)
            names, of = np.unique(contexts, return_inverse=True)
            for again in (0, 1):  # tables of the context itself: first as if one per dish
                own = np.bincount(of, tables if again else np.minimum(customers, 1))[of]
                fresh = (LETTER_STRENGTH[length] + LETTER_DISCOUNT[length] * own) * parent
                tables = seat(customers, fresh, LETTER_DISCOUNT[length], keys, turn * 10 + length * 2 + again)
            seats.append((names, of, contexts, letters, customers, tables))
            levels.append((groups // LETTERS, groups % LETTERS, np.bincount(at, tables).astype(np.int64)))
        rows = np.full((1, LETTERS), 1 / LETTERS)
        index = np.zeros(LETTERS * LETTERS, np.int64)
        for length, (names, of, contexts, letters, customers, tables) in zip((0, 1, 2), reversed(seats), strict=True):
            d, s = LETTER_DISCOUNT[length], LETTER_STRENGTH[length]
            total, own = np.bincount(of, customers), np.bincount(of, tables)
            parents = rows[index[names]] if length < 2 else rows[index[names % LETTERS]]
            new = parents * ((s + d * own) / (s + total))[:, None]
            np.add.at(new, (of, letters), (customers - d * tables) / (s + total[of]))
            if length == 0:
                rows = new if len(new) else rows
            elif length == 1:
                index[:LETTERS] = 0
                index[names] = len(rows) + np.arange(len(names))
                rows = np.concatenate([rows, new])
            else:
                two = index[np.arange(LETTERS * LETTERS) % LETTERS]  # where the long context is new
                two[names] = len(rows) + np.arange(len(names))
                index, rows = two, np.concatenate([rows, new])
        self.index, self.logs = index.astype(np.int32), np.log(rows)

    def word_logs(self, words: pa.Array) -> np.ndarray:
        """Natural logarithm of each word's probability by its letters."""
        owner, contexts, letters = spelled(words)
        return np.bincount(owner, self.logs[self.index[contexts], letters], len(words))


def packed(ids: np.ndarray) -> bytes:
    """Numbers of 32 bits byte plane by byte plane: the high planes compress to nothing."""
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def _before(ids: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    """The context of each word: the word before it, or ``start`` for the first of a text."""
    before = np.r_[np.full(min(1, len(ids)), start, np.int64), ids[:-1]]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = start
    return before


def _pairs(
    ids: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, hot: np.ndarray, buckets: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a part in the order in which it sends them: bucket, context and word, as local numbers.

    Also each token's pair, and each token's context.
    """
    before = _before(ids, sizes, len(hashes) - 1)
    keys, at = np.unique(before * len(hashes) + ids, return_inverse=True)
    contexts, words = keys // len(hashes), keys % len(hashes)
    by_context, by_pair = mixed(hashes)[contexts], pair_hashes(hashes[contexts], hashes[words])
    bucket = np.where(np.isin(hashes, hot)[contexts], by_pair, by_context) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return bucket[order].astype(np.int64), contexts[order], words[order], place[at], before


def pair_hashes(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mixed(mixed(contexts) ^ (words + np.uint64(0x9E3779B97F4A7C15)))


def _tokenized(documents: DataFrame) -> DataFrame:
    """Slices of documents: their words as numbers of the slice's vocabulary, and its training counts.

    ``counts`` are of a word as a token, ``follows`` of words after it; the empty word is the end, or the start.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for batch in (piece for b in batches for piece in slices(b, "text", PART_BYTES)):
            bounds, ids, vocabulary = split_words(utf8(batch.column("text")))
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            counts = np.bincount(ids[train[text_of(bounds)]], minlength=len(vocabulary))
            words = pa.concat_arrays([vocabulary, pa.array([""])])  # the end of a text is the empty word
            learnt = train[text_of(bounds)]
            follows = np.bincount(_before(ids, np.diff(bounds), len(vocabulary))[learnt], minlength=len(words))
            counts = [*counts.tolist(), int(train.sum())]
            values = [part, batch.column("doc_id"), train, np.diff(bounds), packed(ids), words, counts, follows]
            numbers = pa.list_(pa.int64())
            kinds = [pa.int64(), None, pa.list_(pa.bool_()), numbers, pa.binary(), None, numbers, numbers]
            whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            columns = [
                whole(v) if isinstance(v, pa.Array) else pa.array([v.tolist() if isinstance(v, np.ndarray) else v], k)
                for v, k in zip(values, kinds, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_ids", "train", "sizes", "ids", "words", "counts", "follows"])
            part += 1

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.mapInArrow(
        made,
        f"part bigint, doc_ids array<{kind}>, train array<boolean>, sizes array<bigint>, ids binary, words array<string>, "
        "counts array<bigint>, follows array<bigint>",
    )


def _word_tables(batch: pa.RecordBatch, letters: Letters | None, tables: float, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables of each word in one sweep, and the logarithm of its probability by letters."""
    counts = batch.column("c").to_numpy()
    if letters is None:
        return np.ones(len(counts)), np.zeros(len(counts))
    logs = letters.word_logs(batch.column("word"))
    fresh = (WORD_STRENGTH + WORD_DISCOUNT * tables) * np.exp(logs)
    return seat(counts, fresh, WORD_DISCOUNT, word_hashes(batch.column("word")), turn), logs


def _sweep(counts: DataFrame, letters: Letters | None, tables: float, turn: int) -> tuple[Letters, float, float, float]:
    """One sweep: seat all words, add up the letters they order, and seat those.

    Returns the letters' new probabilities, the number of tables, the probability of all known words together
    by the letters' old ones, and the number of customers.
    """
    shared = counts.sparkSession.sparkContext.broadcast(None if letters is None else (letters.index, letters.logs))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _letters(shared.value)
        total: dict[str, np.ndarray] = {"key": np.zeros(0, np.int64), "n": np.zeros(0)}
        for batch in batches:
            word_tables, logs = _word_tables(batch, known, tables, turn)
            owner, contexts, letter = spelled(batch.column("word"))
            keys, at = np.unique(np.r_[total["key"], contexts * LETTERS + letter, TABLES, MASS, CUSTOMERS], return_inverse=True)
            sums = word_tables.sum(), np.exp(logs).sum(), batch.column("c").to_numpy().sum()
            weight = np.r_[total["n"], word_tables[owner], sums]
            total = {"key": keys, "n": np.bincount(at, weight)}
        yield pa.RecordBatch.from_arrays([pa.array(total["key"]), pa.array(total["n"])], ["key", "n"])

    sums = counts.mapInArrow(ordered, "key bigint, n double").groupBy("key").agg(F.sum("n").alias("n"))
    rows = sums.toArrow()  # at most one row for each context and letter
    keys, n = (rows.column(c).to_numpy() for c in ("key", "n"))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    real = keys >= 0
    made = Letters(keys[real] // LETTERS, keys[real] % LETTERS, n[real].astype(np.int64), turn)
    return made, *(float(n[keys == key].sum()) for key in (TABLES, MASS, CUSTOMERS))


def _letters(value: tuple[np.ndarray, np.ndarray] | None) -> Letters | None:
    if value is None:
        return None
    letters = Letters.__new__(Letters)
    letters.index, letters.logs = value
    return letters


class Sample(NamedTuple):
    """What a sweep's probabilities of words are made of: letters and tables before it, tables after it."""

    index: np.ndarray
    logs: np.ndarray
    before: float
    turn: int
    after: float
    customers: float

    def probabilities(self, batch: pa.RecordBatch) -> np.ndarray:
        """Probability of each word in the restaurant that all contexts share; ``c`` are its customers there."""
        seated, by_letters = _word_tables(batch, _letters((self.index, self.logs)), self.before, self.turn)
        new = (WORD_STRENGTH + WORD_DISCOUNT * self.after) * np.exp(by_letters)
        return (batch.column("c").to_numpy() - WORD_DISCOUNT * seated + new) / (WORD_STRENGTH + self.customers)


def _with_column(batch: pa.RecordBatch, name: str, values: np.ndarray) -> pa.RecordBatch:
    at = batch.schema.get_field_index(name)
    return batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))


def _hashed(words: DataFrame) -> DataFrame:
    """Words with their hash in column ``h``."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _with_column(batch, "h", word_hashes(batch.column("word")).view(np.int64))

    rows = words.withColumn("h", F.lit(None).cast("bigint"))
    return rows.mapInArrow(made, rows.schema)


def _counted_pairs(parts: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Pairs of all training texts, counted.

    A row with a part answers the pairs it sent to the bucket, in their order: 0 or 1 for the count, or from 2 on
    the number of the pair, less 2, among those of the bucket that occur more often. The row without a part has
    these: their contexts, words and counts.
    """

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                hashes = word_hashes(row.column("words").flatten())
                sizes = row.column("sizes").flatten().to_numpy()
                ids = unpacked(row.column("ids")[0].as_py())
                bucket, contexts, words, at, _ = _pairs(ids, sizes, hashes, hot, buckets)
                learnt = np.repeat(row.column("train").flatten().to_numpy(zero_copy_only=False), sizes)
                n = np.bincount(at[learnt], minlength=len(bucket))
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
                out = []
                for low, high in zip(cuts, np.r_[cuts, len(bucket)][1:], strict=True):
                    run = np.flatnonzero(np.r_[True, contexts[low + 1 : high] != contexts[low : high - 1]])
                    out.append(
                        (
                            int(bucket[low]),
                            row.column("part")[0].as_py(),
                            hashes[contexts[low:high][run]].tobytes(),
                            packed(np.diff(np.r_[run, high - low])),
                            hashes[words[low:high]].tobytes(),
                            packed(n[low:high]),
                        )
                    )
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                columns = zip(*out, strict=True) if out else [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    ["bucket", "part", "contexts", "runs", "words", "n"],
                )

    def counted(rows: pa.Table) -> pa.Table:
        """Counts of one bucket."""
        column = lambda name: [x.as_py() for x in rows.column(name)]
        joined = lambda name, get: np.concatenate([get(x) for x in column(name)])
        hashes = lambda x: np.frombuffer(x, np.uint64)
        contexts, words = np.repeat(joined("contexts", hashes), joined("runs", unpacked)), joined("words", hashes)
        _, first, at = np.unique(pair_hashes(contexts, words), return_index=True, return_inverse=True)
        c = np.bincount(at, joined("n", unpacked)).astype(np.int64)
        many = c > 1
        codes = np.where(many, np.cumsum(many) + 1, c)[at]
        ends = np.cumsum([len(x) // 8 for x in column("words")])
        answers = [packed(x) for x in np.split(codes, ends[:-1])]
        bucket, none = rows.column("bucket")[0].as_py(), [None] * len(answers)
        return pa.table(
            {
                "bucket": pa.array([bucket] * (len(answers) + 1), pa.int64()),
                "part": pa.array([*column("part"), None], pa.int64()),
                "codes": pa.array([*answers, packed(c[many])], pa.binary()),
                "contexts": pa.array([*none, contexts[first][many].tobytes()], pa.binary()),
                "words": pa.array([*none, words[first][many].tobytes()], pa.binary()),
            }
        )

    rows = parts.select("part", "train", "sizes", "ids", "words").mapInArrow(
        sent, "bucket bigint, part bigint, contexts binary, runs binary, words binary, n binary"
    )
    return rows.groupBy("bucket").applyInArrow(
        counted, "bucket bigint, part bigint, codes binary, contexts binary, words binary"
    )


def _pair_rows(counted: DataFrame) -> DataFrame:
    """A row for each pair that occurs more than once, with no tables yet."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, codes, contexts, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = unpacked(codes)
                zero = np.zeros(len(c))
                u, w = np.frombuffer(contexts, np.int64), np.frombuffer(words, np.int64)
                columns = [np.full(len(c), bucket), np.arange(len(c), dtype=np.int32), u, w, c, zero, zero]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["bucket", "k", "u", "w", "c", "t", "sum"])

    rows = counted.where(F.col("part").isNull()).select("bucket", "codes", "contexts", "words")
    return rows.mapInArrow(made, "bucket bigint, k int, u bigint, w bigint, c bigint, t double, sum double")


def _seated_pairs(pairs: DataFrame, contexts: DataFrame, state: DataFrame, turn: int) -> DataFrame:
    """Pairs with their tables of one sweep, added to ``sum`` after the burn-in."""
    rows = (
        pairs.select("bucket", "k", "u", "w", "c", "t", "sum")
        .join(contexts, "u")
        .join(state.select(F.col("h").alias("w"), "p"), "w")
        .select("bucket", "k", "u", "w", "c", "t", "sum", "single", "tables", "p")
    )

    def seated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, w = (batch.column(x).to_numpy().view(np.uint64) for x in ("u", "w"))
            fresh = (PAIR_STRENGTH + PAIR_DISCOUNT * batch.column("tables").to_numpy()) * batch.column("p").to_numpy()
            t = seat(batch.column("c").to_numpy(), fresh, PAIR_DISCOUNT, pair_hashes(u, w), turn)
            total = batch.column("sum").to_numpy() + (t if turn > BURN_IN else 0.0)
            yield _with_column(_with_column(batch, "t", t), "sum", total).select(range(8))

    return rows.mapInArrow(
        seated, "bucket bigint, k int, u bigint, w bigint, c bigint, t double, sum double, single bigint"
    )


def scored(documents: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, trained, n_tokens, n_known, train_tokens, base_score and score.

    ``train`` is a condition on the documents: which of them the model learns from.
    """
    rows = documents.select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train")
    )
    spark = documents.sparkSession
    parts = stored(_tokenized(rows))
    words = parts.select("part", F.posexplode(F.arrays_zip("words", "counts", "follows")).alias("place", "w"))
    words = words.select("part", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("n"), F.col("w.follows").alias("follows"))
    known = words.where("n > 0").groupBy("word").agg(F.sum("n").alias("n"), F.sum("follows").alias("follows"))
    known = stored(_hashed(known))
    total, distinct = known.agg(F.sum("n"), F.count(F.lit(1))).head()
    total, distinct = int(total or 0), int(distinct)
    ends = known.where("word = ''").select("n").head()
    p_end = ((ends.n if ends else 0) + 0.5) / (total + 1)

    buckets = 1 + total // BUCKET_TOKENS
    # Fewer contexts than buckets, as their shares add up to the tokens.
    large = known.where(F.col("follows") > total // buckets).select("h") if buckets > 1 else known.select("h").limit(0)
    hot = np.array([r.h for r in large.collect()], np.int64).view(np.uint64)
    counted = stored(_counted_pairs(parts, buckets, hot))
    pairs = stored(_pair_rows(counted))

    of_context = pairs.groupBy("u").agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("n_pairs"))
    single = F.col("follows") - F.col("tokens")
    contexts = of_context.join(known.select(F.col("h").alias("u"), "follows"), "u").select(
        "u", single.alias("single"), (single + F.col("n_pairs")).cast("double").alias("tables")
    )
    # Customers of a word in the restaurant of words: ``single`` pairs that occur once, and tables of the others.
    of_word = pairs.groupBy("w").agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("n_pairs")).withColumnRenamed("w", "h")
    known = stored(
        known.join(of_word, "h", "left").select(
            "word", "h", "n", "follows", "n_pairs", (F.col("n") - F.coalesce("tokens", F.lit(0))).alias("single")
        )
    )
    plain = known.where("n_pairs IS NULL").select("word", "h", "n", "follows", F.col("single").alias("c"))
    state = known.where("n_pairs IS NOT NULL").select(
        "word", "h", "n", "follows", "single", (F.col("single") + F.col("n_pairs")).alias("c"), F.lit(0.0).alias("p"), F.lit(0.0).alias("sum")
    )
    state = stored(state)

    samples: list[Sample] = []
    unknown = 0.0  # probability of all words together that training texts do not have
    customers = lambda: plain.where("word <> ''").select("word", "c").union(state.select("word", "c"))
    letters, tables, *_ = _sweep(customers(), None, 0.0, 0)
    for turn in range(1, BURN_IN + SAMPLES + 1):
        after, tables_after, mass, seats = _sweep(customers(), letters, tables, turn)
        sample = Sample(letters.index, letters.logs, tables, turn, tables_after, seats)
        if turn > BURN_IN:
            samples.append(sample)
            new = (WORD_STRENGTH + WORD_DISCOUNT * tables_after) / (WORD_STRENGTH + seats)
            unknown += new * max(1.0 - mass, 0.0) / SAMPLES
        before, state = state, stored(_weighed(state, sample))
        dropped(before)
        before, pairs = pairs, stored(_seated_pairs(pairs, contexts, state, turn))
        dropped(before)  # the sweep before; a lost executor reads this one's files
        contexts = pairs.groupBy("u").agg(
            F.first("single").alias("single"), (F.first("single") + F.sum("t")).alias("tables")
        )
        if turn < BURN_IN + SAMPLES:
            seated = pairs.groupBy("w").agg(F.sum("t").cast("bigint").alias("t")).withColumnRenamed("w", "h")
            before, state = state, stored(
                state.join(seated, "h").select(
                    "word", "h", "n", "follows", "single", (F.col("single") + F.col("t")).alias("c"), "p", "sum"
                )
            )
            dropped(before)
        letters, tables = after, tables_after
    shared = spark.sparkContext.broadcast(samples)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = sum(sample.probabilities(batch) for sample in shared.value) / SAMPLES
            columns = [*(batch.column(c) for c in ("word", "h", "n", "follows")), pa.array(p)]
            yield pa.RecordBatch.from_arrays(columns, ["word", "h", "n", "follows", "p"])

    seated = pairs.groupBy("u").agg((F.first("single") + F.sum("sum") / SAMPLES).alias("tables")).withColumnRenamed("u", "h")
    # Of a context: its tables. Where no pair occurs twice, each word has one.
    model = plain.mapInArrow(predicted, "word string, h bigint, n bigint, follows bigint, p double").union(
        state.select("word", "h", "n", "follows", (F.col("sum") / SAMPLES).alias("p"))
    )
    rest = PAIR_STRENGTH + PAIR_DISCOUNT * F.coalesce("tables", "follows")
    model = model.join(seated, "h", "left").select("word", F.col("n").alias("c"), "follows", rest.alias("rest"), "p")
    # A new name for the part: both sides of the last step come from the same table.
    found = words.select("part", "place", "word").join(model, "word")
    values = counted.where(F.col("part").isNotNull()).select(F.col("bucket").alias("of_bucket"), "part", "codes")
    direct = pairs.select("bucket", "k", (F.col("c") - PAIR_DISCOUNT * F.col("sum") / SAMPLES).alias("direct"))

    def answered(key: tuple, asked: pa.Table, met: pa.Table) -> pa.Table:
        """What the pairs that parts sent to one bucket have in their contexts, less the discounts."""
        weights = np.zeros(met.num_rows + 2, np.float32)
        weights[1] = 1 - PAIR_DISCOUNT
        weights[met.column("k").to_numpy() + 2] = met.column("direct").to_numpy()
        out = [weights[unpacked(x.as_py())].tobytes() for x in asked.column("codes")]
        bucket = pa.array([key[0].as_py()] * len(out), pa.int64())
        return pa.table({"part": asked.column("part"), "bucket": bucket, "direct": pa.array(out, pa.binary())})

    met = values.groupBy("of_bucket").cogroup(direct.groupBy("bucket"))
    met = met.applyInArrow(answered, "part bigint, bucket bigint, direct binary")
    none = lambda kind: F.lit(None).cast(kind)
    found = found.select(
        F.col("part").alias("of_part"), "place", "c", "follows", "rest", "p", none("bigint").alias("bucket"), none("binary").alias("direct")
    ).union(
        met.select("part", none("int"), none("bigint"), none("bigint"), none("double"), none("double"), "bucket", "direct")
    )

    def summed(texts: pa.Table, met: pa.Table) -> pa.Table:
        """Scores of the texts of one part, with what is known of its words and pairs in ``met``."""
        row = texts.slice(0, 1).combine_chunks()
        first = lambda name: row.column(name).chunk(0).flatten()
        hashes, sizes = word_hashes(first("words")), first("sizes").to_numpy().astype(np.int64)
        end = len(hashes) - 1
        c, follows = np.zeros(end + 1, np.int64), np.zeros(end + 1, np.int64)
        rest, p = np.full(end + 1, PAIR_STRENGTH), np.full(end + 1, unknown)
        of_words = met.filter(pc.is_valid(met.column("place")))
        place = of_words.column("place").to_numpy()
        for values, name in ((c, "c"), (follows, "follows"), (rest, "rest"), (p, "p")):
            values[place] = of_words.column(name).to_numpy()
        of_pairs = met.filter(pc.is_valid(met.column("bucket"))).sort_by("bucket").column("direct")
        direct = np.frombuffer(b"".join(x.as_py() for x in of_pairs), np.float32).astype(float)
        ids = unpacked(row.column("ids")[0].as_py())
        *_, pair, before = _pairs(ids, sizes, hashes, hot, buckets)
        by_word = (1.0 - p_end) * (direct[pair] + rest[before] * p[ids]) / (PAIR_STRENGTH + follows[before])
        log_p = np.log10(np.maximum(np.insert(by_word, np.cumsum(sizes), p_end), np.finfo(float).tiny))
        ids = np.insert(ids, np.cumsum(sizes), end)
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        base = np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
        add = lambda values: np.bincount(owner, values, len(sizes))
        return pa.table(
            {
                "doc_id": texts.column("doc_ids").combine_chunks().flatten(),
                "trained": first("train"),
                "n_tokens": sizes + 1,
                "n_known": add((c > 0).astype(float)[ids]).astype(np.int64),
                "train_tokens": np.full(len(sizes), total),
                "base_score": add(base[ids]),
                "score": add(log_p),
            }
        )

    kind = documents.schema[doc_id].dataType.simpleString()
    texts = parts.select("part", "doc_ids", "train", "sizes", "ids", "words")
    return texts.groupBy("part").cogroup(found.groupBy("of_part")).applyInArrow(
        summed,
        f"doc_id {kind}, trained boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )


def _weighed(state: DataFrame, sample: Sample) -> DataFrame:
    """Words with their probability in one sweep, added to ``sum`` after the burn-in."""
    shared = state.sparkSession.sparkContext.broadcast(sample)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.probabilities(batch)
            total = batch.column("sum").to_numpy() + (p if shared.value.turn > BURN_IN else 0.0)
            yield _with_column(_with_column(batch, "p", p), "sum", total)

    return state.mapInArrow(made, state.schema)
