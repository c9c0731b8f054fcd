"""Toxicity: logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

A text's features are its words (runs of letters and digits, A-Z lower-cased), their first ``STEM``
letters, pairs of neighbours and pairs that skip one word, each hashed to one of 2 ** ``BITS`` places and counted once. Each place has its
own learning rate, and the L1 term keeps the weight of most places at zero, so the model that goes to
all tasks is a short list of places and weights.

The model is fitted on at most ``SAMPLE_ROWS`` labelled documents, those of the lowest hash of their id
(the documented bound of this operator); their features are made by all tasks and one task passes over
them ``EPOCHS`` times in the order of that hash. Every document is scored over its whole text.

Defined results: a null or empty text has the bias as its only feature and gets a score like any other.
Labels that are null, or whose document is missing, are not learned from; a model without any
weight (no labelled document) gives all texts the score 0: nothing is known to be toxic. Of several labels of one id the largest counts. Equal texts get equal
scores. Other columns stay; one named as the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import ALNUM_TABLE, mixed, slices, split_words, text_of, translated, utf8, word_hashes

BITS = 22
#: Most labelled documents that the model is fitted on.
SAMPLE_ROWS = 12_000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.1
#: Letters of a word that also count by themselves, so that endings of a word are one feature.
STEM = 5
#: From this score on a text is predicted as toxic.
THRESHOLD = 0.3
#: Bytes of text that a task makes features of at once.
SLICE = 2_000_000


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For all texts: the text's number and the feature's place; place 0 is the bias of each text."""
    bounds, ids, vocabulary = split_words(translated(utf8(texts), ALNUM_TABLE), lower=False)
    words = word_hashes(vocabulary)[ids] if len(ids) else np.zeros(0, np.uint64)
    stems = word_hashes(pc.utf8_slice_codeunits(vocabulary, 0, STEM))[ids] if len(ids) else words
    owner = text_of(bounds)
    rows = [np.arange(len(bounds) - 1), owner]
    places = [np.zeros(len(bounds) - 1, np.int64), (mixed(~stems) >> np.uint64(64 - BITS)).astype(np.int64)]
    for step in (0, 1, 2):
        with np.errstate(over="ignore"):
            value = words if not step else words[:-step] * np.uint64(2 * step + 1) + mixed(words[step:])
        same = slice(None) if not step else owner[:-step] == owner[step:]
        rows.append((owner if not step else owner[:-step])[same])
        places.append((mixed(value[same]) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(places)


def _feature_rows(labelled: DataFrame) -> DataFrame:
    """Feature places of each labelled text, as bytes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for b in batches for piece in slices(b, "text", SLICE)):
            rows, places = features(batch.column("text"))
            keys = np.unique(rows << BITS | places)
            cuts = np.searchsorted(keys >> BITS, np.arange(1, batch.num_rows))
            packed = [p.astype(np.int32).tobytes() for p in np.split(keys & (1 << BITS) - 1, cuts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("turn"), batch.column("label"), pa.array(packed, pa.binary())], ["turn", "label", "places"]
            )

    return labelled.select("turn", "label", "text").mapInArrow(made, "turn bigint, label int, places binary")


def fit_rows(rows: list[tuple[int, np.ndarray]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over (label, places) in the given order; the places with a weight, and the weights."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(epochs):
        for label, at in rows:
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35.0, 35.0))) - label
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - rate * w
            n[at] += g * g
    found = np.flatnonzero(np.abs(z) > L1)
    return found, weights(found)


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[tuple[int, float]]:
    """Fit on documents (doc_id, text) and labels (doc_id, label); the places that have a weight."""
    turn = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = (
        labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("label").cast("int").alias("label"))
        .select("doc_id", "label", turn.alias("turn"))
        .orderBy("turn", "doc_id")
        .limit(sample_rows)
    )
    # At most sample_rows small rows: the bound of this broadcast.
    rows = _feature_rows(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [
            (label, np.frombuffer(places, np.int32))
            for batch in batches
            for label, places in zip(batch.column("label").to_pylist(), batch.column("places").to_pylist(), strict=True)
        ]
        places, weights = fit_rows(seen)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(weights)], ["place", "weight"])

    ordered = rows.repartition(1).sortWithinPartitions("turn", "places")
    return [tuple(r) for r in ordered.mapInArrow(trained, "place bigint, weight double").collect()]


def scored(documents: DataFrame, model: list[tuple[int, float]], text: str = "text", score: str = "score") -> DataFrame:
    """Documents with column ``score``, 0 to 1, of their whole texts."""
    documents = documents.drop(score)
    schema = T.StructType([*documents.schema.fields, T.StructField(score, T.DoubleType())])
    model = sorted(model)
    places, weights = np.array([p for p, _ in model], np.int64), np.array([w for _, w in model])
    shared = documents.sparkSession.sparkContext.broadcast((places.tobytes(), weights.tobytes()))

    def score_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, weights = (np.frombuffer(b, t) for b, t in zip(shared.value, (np.int64, np.float64), strict=True))
        known = np.zeros(1 << BITS, bool)
        known[places] = True
        for batch in (piece for b in batches for piece in slices(b, text, SLICE)):
            rows, at = features(batch.column(text))
            kept = known[at]
            keys = np.unique(rows[kept] << BITS | at[kept])
            values = weights[np.searchsorted(places, keys & (1 << BITS) - 1)] if len(keys) else np.zeros(0)
            total = np.bincount(keys >> BITS, values, batch.num_rows)
            column = pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35.0, 35.0))) * bool(len(places)))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, score])

    return documents.mapInArrow(score_rows, schema)


def remainder(doc_id: Column, parts: int) -> Column:
    """The fold of a document: crc32 of its id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts
