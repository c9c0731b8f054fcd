"""Exact top-k search by inner product with a pivot-distance index.

Components become floor(256 * x); scores are integer inner products. An extra coordinate gives all
vectors the length of the longest, so that a larger inner product is a smaller distance, and distances
obey the triangle inequality.

Index: each vector goes to the nearest of ``PIVOTS`` pivots with its distance to it. Sorted by pivot and
distance, runs of ``BLOCK`` vectors are the annuli: a block knows its least and largest distance. Pivots
are chosen farthest first from ``SAMPLE`` vectors (the documented bound); every vector is indexed.

Search: queries stand in blocks of neighbours. The annuli nearest to a query's own give it k scores, and
the k-th of them a radius. Around each pivot annuli are taken as far as that radius reaches by the
triangle inequality; beyond that no vector can reach the k-th score, not even as a tie. Block pairs are
scored as matrices, and each query's best k of all blocks remain.

Defined results: vectors that are null, or hold null or non-finite components, or have no id, take no
part. Shorter vectors count as if filled up with zeros. Rows of one id are one vector, the least of
them. A query is never its own result; ties go to the smaller id; with fewer than k candidates all are
returned. Equal vectors are spread over blocks by their ids, so a vector that a third of all rows share
is no hot group. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

PIVOTS, SAMPLE = 64, 4096
BLOCK, QUERY_BLOCK = 1024, 64
#: Added to a radius against rounding: distances are whole numbers' roots, far larger than this.
SLACK = 1e-3


def integer_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and whole components of the vectors that take part."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    values = F.col(vector).cast("array<double>")
    part = rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & F.forall(values, good))
    whole = F.transform(values, lambda x: F.floor(x * 256).cast("bigint"))
    return part.select(F.col(vec_id).alias("vec_id"), whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first rows of the sample, starting with its first."""
    chosen, near = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix, filled up with zeros."""
    sizes = column.value_lengths().to_numpy()
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of all rows: in doubles where these hold every partial sum exactly."""
    top = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    if top < 2**53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T


def _placed(vectors: DataFrame, pivots: np.ndarray, longest: float, width: int) -> DataFrame:
    """Each vector's nearest pivot and its distance to it."""
    raised = np.sqrt(np.maximum(longest - (pivots.astype(float) ** 2).sum(axis=1), 0))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("v"), width).astype(float)
            height = np.sqrt(np.maximum(longest - (rows**2).sum(axis=1), 0))
            apart = 2 * longest - 2 * (rows @ pivots.T.astype(float) + height[:, None] * raised)
            nearest = apart.argmin(axis=1)
            far = np.sqrt(np.maximum(apart[np.arange(len(rows)), nearest], 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(nearest.astype(np.int32)), pa.array(far)],
                ["vec_id", "v", "pivot", "far"],
            )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(made, f"vec_id {kind}, v array<bigint>, pivot int, far double")


def _blocks(placed: DataFrame, size: int, width: int) -> DataFrame:
    """Runs of up to ``size`` vectors of one pivot, sorted by distance: one row each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def rows(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
            pivots = table.column("pivot").to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(pivots)) + 1, len(pivots)]
            bounds = sorted({*edges.tolist(), *(p for a, b in zip(edges[:-1], edges[1:]) for p in range(a, b, size))})
            whole = len(bounds) - 1 if last or not bounds else len(bounds) - 2
            out = []
            for a, b in zip(bounds[:whole], bounds[1 : whole + 1]):
                part = table.slice(a, b - a).combine_chunks()
                far, ids = part.column("far").to_numpy(), part.column("vec_id").to_numpy()
                matrix = _matrix(part.column("v").chunk(0), width)
                out.append((int(pivots[a]), far[0], far[-1], int(ids[0]), ids.astype(np.int64), matrix.tobytes()))
            columns = list(zip(*out)) if out else [()] * 6
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["pivot", "low", "high", "first_id", "ids", "matrix"]
            )
            return batch, table.slice(bounds[whole] if bounds else 0)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * size:
                done, rest = rows(pa.Table.from_batches(held), False)
                held = rest.to_batches()
                yield done
        if held:
            yield rows(pa.Table.from_batches(held), True)[0]

    ordered = placed.repartitionByRange("pivot", "far", "vec_id").sortWithinPartitions("pivot", "far", "vec_id")
    made = ordered.mapInArrow(cut, "pivot int, low double, high double, first_id bigint, ids array<bigint>, matrix binary")
    return made.withColumn("block", F.xxhash64("pivot", "low", "high", "first_id"))


def _scored(pairs: DataFrame, k: int, width: int) -> DataFrame:
    """Best k of each query in each block: rows of pairs hold both sides' ids and matrices, and limits."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("q_ids", "q_matrix", "limits", "ids", "matrix")
            for i in range(batch.num_rows):
                q_ids, q, limits, ids, x = (batch.column(c)[i].as_py() for c in names)
                q_ids, ids = np.array(q_ids, np.int64), np.array(ids, np.int64)
                q, x = (np.frombuffer(m, np.int64).reshape(-1, width) for m in (q, x))
                if not width:
                    q, x = np.zeros((len(q_ids), 0), np.int64), np.zeros((len(ids), 0), np.int64)
                scores = products(q, x)
                for row in range(len(q_ids)):
                    own = scores[row]
                    open_ = ids != q_ids[row]
                    if limits is not None:
                        open_ &= own >= np.frombuffer(limits, np.int64)[row]
                    at = np.flatnonzero(open_)
                    if len(at) > k:
                        least = np.partition(own[at], len(at) - k)[len(at) - k]
                        at = at[own[at] >= least]
                    at = at[np.lexsort((ids[at], -own[at]))][:k]
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), q_ids[row])), pa.array(ids[at]), pa.array(own[at])],
                            ["query_id", "vec_id", "score"],
                        )

    rows = pairs.select("q_ids", "q_matrix", "limits", "ids", "matrix")
    return rows.mapInArrow(made, "query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's k best: query_id, rank from 1, vec_id, score. ``is_query`` is a condition on vec_id."""
    whole = stored(integer_vectors(vectors, vec_id, vector).select(F.col("vec_id").cast("bigint").alias("vec_id"), "v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    longest, width = whole.agg(F.max(square), F.max(F.size("v"))).head()
    longest, width = float(longest or 0), int(width or 0)
    sample = whole.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    sample = sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample
    pivots = choose_pivots(_matrix(sample, width), PIVOTS) if len(sample) else np.zeros((1, width), np.int64)

    placed = _placed(whole, pivots, longest, width)
    blocks = stored(_blocks(placed, BLOCK, width))
    queries = _blocks(placed.where(is_query), QUERY_BLOCK, width)
    queries = stored(queries.select(
        F.col("block").alias("q_block"), F.col("pivot").alias("q_pivot"), F.col("low").alias("q_low"),
        F.col("high").alias("q_high"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"),
    ))
    shells = blocks.select("block", "pivot", "low", "high")

    # First annuli: nearest to the query block's own, two of them so that k scores are likely.
    gap = F.greatest(F.col("low") - F.col("q_high"), F.col("q_low") - F.col("high"), F.lit(0.0))
    near = Window.partitionBy("q_block").orderBy("gap", "block")
    home = (
        queries.select("q_block", "q_pivot", "q_low", "q_high")
        .join(shells, F.col("pivot") == F.col("q_pivot"))
        .select("q_block", "block", gap.alias("gap"))
        .withColumn("turn", F.row_number().over(near))
        .where("turn <= 2")
        .select("q_block", "block")
    )
    full = lambda pairs, sides: pairs.join(sides, "q_block").join(blocks.select("block", "ids", "matrix"), "block")
    first = _scored(full(home, queries.withColumn("limits", F.lit(None).cast("binary"))), k, width)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("turn", F.row_number().over(best)).where(F.col("turn") == k).select("query_id", "score")
    limits = kth.join(
        queries.select("q_block", F.explode("q_ids").alias("query_id")), "query_id", "right"
    ).groupBy("q_block").agg(F.collect_list(F.struct("query_id", "score")).alias("limits"))

    reach = stored(_reach(queries.join(limits, "q_block"), pivots, longest, width))
    pairs = (
        reach.select("q_block", F.posexplode("nearest").alias("pivot", "nearest"), "farthest")
        .select("q_block", "pivot", "nearest", F.col("farthest")[F.col("pivot")].alias("farthest"))
        .join(shells, "pivot")
        .where((F.col("high") >= F.col("nearest")) & (F.col("low") <= F.col("farthest")))
        .select("q_block", "block")
    )
    found = _scored(full(pairs, reach.select("q_block", "q_ids", "q_matrix", "limits")), k, width)
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _reach(queries: DataFrame, pivots: np.ndarray, longest: float, width: int) -> DataFrame:
    """Per query block: least scores of its queries, and around each pivot the distances they reach."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                ids = np.array(batch.column("q_ids")[i].as_py(), np.int64)
                rows = np.frombuffer(batch.column("q_matrix")[i].as_py(), np.int64).reshape(len(ids), width)
                least = {r["query_id"]: r["score"] for r in batch.column("limits")[i].as_py()}
                known = [least.get(q) for q in ids.tolist()]
                limit = np.array([np.iinfo(np.int64).min if s is None else s for s in known], np.int64)
                score = np.array([-np.inf if s is None else float(s) for s in known])
                length = (rows.astype(float) ** 2).sum(axis=1)
                radius = np.sqrt(np.maximum(length + longest - 2 * score, 0))
                far = np.sqrt(np.maximum((length + longest)[:, None] - 2 * (rows.astype(float) @ pivots.T.astype(float)), 0))
                edge = radius[:, None] * (1 + 1e-9) + SLACK
                out.append((limit.tobytes(), (far - edge).min(axis=0), (far + edge).max(axis=0)))
            columns = [pa.array([r[0] for r in out], pa.binary())]
            columns += [pa.array([r[j].tolist() for r in out], pa.list_(pa.float64())) for j in (1, 2)]
            sides = [batch.column(c) for c in ("q_block", "q_ids", "q_matrix")]
            yield pa.RecordBatch.from_arrays([*sides, *columns], ["q_block", "q_ids", "q_matrix", "limits", "nearest", "farthest"])

    return queries.mapInArrow(
        made, "q_block bigint, q_ids array<bigint>, q_matrix binary, limits binary, nearest array<double>, farthest array<double>"
    )
