"""Positions within a group without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.session import durable

#: Positions that may go to all tasks: keys and a number each, some 100 bytes.
SENT_ROWS = 1_000_000


def running_total(
    rows: DataFrame,
    group: list[str],
    key: list[str],
    order: list[Column],
    value: Column,
    name: str,
    carry: bool = False,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the group up to and including the row.

    A plain window would send each group to one task. Here a range shuffle on (group, order)
    cuts the rows into even slices, hot groups included; each slice is summed by itself and
    gets the total of the group's earlier slices added. A slice border lies inside at most one
    group, so there are fewer of these offsets than slices and they are safe to broadcast.

    ``key`` names the columns that identify a row within its group, ``order`` must not tie.
    By default only the keys and the value take that route, and their positions come to the wide
    rows: up to ``SENT_ROWS`` of them are sent to all tasks, so that no text moves, more are joined.
    ``carry`` takes the whole row along, for rows that cost more to compute again than to move.
    """
    sort_columns = [F.col(f"_order{index}") for index in range(len(order))]
    helpers = [value.cast("long").alias("_value"), *[c.alias(f"_order{i}") for i, c in enumerate(order)]]
    routed = rows.select("*" if carry else F.struct(*group, *key).alias("_keys"), *helpers)
    if not carry:
        routed = routed.select("_keys.*", "_value", *sort_columns)
    sliced = routed.repartitionByRange(*group, *sort_columns)
    sliced = durable(sliced.withColumn("_slice", F.spark_partition_id()))

    totals = sliced.groupBy(*group, "_slice").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        totals.select(*group, "_slice", F.sum("_total").over(earlier).alias("_offset"))
        .filter(F.col("_offset").isNotNull())
    )

    inside = Window.partitionBy("_slice", *group).orderBy(*sort_columns).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_value").over(inside) + F.coalesce(F.col("_offset"), F.lit(0))
    kept = rows.columns if carry else [*group, *key]
    placed = sliced.join(F.broadcast(offsets), [*group, "_slice"], "left").select(
        *kept, total.cast("long").alias(name)
    )
    if carry:
        return placed
    few = sliced.count() <= SENT_ROWS  # row counts of a stage table's files
    return rows.join(F.broadcast(placed) if few else placed, [*group, *key])


def numbered(
    rows: DataFrame, group: list[str], key: list[str], order: list[Column], name: str, carry: bool = False
) -> DataFrame:
    """Add ``name``: the 1-based position within the group; ``order`` must not tie."""
    return running_total(rows, group, key, order, F.lit(1), name, carry)


def last_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep the row with the highest ``order`` of every key (the later duplicate wins)."""
    return _edge_per_key(rows, keys, F.max_by, order)


def first_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep the row with the lowest ``order`` of every key (the first match wins)."""
    return _edge_per_key(rows, keys, F.min_by, order)


def _edge_per_key(rows: DataFrame, keys: list[str], pick, order: str) -> DataFrame:
    # max_by/min_by combine on the map side, so a hot key shuffles one row per task.
    others = [column for column in rows.columns if column not in keys]
    picked = rows.groupBy(*keys).agg(pick(F.struct(*others), F.col(order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*rows.columns)
