"""Ordered computations per key that stay distributed when one key is very large."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourlens.operators.partitioning import materialize


def dedupe_first(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """First spelling of each value per key, ignoring case.

    A grouped ``min_by`` combines on the map side, so a repeated value costs
    one row per task, not a sorted group.
    """
    first = F.min_by(value, F.struct(*order)).alias(value)
    return df.groupBy(*keys, F.lower(value).alias("_key")).agg(first).drop("_key")


def number_by_length(mentions: DataFrame) -> DataFrame:
    """Number distinct mentions per (question, type): longest first, then first found.

    Groups are the mentions of one question, so they are bounded by its text.
    """
    distinct = mentions.groupBy("question_id", "entity_type", "value").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("question_id", "entity_type").orderBy(F.desc(F.length("value")), "pos")
    return distinct.withColumn("ordinal", F.row_number().over(order) - 1)


#: Rows of one key that are ordered together, at most.
SLICE = 100_000


def even_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = SLICE, name: str = "_chunk") -> DataFrame:
    """Add a column that cuts each key, in ``order``, into slices of at most ``rows`` rows, in the order of their values.

    The whole table is range-partitioned and sorted by key and order, so one
    key, one hour or one instant of it lies over as many tasks as its rows
    need. A slice is the place of a partition and of a block of rows in it.
    ``order`` must tell all rows of a key apart; the slices are then the same
    whenever a task is run again. Read the result once, or write it first: two
    evaluations may draw different bounds.
    """
    at = F.monotonically_increasing_id()  # partition in the upper bits, place in the lower 33
    ordered = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return ordered.withColumn(name, at).withColumn(name, (F.col(name) - F.pmod(name, F.lit(rows))).cast("long"))


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | None, sums: Mapping[str, Column],
    keep_chunk: bool = False,
) -> DataFrame:
    """Add inclusive running sums per key, in ``order``, without one task per key.

    ``chunk`` maps a row to an order-preserving slice of its key (for example
    the hour of its timestamp); without one, slices of equal size are written
    first (:func:`even_slices`). Sums run inside (key, chunk); the totals of the
    earlier chunks, one small row each, are added back. The rows are shuffled
    on (key, chunk); a key of any size spreads over its chunks.
    """
    keys = list(keys)
    sliced = materialize(even_slices(df, keys, order)) if chunk is None else df.withColumn("_chunk", chunk)
    for name, value in sums.items():
        sliced = sliced.withColumn(f"_v_{name}", value)
    # Repartitioned once here: the window and the chunk totals both reuse it.
    sliced = sliced.repartition(*keys, "_chunk")
    inside = (
        Window.partitionBy(*keys, "_chunk").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = sliced.select("*", *(F.sum(f"_v_{n}").over(inside).alias(f"_s_{n}") for n in sums))
    totals = sliced.groupBy(*keys, "_chunk").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums))
    before = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys, "_chunk", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums)
    )
    joined = local.join(offsets, [*keys, "_chunk"])
    return joined.select(
        *df.columns, *(["_chunk"] if keep_chunk else []), *((F.col(f"_s_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums)
    )
