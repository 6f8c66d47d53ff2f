"""Shards along a Hilbert curve: rows that are alike in several columns get into the same files.

Each dimension is cut into ``2 ** bits`` cells at its own quantiles, the cells are numbered along a
Hilbert curve, rows are sorted by that number and the sorted run is cut into shards of equal row
counts.  Neighbours on the curve are neighbours in every dimension, so the minimum and maximum that
Parquet keeps for each file rule most files out for a filter on any of the dimensions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plain, written

#: Cells per dimension are ``2 ** BITS``.
BITS = 4
#: Bytes of a text that decide its order among the cut points, after what all values have in common.
TEXT_BYTES = 6


@cache
def curve(dimensions: int, bits: int) -> tuple[int, ...]:
    """Position on the Hilbert curve of every cell; cells count with the last dimension fastest."""
    side = 1 << bits
    x = list(np.indices((side,) * dimensions).reshape(dimensions, -1))
    for bit in range(bits - 1, 0, -1):  # undo the rotations, from the coarsest square to the finest
        low = (1 << bit) - 1
        for i in range(dimensions):
            inverted = (x[i] >> bit) & 1 == 1
            swapped = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(inverted, x[0] ^ low, x[0] ^ swapped)
            if i:
                x[i] = x[i] ^ swapped
    for i in range(1, dimensions):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> bit) & 1 == 1, turn ^ ((1 << bit) - 1), turn)
    position = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dimensions):
            position = position << 1 | ((x[i] ^ turn) >> bit) & 1
    return tuple(int(p) for p in position)


def _text_number(column: Column, skip: int) -> Column:
    """A text as a number that sorts like its bytes, as far as ``TEXT_BYTES`` go."""
    tail = F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), skip + 1, TEXT_BYTES)), 2 * TEXT_BYTES, "0")
    return F.conv(tail, 16, 10).cast("double")


def curve_index(df: DataFrame, dimensions: Sequence[str], bits: int = BITS) -> Column:
    """The expression that numbers a row's cell on the curve.

    Two small aggregates over all rows fix the cells: what the texts of a column have in common,
    and the quantiles of every dimension.  NULL belongs to the lowest cell.
    """
    kinds = {c: df.schema[c].dataType for c in dimensions}
    texts = [c for c in dimensions if isinstance(kinds[c], T.StringType)]
    ends = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(texts) for n, f in (("a", F.min), ("b", F.max))]).first() if texts else {}
    numbers = []
    for c in dimensions:
        if c in texts:
            i = texts.index(c)
            a, b = ((ends[f"{n}_{i}"] or "").encode() for n in "ab")
            same = next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
            numbers.append(_text_number(F.col(c), same))
        else:
            numbers.append(F.col(c).cast("double"))
    parts = 1 << bits
    cuts = df.agg(*[
        F.percentile_approx(n, [k / parts for k in range(1, parts)]).alias(f"q{i}") for i, n in enumerate(numbers)]).first()
    cell = F.lit(0)
    for i, n in enumerate(numbers):
        above = F.lit(0)
        for cut in cuts[f"q{i}"] or []:
            above = above + F.when(n > cut, 1).otherwise(0)
        cell = cell * parts + above
    positions = F.split(F.lit(",".join(map(str, curve(len(numbers), bits)))), ",").cast("array<int>")
    return F.get(positions, cell)


def shard_rows(
    df: DataFrame, dimensions: Sequence[str], key: Sequence[str], shards: int = 8, bits: int = BITS,
) -> DataFrame:
    """The columns of ``key`` and ``dimensions``, ``curve``, ``shard`` and ``slot`` for every row.

    Shards hold consecutive runs of the curve whose row counts differ by one at most; ``slot``
    counts from 0 in each.  ``key`` orders the rows of one cell, and should be unique: rows alike
    in key and cell are interchangeable.  NULLs sort first, an empty table gives no rows.  Hot
    cells are no matter, since the sort splits a cell by key; only narrow columns move.
    """
    names = list(dict.fromkeys([*key, *dimensions]))
    narrow = written(plain(df, **{c: c for c in names}))
    order = ["curve", *key]
    # Equal ranges of the sort order, written once with the place of every row in its range.
    ranges = written(
        narrow.withColumn("curve", curve_index(narrow, dimensions, bits))
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each range: as many as the sort had tasks.
    sizes = sizes.withColumn("_before", F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    total = ranges.count()
    rank = F.coalesce(F.col("_before"), F.lit(0)) + F.col("_place")
    shard = F.expr(f"(_rank * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return (
        ranges.join(sizes, "_part").withColumn("_rank", rank)
        .withColumn("shard", shard.cast("int"))
        .select(*names, "curve", "shard", (F.col("_rank") - first).alias("slot")))


def write_shards(df: DataFrame, path: str, dimensions: Sequence[str], files: int, bits: int = BITS) -> None:
    """Write all columns as Parquet files that each cover a short run of the curve."""
    curved = df.withColumn("_curve", curve_index(df, dimensions, bits))
    curved.repartitionByRange(files, "_curve", *dimensions).sortWithinPartitions("_curve", *dimensions).drop(
        "_curve").write.parquet(path)
