"""Array expressions that Spark has no function for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

#: Elements that are summed up one by one; further ones take the sum of whole blocks.
BLOCK = 64


def running_sum(values: Column) -> Column:
    """Sums of the values up to each place, in nearly linear time: blocks are summed first."""
    def blocks(v: Column) -> Column:
        return F.when(F.size(v) > 0, F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))).otherwise(
            F.array(F.array().cast("array<int>")))

    def total(v: Column) -> Column:
        return F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def placed(parts: Column) -> Column:
        sums = F.transform(parts, total)
        # Blocks of blocks, so that a text of a million pieces stays cheap.
        return once(sums, lambda s: once(F.transform(blocks(s), total), lambda upper: F.flatten(F.transform(
            parts, lambda part, b: once(
                total(F.slice(upper, F.lit(1), F.floor(b / BLOCK).cast("int")))
                + total(F.slice(s, F.floor(b / BLOCK).cast("int") * BLOCK + 1, b % BLOCK)),
                lambda before: F.transform(part, lambda x, i: before + total(F.slice(part, F.lit(1), i + 1))))))))

    return once(values, lambda v: once(blocks(v), placed))


def pieces(text: Column, pattern: str) -> Column:
    """``array<struct<gap,match>>``: what a pattern finds, each after the text before it; the last gap has no match."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
