"""Seeded train / validation / test split with exact sizes.

Rows are ordered by the hash of their key.  Instead of ranking all rows, the split looks for the
two hash values at which the sizes are reached: hash prefixes are counted (at most 65 536 counts),
and only the prefix that contains a cut-off is looked at closer.  After that the split is a plain
column expression on each row: no window over the table, no shuffle of the rows, and the same
answer on any partitioning.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import seeded
from ..functions.paths import top

PREFIX = 4


def normalize_ratios(ratios: Sequence[float]) -> tuple[float, float, float]:
    train, valid, test = ratios
    if min(ratios) < 0 or train + valid + test <= 0:
        raise ValueError("ratios must not be negative and must not all be zero")
    total = train + valid + test
    if math.isclose(total, 1.0):
        return train, valid, test
    warnings.warn(f"Ratios sum to {total}, they will be normalized.", stacklevel=3)
    return train / total, valid / total, test / total


def split_sizes(n: int, ratios: Sequence[float] = (0.8, 0.1, 0.1)) -> tuple[int, int, int]:
    """Sizes of train, validation and test: the held-out part is rounded up, then divided."""
    train, valid, test = normalize_ratios(ratios)
    rest = math.ceil(n * (1.0 - train)) if train < 1.0 else 0
    if valid > 0 and test > 0:
        n_test = math.ceil(rest * (1.0 - valid / (valid + test)))
        return n - rest, rest - n_test, n_test
    return (n - rest, rest, 0) if valid > 0 else (n - rest, 0, rest)


def split_dataset(
    df: DataFrame,
    key: str,
    ratios: Sequence[float] = (0.8, 0.1, 0.1),
    seed: int = 42,
    exact: bool = True,
) -> DataFrame:
    """Input plus ``split`` (``train``, ``valid`` or ``test``).

    ``key`` is a unique, non-null column.  Rows that share a key stay together, and the sizes are
    then met as closely as whole keys allow.  ``exact=True`` runs two small counting jobs right
    away; ``exact=False`` runs none and meets the sizes only in expectation.
    """
    order = F.md5(seeded.seed_text(top(key), "split", seed))
    if not exact:
        train, valid, _ = normalize_ratios(ratios)
        u = seeded.unit(seeded.seed_text(top(key), "split", seed))
        label = F.when(u < train, "train").when(u < train + valid, "valid").otherwise("test")
        return df.withColumn("split", label)

    hashed = df.select(order.alias("h"))
    counts = hashed.groupBy(F.substring("h", 1, PREFIX).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in counts)
    if total == 0:
        raise ValueError("No data to split.")
    n_train, n_valid, n_test = split_sizes(total, ratios)
    ends = _cut_offs(hashed, {r["p"]: r["n"] for r in counts}, [n_test, n_test + n_valid])
    label = F.when(_up_to(order, ends[0]), "test").when(_up_to(order, ends[1]), "valid").otherwise("train")
    return df.withColumn("split", label)


def _up_to(order: Column, end: str | None) -> Column:
    return F.lit(False) if end is None else order <= end


def _cut_offs(hashed: DataFrame, counts: dict[str, int], ranks: Sequence[int]) -> list[str | None]:
    """The hash of the row at each rank (None for rank 0)."""
    place: dict[int, tuple[str, int]] = {}
    seen = 0
    for prefix in sorted(counts):
        for rank in ranks:
            if seen < rank <= seen + counts[prefix]:
                place[rank] = (prefix, rank - seen)
        seen += counts[prefix]
    if not place:
        return [None for _ in ranks]
    prefixes = sorted({p for p, _ in place.values()})
    # Equal keys are merged before the window, which then holds 1/65536 of the keys at most.
    within = (
        hashed.withColumn("p", F.substring("h", 1, PREFIX))
        .filter(F.col("p").isin(prefixes))
        .groupBy("p", "h").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(
            Window.partitionBy("p").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    wanted = [F.min(F.when((F.col("p") == p) & (F.col("upto") >= r), F.col("h"))).alias(f"r{rank}")
              for rank, (p, r) in place.items()]
    found = within.agg(*wanted).first()
    return [found[f"r{rank}"] if rank in place else None for rank in ranks]


def split_counts(split: DataFrame) -> DataFrame:
    """``split, n``."""
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
