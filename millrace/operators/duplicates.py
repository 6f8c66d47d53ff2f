"""Exact duplicates, first occurrence kept.

Records are compared by a 256-bit digest of their canonical text.  The group size never matters:
each task first reduces its own rows to one (digest, smallest order key) pair, and rows are
marked by joining on the *order key*, which is unique, not on the digest.  A record that fills a
third of the table therefore costs one row per task, and no window over a group exists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import top

_CANONICAL = {
    "ignoreNullFields": "true",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def record_digest(df: DataFrame, fields: Sequence[str]) -> Column:
    """32-byte digest of the given fields, independent of their order.  NULL equals NULL."""
    if len(fields) == 1 and isinstance(df.schema[fields[0]].dataType, T.StringType):
        return F.unhex(F.sha2(top(fields[0]), 256))
    return F.unhex(F.sha2(F.to_json(F.struct(*[top(f) for f in sorted(fields)]), _CANONICAL), 256))


def duplicate_groups(df: DataFrame, fields: Sequence[str] | None, order_by: str) -> DataFrame:
    """``digest, first_key, n``: one row per distinct record."""
    fields = list(fields) if fields is not None else [c for c in df.columns if c != order_by]
    return df.groupBy(record_digest(df, fields).alias("digest")).agg(
        F.min(top(order_by)).alias("first_key"), F.count(F.lit(1)).alias("n"))


def duplicate_count(df: DataFrame, fields: Sequence[str] | None, order_by: str) -> DataFrame:
    """``record_count, distinct_count, duplicate_count``."""
    return duplicate_groups(df, fields, order_by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("record_count"),
        F.count(F.lit(1)).alias("distinct_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count"))


def _kept(df: DataFrame, fields: Sequence[str] | None, order_by: str) -> DataFrame:
    return duplicate_groups(df, fields, order_by).select(F.col("first_key").alias(order_by))


def mark_duplicates(df: DataFrame, fields: Sequence[str] | None, order_by: str) -> DataFrame:
    """Input plus ``is_duplicate``; ``order_by`` must be a unique, non-null column."""
    kept = _kept(df, fields, order_by).withColumn("_kept", F.lit(True))
    return (
        df.join(kept, order_by, "left")
        .withColumn("is_duplicate", F.col("_kept").isNull())
        .select(*map(top, df.columns), "is_duplicate")
    )


def drop_duplicates(df: DataFrame, fields: Sequence[str] | None, order_by: str) -> DataFrame:
    """First occurrence of every record, in ``order_by`` order."""
    return df.join(_kept(df, fields, order_by), order_by, "left_semi").select(*map(top, df.columns))
