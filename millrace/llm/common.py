"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, shuffles_removed, written

__all__ = ["blank", "plain", "rows_at_once", "scratch", "shuffles_removed", "single_threaded", "table", "unused", "written"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names the operator works with.

    Further columns of the input, whatever they are called, cannot clash with working columns.
    """
    return df.select(*[df[f"`{source}`"].alias(name) for name, source in columns.items()])


def unused(name: str, columns: list[str]) -> str:
    """A name for a working column that no column of the input has, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def blank(column: Column) -> Column:
    """The text, or "" where it is null."""
    return F.coalesce(column, F.lit(""))


def rows_at_once(spark: SparkSession, rows: int = 256) -> None:
    """Set how many rows go to Python at once: texts may be long, so far fewer than Spark's 10,000."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def single_threaded() -> None:
    """One task, one thread: Spark already runs a task on every core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
