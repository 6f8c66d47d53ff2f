"""Edit a dataset: search, delete, patch, append, set in bulk, number rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..fixed_values import TEMPLATES
from ..functions import types as ty
from ..functions.paths import top
from ..session import written


def search(df: DataFrame, query: str) -> DataFrame:
    """Rows where any cell contains the text, ignoring case."""
    needle = query.lower()
    hit = F.lit(False)
    for f in df.schema.fields:
        cell = F.lower(ty.as_text(top(f.name), f.dataType))
        hit = hit | F.coalesce(cell.contains(needle), F.lit(False))
    return df.filter(hit)


def delete_records(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``keys``."""
    return df.join(keys.select(key), key, "left_anti")


def patch_cells(df: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Apply cell edits ``(key, field, value[, edit_no])``; the latest edit of a cell wins.

    Edits are first folded to one row per key, with a partial result per task; a patch to NULL
    is an edit like any other.
    """
    order = F.col("edit_no") if "edit_no" in patches.columns else F.lit(0)
    fields = [f for f in df.schema.fields if f.name != key]
    folded = patches.groupBy(key).agg(*[
        F.max(F.when(F.col("field") == f.name, F.struct(order.alias("o"), F.col("value").alias("v")))).alias(f"_p{i}")
        for i, f in enumerate(fields)])
    joined = df.join(folded, key, "left")
    new = {f.name: F.when(F.col(f"_p{i}").isNotNull(), F.col(f"_p{i}")["v"].cast(f.dataType)).otherwise(top(f.name))
           for i, f in enumerate(fields)}
    return joined.select(*[new.get(c, top(c)).alias(c) for c in df.columns])


def append_record(df: DataFrame | None, record: Mapping[str, object], spark: SparkSession | None = None) -> DataFrame:
    """Add one record.  Fields it leaves out are empty text, or NULL in columns that hold no text.

    Without a dataset, the record starts one with the ``instruction`` template's fields.
    """
    if df is None:
        if spark is None:
            raise ValueError("an empty dataset needs a session")
        values = {**TEMPLATES["instruction"], **record}
        return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    unknown = set(record) - set(df.columns)
    if unknown:
        raise ValueError(f"Unknown fields: {sorted(unknown)}")
    cells = []
    for f in df.schema.fields:
        blank = F.lit("") if ty.type_label(f.dataType) == "string" else F.lit(None)
        cell = F.lit(record[f.name]) if f.name in record else blank
        cells.append(cell.cast(f.dataType).alias(f.name))
    return df.unionByName(df.sparkSession.range(1).select(*cells))


def bulk_edit(df: DataFrame, where: Column, values: Mapping[str, Column]) -> DataFrame:
    """Set columns on every row that meets a condition."""
    return df.select(*[
        (F.when(where, values[c]).otherwise(top(c)) if c in values else top(c)).alias(c) for c in df.columns])


def row_numbers(df: DataFrame, order_by: str) -> DataFrame:
    """``order_by, row_number``: 1-based position of every row, for messages to people.

    Keys are range-partitioned and written once, with their partition and their position in it;
    the offsets are one small number per partition.  No task sees more than its own range, and
    the numbers survive a lost executor because the ranges are on disk.
    """
    ranged = (
        df.select(top(order_by))
        .repartitionByRange(top(order_by))
        .sortWithinPartitions(top(order_by))
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    )
    placed = written(ranged)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("_part", (
        F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    ).alias("_before"))
    # One row per partition of the range exchange, so the side is bounded by the number of tasks.
    return placed.join(F.broadcast(offsets), "_part").select(
        top(order_by), (F.col("_before") + F.col("_pos")).alias("row_number"))
