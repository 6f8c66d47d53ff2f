"""Structured Streaming counterparts of read, write and convert.

Template mapping, rules, repair, anonymization and text scans are column expressions, so the same
functions apply to a stream of newly arriving files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx
from ..functions.paths import top
from ..sources.readers import missing_to_null

_STREAM_FORMATS = {"jsonl": "json", "csv": "csv", "tsv": "csv", "txt": "text", "parquet": "parquet"}


def read_stream(
    spark: SparkSession, path: str, fmt: str, schema: T.StructType | str | None = None, files_per_batch: int = 1000
) -> DataFrame:
    """Files of a folder as they arrive.  All formats but ``txt`` need a schema."""
    if fmt not in _STREAM_FORMATS:
        raise ValueError(f"Unsupported streaming format: {fmt}")
    reader = spark.readStream.format(_STREAM_FORMATS[fmt]).option("maxFilesPerTrigger", files_per_batch)
    if fmt == "txt":
        lines = reader.load(path)
        return lines.select(tx.strip(F.col("value")).alias("text")).filter(F.col("text") != "")
    if schema is None:
        raise ValueError("a stream needs a schema")
    if fmt in ("csv", "tsv"):
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        cells = T.StructType([T.StructField(f.name, T.StringType()) for f in wanted.fields])
        reader = reader.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").option("escape", '"')
        # A file whose header differs from the schema fails instead of being misread.
        return reader.option("multiLine", True).option("enforceSchema", False).schema(cells).load(path).select(
            *[missing_to_null(top(f.name)).cast(f.dataType).alias(f.name) for f in wanted.fields])
    return reader.schema(schema).load(path)


def write_stream(df: DataFrame, path: str, fmt: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to a folder; ``once`` works off what is there and stops."""
    if fmt not in ("jsonl", "parquet"):
        raise ValueError(f"Unsupported streaming sink: {fmt}")
    writer = df.writeStream.format(_STREAM_FORMATS[fmt]).option("checkpointLocation", checkpoint)
    if fmt == "jsonl":
        writer = writer.option("ignoreNullFields", False)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.outputMode("append").start(path)


def convert_stream(
    spark: SparkSession, source: str, source_format: str, target: str, target_format: str, checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df, schema: T.StructType | str | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Convert the files that arrived since the last run."""
    return write_stream(
        transform(read_stream(spark, source, source_format, schema)), target, target_format, checkpoint, once)


def drop_repeated(df: DataFrame, fields: list[str], event_time: str, within: str) -> DataFrame:
    """First occurrence of a record within a span of event time; state is dropped with the watermark.

    A watermark needs an instant, so an event time without a zone is taken in the session's.
    """
    if isinstance(df.schema[event_time].dataType, T.TimestampNTZType):
        df = df.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return df.withWatermark(event_time, within).dropDuplicatesWithinWatermark(fields)
