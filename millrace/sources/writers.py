"""Write a DataFrame in any supported format.

Every sink writes at least one file per task into a folder; nothing is gathered.  JSON arrays and YAML, which are
read file by file, come as files of a bounded size, however much a task holds.
"""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import EXTENSIONS
from ..functions import types as ty
from ..functions.paths import top
from .readers import gated, infer_format, read, table_url

_JSON = {"ignoreNullFields": "false"}
#: Characters of records after which a JSON array or a YAML list ends and the next file begins.
DOCUMENT_CHARS = 8 * 1024 * 1024


def write(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists", check_empty: bool = False) -> None:
    """Write ``df``; ``mode`` is ``overwrite``, ``append`` or ``errorifexists``.

    ``check_empty=True`` refuses an empty dataset, at the price of a look at the first row.
    """
    if check_empty and df.isEmpty():
        raise ValueError("No data to save.")
    if fmt == "json":
        json_arrays(df).write.mode(mode).option("maxRecordsPerFile", 1).text(path)
    elif fmt == "jsonl":
        df.write.mode(mode).options(**_JSON).json(path)
    elif fmt in ("csv", "tsv"):
        flat = df.select(*[_flat(f) for f in df.schema.fields])
        flat.write.mode(mode).csv(path, header=True, sep="\t" if fmt == "tsv" else ",", escape='"')
    elif fmt == "txt":
        df.select(F.to_json(F.struct("*"), _JSON).alias("value")).write.mode(mode).text(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt == "xml":
        wrapped = df.select(*[_xml_items(top(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
        (wrapped.write.mode(mode).format("xml").option("rootTag", "dataset").option("rowTag", "record")
         .option("attributePrefix", "@").option("valueTag", "#text").save(path))
    elif fmt == "yaml":
        yaml_lists(df).write.mode(mode).option("maxRecordsPerFile", 1).text(path)
    elif fmt == "avro":
        gated(lambda: df.write.mode(mode).format("avro").save(path), "Avro", "the spark-avro package")
    elif fmt == "sqlite":
        flat = df.select(*[_flat(f) for f in df.schema.fields])
        gated(lambda: flat.write.mode(mode).format("jdbc").option("url", table_url(path)).option("dbtable", "data").save(),
              "SQL tables", "a JDBC driver")
    else:
        raise ValueError(f"Unsupported output format: {fmt}")


def convert(
    spark: SparkSession, source: str, target: str, source_format: str | None = None,
    target_format: str | None = None, mode: str = "errorifexists", **read_options,
) -> None:
    """Read in one format, write in another."""
    write(read(spark, source, source_format, **read_options), target, target_format or infer_format(target), mode)


def write_auto(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write in the format of the extension; JSON Lines if the extension says nothing."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    if extension not in EXTENSIONS:
        warnings.warn(f"Unknown extension '{extension}', writing JSON Lines.", stacklevel=2)
    write(df, path, EXTENSIONS.get(extension, "jsonl"), mode)


def write_splits(split: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write the parts of a split dataset to ``path/split=<name>``, in any format that ``write`` knows.

    Formats that Spark partitions itself take one job; of the others, whose files are documents with a start and
    an end, and of tables each part is a job of its own.  Rows without a split are in no part.
    """
    named = split.filter(top("split").isNotNull())
    if fmt in ("parquet", "jsonl", "csv", "tsv"):
        rows = named if fmt in ("parquet", "jsonl") else named.select(*[_flat(f) for f in named.schema.fields])
        writer = rows.write.mode(mode).partitionBy("split")
        if fmt == "parquet":
            writer.parquet(path)
        elif fmt == "jsonl":
            writer.options(**_JSON).json(path)
        else:
            writer.csv(path, header=True, sep="\t" if fmt == "tsv" else ",", escape='"')
        return
    for name in sorted(r["split"] for r in named.select("split").distinct().collect()):  # a handful of names
        write(named.filter(top("split") == name).drop("split"), f"{path.rstrip('/')}/split={name}", fmt, mode)


def json_arrays(df: DataFrame) -> DataFrame:
    """``value``: whole JSON arrays, one record per line."""
    return _documents(df, lambda record: record, lambda records: "[\n" + ",\n".join(records) + "\n]")


def yaml_lists(df: DataFrame) -> DataFrame:
    """``value``: whole YAML lists, every record an item."""

    def item(record: str) -> str:
        import yaml

        dumper = getattr(yaml, "CSafeDumper", yaml.SafeDumper)
        return yaml.dump([json.loads(record)], Dumper=dumper, default_flow_style=False, allow_unicode=True).rstrip("\n")

    return _documents(df, item, "\n".join)


def _documents(df: DataFrame, item: Callable[[str], str], joined: Callable[[list[str]], str]) -> DataFrame:
    """``value``: documents of about ``DOCUMENT_CHARS``, each to be a file; one record at least, none without records."""
    most = DOCUMENT_CHARS

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, chars = [], 0
        for batch in batches:
            for record in batch.column(0):  # One at a time: only the batch and a document are held.
                items.append(item(record.as_py()))
                chars += len(items[-1])
                if chars >= most:
                    yield pa.RecordBatch.from_pydict({"value": [joined(items)]})
                    items, chars = [], 0
        if items:
            yield pa.RecordBatch.from_pydict({"value": [joined(items)]})

    return df.select(F.to_json(F.struct("*"), _JSON).alias("value")).mapInArrow(collect, "value string")


def _flat(field: T.StructField) -> Column:
    """Containers as JSON text; flat formats hold scalars only."""
    if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return ty.as_text(top(field.name), field.dataType).alias(field.name)
    return top(field.name)


def _xml_items(value: Column, data_type: T.DataType) -> Column:
    """Lists as repeated ``<item>`` elements, at any depth."""
    if isinstance(data_type, T.ArrayType):
        items = F.transform(value, lambda x: _xml_items(x, data_type.elementType))
        return F.when(value.isNotNull(), F.struct(items.alias("item")))
    if isinstance(data_type, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[
            _xml_items(value.getField(f.name), f.dataType).alias(f.name) for f in data_type.fields]))
    return value
