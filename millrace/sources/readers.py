"""Read a dataset in any supported format into a DataFrame.

All readers are Spark sources.  Line-oriented and columnar formats split inside files; JSON
arrays, XML with line breaks, YAML and CSV with quoted line breaks are read file by file, so at
scale they should come as many files.  A missing input fails when the frame is built.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import CSV_MISSING, EXTENSIONS, XML_WRAPPERS
from ..functions import text as tx
from ..functions.paths import top

FORMATS = ("json", "jsonl", "csv", "tsv", "txt", "parquet", "xml", "yaml", "avro", "sqlite")


def infer_format(path: str) -> str:
    """Format from the file extension."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    if extension not in EXTENSIONS:
        raise ValueError(f"Unsupported file format: {extension}")
    return EXTENSIONS[extension]


def read(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    table: str | None = None,
    schema: T.StructType | str | None = None,
    row_tag: str | None = None,
    multi_line: bool = True,
    mode: str = "FAILFAST",
    observation: Observation | None = None,
    by_name: bool = False,
) -> DataFrame:
    """Read ``path``; the format comes from the extension unless given.

    ``by_name`` matches the columns of CSV and TSV files with different headers, which fail otherwise;
    it takes a pass over the lines, and a header must be one line.
    ``schema`` saves the inference pass.  ``row_tag`` names the repeated XML element; without it,
    the children of the root are looked up first, which takes a pass of its own.
    ``multi_line=False`` lets CSV and TSV files split, if no quoted value holds a line break.
    ``mode`` is what to do with malformed records (``FAILFAST`` or ``PERMISSIVE``).
    ``observation`` counts loaded records on the way of the first action.
    """
    fmt = fmt or infer_format(path)
    if fmt in ("csv", "tsv"):
        df = _read_delimited(spark, path, "\t" if fmt == "tsv" else ",", schema, multi_line, mode, by_name)
    elif fmt == "json":
        if mode == "FAILFAST":
            _check_json_files(spark, path)
        df = _unwrap(spark, path, _with(spark, schema, mode).option("multiLine", True).json(path))
    elif fmt == "jsonl":
        df = _read_json_lines(spark, path, schema, mode)
    elif fmt == "txt":
        df = spark.read.text(path).select(tx.strip(F.col("value")).alias("text")).filter(F.col("text") != "")
    elif fmt == "parquet":
        reader = spark.read.schema(schema) if schema is not None else spark.read
        df = reader.parquet(path)
    elif fmt == "xml":
        df = _read_xml(spark, path, [row_tag] if row_tag else xml_row_tags(spark, path), schema, mode)
    elif fmt == "yaml":
        texts = read_yaml_records(spark, path)
        df = _typed_json(texts, "record", schema, mode)
    elif fmt == "avro":
        df = gated(lambda: spark.read.format("avro").load(path), "Avro", "the spark-avro package")
    elif fmt == "sqlite":
        df = _read_table(spark, path, table)
    else:
        raise ValueError(f"Unsupported input format: {fmt}")
    return df.observe(observation, F.count(F.lit(1)).alias("records")) if observation is not None else df


def read_records(spark: SparkSession, path: str, fmt: str | None = None, column: str = "record") -> DataFrame:
    """Read JSON, JSON Lines or YAML records whose keys may differ: one VARIANT column."""
    fmt = fmt or infer_format(path)
    if fmt == "jsonl":
        return _json_lines(spark, path).select(F.parse_json("value").alias(column))
    if fmt == "yaml":
        return read_yaml_records(spark, path).select(F.parse_json("record").alias(column))
    if fmt == "json":
        whole = spark.read.text(path, wholetext=True).select(_checked(F.col("value")).alias("value"))
        return whole.select(F.explode(_record_variants(F.col("value"))).alias(column))
    raise ValueError(f"Not a record format: {fmt}")


def _record_variants(text: Column) -> Column:
    """The records of a JSON file: its array's items, those of its ``data``, or the value itself.

    Each is a VARIANT of its own; the whole file may exceed the size that Spark allows for one.
    """
    strict = {"mode": "FAILFAST"}
    listed = F.ltrim(text, F.lit(" \t\r\n\ufeff")).startswith("[")
    inside = F.from_json(text, "data array<variant>")["data"].isNotNull()
    return F.when(listed, F.from_json(text, "array<variant>", strict)).when(
        inside, F.from_json(text, "data array<variant>", strict)["data"]).otherwise(F.array(F.parse_json(text)))


def read_texts(spark: SparkSession, path: str, types: Sequence[str] = (), recurse: bool = True) -> DataFrame:
    """``path, size, text``: one row per file of a folder tree, for the text scans.

    ``types`` are file extensions to keep; the filter works on file names, before any file is read.
    """
    reader = spark.read.option("recursiveFileLookup", recurse)
    if types:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(t.lstrip(".") for t in types) + "}")
    return reader.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))


def list_tables(spark: SparkSession, url: str) -> list[str]:
    """Table names of a SQL database file."""
    query = "SELECT name FROM sqlite_master WHERE type = 'table'"
    frame = gated(lambda: spark.read.format("jdbc").option("url", table_url(url)).option("query", query).load(),
                   "SQL tables", "a JDBC driver")
    return [r["name"] for r in frame.collect()]


def _with(spark: SparkSession, schema, mode: str):
    reader = spark.read.option("mode", mode)
    return reader.schema(schema) if schema is not None else reader


def _read_xml(spark: SparkSession, path: str, tags: Sequence[str], schema, mode: str) -> DataFrame:
    frames = [_with(spark, schema, mode).option("rowTag", tag).option("attributePrefix", "@")
              .option("valueTag", "#text").format("xml").load(path) for tag in tags]
    if not frames:
        return spark.createDataFrame([], schema or T.StructType([]))
    df = frames[0]
    for other in frames[1:]:
        df = df.unionByName(other, allowMissingColumns=True)
    return df


def xml_row_tags(spark: SparkSession, path: str) -> list[str]:
    """Names of the elements that are records: the root's children, or a childless root itself
    unless its name says that it is only a wrapper."""

    def tags_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.parsers import expat

        for batch in batches:
            found = set()
            for document in batch["value"]:
                depth, names = 0, ({}, {})

                def start(name, _):
                    nonlocal depth
                    if depth < 2:
                        names[depth][name] = True
                    depth += 1

                def end(_):
                    nonlocal depth
                    depth -= 1

                parser = expat.ParserCreate()
                parser.StartElementHandler, parser.EndElementHandler = start, end
                parser.Parse(document, True)
                found |= set(names[1] or {n for n in names[0] if n not in XML_WRAPPERS})
            yield pd.DataFrame({"tag": sorted(found)}, dtype="object")

    tags = spark.read.text(path, wholetext=True).mapInPandas(tags_of, "tag string").distinct()
    return sorted(r["tag"] for r in tags.collect())


def _checked(text: Column) -> Column:
    return F.when(tx.is_json(text), text).otherwise(F.raise_error(F.concat(F.lit("Malformed JSON: "), F.left(text, F.lit(200)))))


def _json_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the lines that are not blank; a malformed one fails the read."""
    texts = spark.read.text(path).filter(~tx.is_blank(F.col("value")))
    return texts.select(_checked(F.col("value")).alias("value"))


def _read_json_lines(spark: SparkSession, path: str, schema, mode: str) -> DataFrame:
    """Typed JSON Lines.  Spark's own reader overlooks what follows a record on its line, so
    ``FAILFAST`` checks every line first; ``PERMISSIVE`` takes the reader as it is."""
    native = _with(spark, schema, mode).json(path)
    if mode != "FAILFAST":
        return native
    record = F.from_json("value", native.schema, {"mode": mode})
    return _json_lines(spark, path).select(record.alias("r")).select("r.*")


def _check_json_files(spark: SparkSession, path: str) -> None:
    """Fail on a file that is not one JSON value, such as JSON Lines under a wrong name."""
    files = spark.read.text(path, wholetext=True).select(
        tx.is_json(F.col("value")).alias("ok"), F.col("_metadata.file_path").alias("file"))
    bad = files.filter("NOT ok").select("file").first()
    if bad is not None:
        raise ValueError(f"Malformed JSON file: {bad['file']}")


def _unwrap(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """Records of ``{"data": [...]}``; a file that holds an array of records is left as it is.

    What a file's first character opens decides, not the schema: a record may have a ``data`` field
    of its own.  A folder may hold files of both kinds.
    """
    if "data" not in df.columns:
        return df
    kind = df.schema["data"].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
        return df
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract("value", r"^[\s\uFEFF]*(.)", 1).alias("opens"), F.col("_metadata.file_path").alias("_file"))
    opened = {r["opens"] for r in files.select("opens").distinct().collect()}
    if "{" not in opened:
        return df
    wrapped = files.filter("opens = '{'").select("_file")
    named = df.select("*", F.col("_metadata.file_path").alias("_file"))
    inside = named.join(wrapped, "_file", "left_semi").filter("data IS NOT NULL").select(F.inline("data"))
    whole = named.join(wrapped, "_file", "left_anti").drop("_file") if opened - {"{", ""} else None
    plain = named.join(wrapped, "_file", "left_semi").filter("data IS NULL").drop("_file", "data")
    if whole is None and plain.isEmpty():
        return inside
    out = inside.unionByName(plain, allowMissingColumns=True)
    return out if whole is None else out.unionByName(whole, allowMissingColumns=True)


def _typed_json(texts: DataFrame, column: str, schema, mode: str) -> DataFrame:
    if schema is None:
        rows = texts.select(column).rdd.map(lambda row: row[0])
        schema = texts.sparkSession.read.option("mode", mode).json(rows).schema
    return texts.select(F.from_json(column, schema, {"mode": mode}).alias("r")).select("r.*")


def read_yaml_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: each YAML record as JSON text.  Every file is parsed by the task that reads it."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        for batch in batches:
            for document in batch.column(0):  # One file at a time is held as objects.
                loaded = yaml.load(document.as_py(), Loader=loader)
                if isinstance(loaded, dict):
                    inner = loaded.get("data")
                    loaded = inner if isinstance(inner, list) else [loaded]
                records = loaded if isinstance(loaded, list) else []
                texts = [json.dumps(r, ensure_ascii=False, default=str) for r in records]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["record"])

    return spark.read.text(path, wholetext=True).mapInArrow(parse, "record string")


def _header_groups(spark: SparkSession, path: str) -> list[list[str]]:
    """The files of a folder, those with the same first line together."""
    lines = spark.read.text(path).filter("_metadata.file_block_start = 0").select(
        F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at"))
    heads = lines.groupBy("file").agg(F.min_by("value", "at").alias("head"))
    grouped = heads.groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("files").collect()
    return [[unquote(f) for f in g["files"]] for g in grouped]


def _read_cells(spark: SparkSession, paths: str | list[str], separator: str, multi_line: bool, mode: str) -> DataFrame:
    options = {"header": True, "sep": separator, "multiLine": multi_line, "escape": '"', "enforceSchema": False}
    names = spark.read.options(**options).csv(paths).columns
    fields = ", ".join(f"`{n}` string" for n in names)
    raw = spark.read.options(**options, columnNameOfCorruptRecord="_row").schema(fields + ", `_row` string").csv(paths)
    if mode == "FAILFAST":
        longer = F.from_csv("_row", fields + ", `_surplus` string", {"sep": separator, "escape": '"'})
        check = F.when(longer.getField("_surplus").isNotNull(), F.raise_error(F.concat(F.lit("Row with surplus cells: "), "_row")))
        raw = raw.withColumn(names[0], F.coalesce(check.cast("string"), top(names[0])))
    return raw.select(*[missing_to_null(top(c)).alias(c) for c in names])


def _read_delimited(
    spark: SparkSession, path: str, separator: str, schema, multi_line: bool, mode: str, by_name: bool = False
) -> DataFrame:
    """Delimited text with a header; the usual spellings of a missing value become NULL.

    Short rows end in NULLs.  Rows with surplus cells fail the read, unless ``mode`` is
    ``PERMISSIVE``, which drops those cells.  Files whose headers differ fail the read, unless
    ``by_name`` matches their columns by name; columns that a file lacks are NULL.  Without a schema,
    one aggregate over the text columns finds the narrowest type that holds every value of a column.
    """
    if by_name:
        # One frame for each header that occurs, not for each file.
        frames = [_read_cells(spark, files, separator, multi_line, mode) for files in _header_groups(spark, path)]
        raw = frames[0] if frames else _read_cells(spark, path, separator, multi_line, mode)
        for frame in frames[1:]:
            raw = raw.unionByName(frame, allowMissingColumns=True)
    else:
        raw = _read_cells(spark, path, separator, multi_line, mode)
    if schema is not None:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return raw.select(*[top(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields])
    tests = {
        "bigint": lambda c: ~c.rlike(r"^\s*[+-]?\d+\s*$") | c.try_cast("bigint").isNull(),
        # Long runs of digits are identifiers, which a double would round.
        "double": lambda c: c.try_cast("double").isNull() | c.rlike(r"(?i)[\d.][df]\s*$|^\s*[+-]?\d{17,}\s*$"),
        "boolean": lambda c: ~c.isin("True", "TRUE", "true", "False", "FALSE", "false"),
    }
    misfits = raw.agg(
        *[F.count(top(c)).alias(f"n{i}") for i, c in enumerate(raw.columns)],
        *[F.count(F.when(top(c).isNotNull() & test(top(c)), 1)).alias(f"{name}{i}")
          for i, c in enumerate(raw.columns) for name, test in tests.items()]).first()
    columns = []
    for i, c in enumerate(raw.columns):
        fitting = [name for name in tests if misfits[f"{name}{i}"] == 0]
        columns.append((top(c).cast(fitting[0]) if misfits[f"n{i}"] and fitting else top(c)).alias(c))
    return raw.select(*columns)


def missing_to_null(cell: Column) -> Column:
    """NULL for the usual spellings of a missing value."""
    return F.when(~cell.isin(*CSV_MISSING), cell)


def _read_table(spark: SparkSession, path: str, table: str | None) -> DataFrame:
    names = list_tables(spark, path)
    if not names:
        raise ValueError("No tables found in the database")
    if table is not None and table not in names:
        raise ValueError(f"Table '{table}' not found in the database")
    return spark.read.format("jdbc").option("url", table_url(path)).option("dbtable", f'"{table or names[0]}"').load()


def table_url(path: str) -> str:
    return path if path.startswith("jdbc:") else f"jdbc:sqlite:{path}"


def gated(load, what: str, needs: str):
    try:
        return load()
    except (AnalysisException, PySparkException) as error:
        raise RuntimeError(f"{what} need {needs} on the cluster's class path: {error}") from error
    except Exception as error:  # the driver manager reports a missing driver as a Java error
        if "No suitable driver" in str(error):
            raise RuntimeError(f"{what} need {needs} on the cluster's class path") from error
        raise
