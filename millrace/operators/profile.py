"""Field statistics.

Everything that one aggregate can hold is one aggregate over one scan, with a partial result
per task.  Value counts unpivot first, so that all fields share one scan and one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import types as ty
from ..functions.paths import record_entries, top
from ..session import written


def string_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if ty.type_label(f.dataType) == "string"]


def numeric_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _one_row_per_field(row: DataFrame, structs: list[Column]) -> DataFrame:
    return row.select(F.inline(F.array(*structs)))


def profile(df: DataFrame) -> DataFrame:
    """``field, record_count, present, missing, type, mean_length``, one row per column.

    ``type`` is NULL when a field holds no value at all; an empty input gives no rows.
    ``mean_length`` counts a NULL text as length 0 and is NULL for other types.
    """
    aggregates = [F.count(F.lit(1)).alias("n")]
    structs = []
    for i, f in enumerate(df.schema.fields):
        value = top(f.name)
        aggregates.append(F.count(F.when(ty.is_missing(value, f.dataType), 1)).alias(f"m{i}"))
        if ty.type_label(f.dataType) == "string":
            aggregates.append(F.sum(F.coalesce(F.length(value), F.lit(0))).alias(f"l{i}"))
            mean = F.col(f"l{i}") / F.col("n")
        else:
            mean = F.lit(None).cast("double")
        missing = F.col(f"m{i}")
        structs.append(F.struct(
            F.lit(f.name).alias("field"),
            F.col("n").alias("record_count"),
            (F.col("n") - missing).alias("present"),
            missing.alias("missing"),
            F.when(missing < F.col("n"), F.lit(ty.type_label(f.dataType))).alias("type"),
            mean.alias("mean_length")))
    return _one_row_per_field(df.agg(*aggregates), structs).filter("record_count > 0")


def profile_records(df: DataFrame, record: str, order_by: str, absent_is_missing: bool = True) -> DataFrame:
    """Profile of records whose keys may differ: a VARIANT column of objects.

    ``field, record_count, present, missing, type``.  ``present`` counts records that carry the
    key, ``missing`` those without a value for it (or, with ``absent_is_missing=False``, only
    explicit nulls), ``type`` is that of the first value in ``order_by`` order.
    """
    entries = record_entries(df.select(top(order_by).alias("_ord"), top(record)), record)
    # As a number, the type fits a hash aggregate; as text it would need a sort of all entries.
    labels = F.array(*[F.lit(label) for label in ty.LABELS])
    entries = entries.select(
        F.col("key").alias("field"), "_ord", F.array_position(labels, ty.variant_label(F.col("value"))).alias("code"))
    per_field = entries.groupBy("field").agg(
        F.count(F.lit(1)).alias("present"),
        F.count("code").alias("filled"),
        F.min_by("code", F.when(F.col("code").isNotNull(), F.col("_ord"))).alias("code"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    of = total if absent_is_missing else F.col("present")
    return per_field.select(
        "field", total.alias("record_count"), "present",
        (of - F.col("filled")).alias("missing"), F.get(labels, (F.col("code") - 1).cast("int")).alias("type"))


def null_counts(df: DataFrame) -> DataFrame:
    """``field, missing`` for the fields that miss any value."""
    return profile(df).filter("missing > 0").select("field", "missing")


def mean_lengths(df: DataFrame) -> DataFrame:
    """``field, mean_length`` of the string fields, longest first."""
    fields = string_fields(df)
    return (
        profile(df.select(*map(top, fields)))
        .select("field", "mean_length")
        .orderBy(F.desc("mean_length"), "field")
    )


def _long(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    as_text = [ty.as_text(top(f), df.schema[f].dataType).alias(f) for f in fields]
    return df.select(*as_text).unpivot([], list(fields), "field", "value")


def _ranked(counted: DataFrame, k: int) -> DataFrame:
    """The limit is applied before the last shuffle (``WindowGroupLimit``), so a field with many
    distinct values never travels to one task."""
    by_rank = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    return counted.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= k)


def top_values(
    df: DataFrame, fields: Sequence[str] | None = None, k: int = 5, long_texts: Sequence[str] = ()
) -> DataFrame:
    """``field, value, n, rank``: the most common values per field, NULLs left out, ties by value.

    Fields named in ``long_texts`` are counted by digest, so that texts do not travel; only the
    texts of the winners are fetched, in a second pass.
    """
    fields = list(fields) if fields is not None else string_fields(df)
    short = [f for f in fields if f not in long_texts]
    parts = []
    if short:
        values = _long(df, short).filter(F.col("value").isNotNull())
        parts.append(_ranked(values.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")), k))
    if long_texts:
        parts.append(_top_texts(df, [f for f in fields if f in long_texts], k))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _top_texts(df: DataFrame, fields: Sequence[str], k: int) -> DataFrame:
    texts = _long(df, fields).filter(F.col("value").isNotNull())
    texts = texts.withColumn("digest", F.unhex(F.sha2("value", 256)))
    counted = written(texts.groupBy("field", "digest", F.substring("value", 1, 32).alias("start")).agg(
        F.count(F.lit(1)).alias("n")))
    # A start cannot order texts that share it: all ties at the limit stay in, but in the tasks they are in.
    order = F.struct((-F.col("n")).alias("less"), "start")
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "start"))
    last = counted.withColumn("place", place).filter(F.col("place") <= k).groupBy("field").agg(F.max(order).alias("last"))
    # One short row per field.
    winners = written(counted.join(F.broadcast(last), "field").filter(order <= F.col("last")).select("field", "digest", "n"))
    # The size of the written table decides how it is joined.
    found = texts.join(winners, ["field", "digest"]).select("field", "value", "n").distinct()
    return _ranked(found, k)


def value_counts(df: DataFrame, field: str, k: int = 10) -> DataFrame:
    """``value, n``: the ``k`` most common values of one field."""
    return (
        df.select(top(field).alias("value"))
        .filter(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
        .limit(k)
    )


def histogram(df: DataFrame, field: str, bins: int = 10) -> DataFrame:
    """``bin, low, high, n``: equal-width counts between minimum and maximum, NULLs dropped.

    The last bin includes the maximum; empty bins are left out.
    """
    values = df.select(top(field).cast("double").alias("x"))
    values = values.filter(F.col("x").isNotNull() & ~F.isnan("x"))
    ends = values.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    values = values.withColumn("ends", ends)
    lo, hi = F.col("ends.lo"), F.col("ends.hi")
    place = F.when(hi == lo, F.lit(0)).otherwise(F.floor((F.col("x") - lo) / ((hi - lo) / F.lit(bins))))
    counted = values.groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min(lo).alias("lo"), F.max(hi).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    return counted.select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def field_distribution(df: DataFrame, field: str) -> DataFrame:
    """Value counts for a text field, a histogram for a numeric one."""
    label = ty.type_label(df.schema[field].dataType)
    if label == "string":
        return value_counts(df, field)
    if label == "number":
        return histogram(df, field)
    raise ValueError(f"No distribution for '{field}': unsupported type {df.schema[field].dataType.simpleString()}")


def missing_patterns(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """``missing_fields, n``: which fields are missing together, as a comma-separated list."""
    fields = list(fields) if fields is not None else df.columns
    flags = [F.when(ty.is_missing(top(f), df.schema[f].dataType), F.lit(f)) for f in fields]
    return df.groupBy(F.concat_ws(",", *flags).alias("missing_fields")).agg(F.count(F.lit(1)).alias("n"))


def _narrow(value: Column, data_type: T.DataType) -> list[Column]:
    """What tells values of one field apart: the value itself, or 128 bits of hashes where it may be long."""
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType, T.BinaryType)):
        return [F.xxhash64(value).alias("a"), F.xxhash64(F.lit("second"), value).alias("b")]
    return [value.alias("a")]


def unique_counts(df: DataFrame, fields: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """``field, unique_count`` over non-null values.

    Exact by default: each field is a small aggregate of its own, which reads that column alone, makes
    values distinct in the tasks, and shuffles them, or 128-bit hashes of texts.  No row is multiplied by
    the number of fields.  A source without columns (CSV, JSON) is read once for each field and better written
    as Parquet first.  ``approximate=True`` keeps a sketch per field in one scan instead.
    """
    fields = list(fields) if fields is not None else df.columns
    value, kind = {}, {}
    for f in fields:
        data_type = df.schema[f].dataType
        contained = ty.type_label(data_type) in ("array", "object", "unknown")
        value[f] = ty.as_text(top(f), data_type) if contained else top(f)
        kind[f] = T.StringType() if contained else data_type
    if approximate:
        row = df.agg(*[F.approx_count_distinct(value[f]).alias(f"u{i}") for i, f in enumerate(fields)])
        return _one_row_per_field(row, [
            F.struct(F.lit(f).alias("field"), F.col(f"u{i}").alias("unique_count")) for i, f in enumerate(fields)])
    counted = []
    for f in fields:
        narrow = df.filter(value[f].isNotNull()).select(*_narrow(value[f], kind[f]))
        distinct = narrow.groupBy(*narrow.columns).agg(F.lit(1).alias("one"))
        counted.append(distinct.agg(F.lit(f).alias("field"), F.count(F.lit(1)).alias("unique_count")))
    return reduce(DataFrame.unionByName, counted)


def correlations(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """``field_a, field_b, correlation`` for every pair of numeric fields, in one aggregate."""
    fields = list(fields) if fields is not None else numeric_fields(df)
    pairs = list(combinations(fields, 2))
    row = df.agg(*[F.corr(top(a).cast("double"), top(b).cast("double")).alias(f"c{i}")
                   for i, (a, b) in enumerate(pairs)])
    return _one_row_per_field(row, [
        F.struct(F.lit(a).alias("field_a"), F.lit(b).alias("field_b"), F.col(f"c{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)])
