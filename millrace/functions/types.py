"""Type labels of the JSON data model, and empty values per Spark type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


LABELS = ("string", "number", "boolean", "array", "object", "unknown")


def type_label(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.ArrayType):
        return "array"
    if isinstance(data_type, (T.StructType, T.MapType)):
        return "object"
    return "unknown"


def variant_label(value: Column) -> Column:
    """Type label of a VARIANT value; NULL for a JSON null or an absent value."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | F.is_variant_null(value), F.lit(None).cast("string"))
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), "number")
        .otherwise("unknown")
    )


def is_missing(value: Column, data_type: T.DataType) -> Column:
    """NULL, or NaN for floating point columns."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return value.isNull() | F.isnan(value)
    if isinstance(data_type, T.VariantType):
        return value.isNull() | F.is_variant_null(value)
    return value.isNull()


def as_text(value: Column, data_type: T.DataType) -> Column:
    """Scalars as their text, containers as JSON."""
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return value
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(value, None if isinstance(data_type, T.VariantType) else {"ignoreNullFields": "false"})
    return value.cast("string")


def empty_value(data_type: T.DataType) -> Column | None:
    """The empty value of a type, or None where a type has none (dates, binary, …)."""
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return F.lit("")
    if isinstance(data_type, T.NumericType):
        return F.lit(0).cast(data_type)
    if isinstance(data_type, T.BooleanType):
        return F.lit(False)
    if isinstance(data_type, T.ArrayType):
        return F.array().cast(data_type)
    if isinstance(data_type, T.MapType):
        return F.create_map().cast(data_type)
    if isinstance(data_type, T.StructType):
        return null_struct(data_type)
    return None


def null_struct(data_type: T.StructType) -> Column:
    """A present object whose fields are all absent."""
    if not data_type.fields:
        return F.struct()
    return F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in data_type.fields])
