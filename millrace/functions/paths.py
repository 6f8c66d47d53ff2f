"""Dotted field paths (``a.b.1``), resolved against a schema at plan-build time.

A path reads nested structs, maps, arrays (numeric part) and VARIANT values.  Reading tells
"missing" from "present but null": missing gives the default, a present null stays null.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import types as ty


def top(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def resolve(schema: T.StructType, path: str) -> tuple[Column, Column, T.DataType] | None:
    """``(value, is_present, type)`` of a path, or None if no record can have it."""
    parts = path.split(".")
    if parts[0] not in schema.fieldNames():
        return None
    value, data_type = top(parts[0]), schema[parts[0]].dataType
    present = F.lit(True)
    for i, part in enumerate(parts[1:], start=1):
        if isinstance(data_type, T.StructType) and part in data_type.fieldNames():
            present = present & value.isNotNull()
            value, data_type = value.getField(part), data_type[part].dataType
        elif isinstance(data_type, T.ArrayType) and part.isdigit():
            present = present & F.coalesce(F.size(value) > int(part), F.lit(False))
            value, data_type = F.get(value, F.lit(int(part))), data_type.elementType
        elif isinstance(data_type, T.MapType) and isinstance(data_type.keyType, T.StringType):
            present = present & F.coalesce(F.map_contains_key(value, part), F.lit(False))
            value, data_type = value.getItem(part), data_type.valueType
        elif isinstance(data_type, T.VariantType):
            found = F.try_variant_get(value, variant_path(parts[i:]), "variant")
            return found, present & found.isNotNull(), data_type
        else:
            return None
    return value, present, data_type


def record_entries(df: DataFrame, record: str) -> DataFrame:
    """Input plus ``pos, key, value``, one row per top-level key of a VARIANT column."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(top(record).outer()))


def variant_path(parts: list[str]) -> str:
    quoted = [f"[{p}]" if p.isdigit() else "['" + p.replace("'", "\\'") + "']" for p in parts]
    return "$" + "".join(quoted)


def read_text(schema: T.StructType, path: str, default: str = "") -> Column:
    """Text of a path: the default where it is missing, NULL where it is null."""
    found = resolve(schema, path)
    if found is None:
        return F.lit(default)
    value, present, data_type = found
    if isinstance(data_type, T.VariantType):
        text = F.when(~F.is_variant_null(value), F.try_variant_get(value, "$", "string"))
    else:
        text = ty.as_text(value, data_type)
    return text if "." not in path else F.when(present, text).otherwise(F.lit(default))


def leaf_type(schema: T.StructType, path: str | None) -> T.DataType:
    """Type of a path; text where no record can have it."""
    found = resolve(schema, path) if path is not None else None
    return T.StringType() if found is None else found[2]


def as_variant(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.VariantType):
        return value
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_variant_object(value)
    return value.cast("variant")


def read_native(schema: T.StructType, path: str, mixed: bool = False, default: str = "") -> Column:
    """Value of a path with its own type, NULL where it is null, and the default for missing texts.

    With ``mixed`` it is a VARIANT, which holds the default where a value of any type is missing; otherwise
    a missing number, list or object is NULL.
    """
    found = resolve(schema, path)
    if found is None:
        return F.lit(default).cast("variant") if mixed else F.lit(default)
    value, present, data_type = found
    fallback = F.lit(default) if isinstance(data_type, T.StringType) else F.lit(None)
    if mixed or isinstance(data_type, T.VariantType):
        value, fallback = as_variant(value, data_type), F.lit(default).cast("variant")
    return value if "." not in path else F.when(present, value).otherwise(fallback)


def get_path(df: DataFrame, path: str, default: Column | None = None) -> Column:
    """Value of a path with its own type; ``default`` (or NULL) where it is missing."""
    found = resolve(df.schema, path)
    if found is None:
        return default if default is not None else F.lit(None)
    value, present, _ = found
    return F.when(present, value).otherwise(default) if default is not None else F.when(present, value)


def set_path(df: DataFrame, path: str, value: Column) -> DataFrame:
    """Write a nested value, creating objects on the way where they are missing."""
    name, *rest = path.split(".")
    known = name in df.schema.fieldNames()
    old, old_type = (top(name), df.schema[name].dataType) if known else (F.lit(None), None)
    return df.withColumn(name, _written(old, old_type, rest, value))


def _written(old: Column, old_type: T.DataType | None, parts: list[str], value: Column) -> Column:
    if not parts:
        return value
    part, rest = parts[0], parts[1:]
    if isinstance(old_type, T.ArrayType) and part.isdigit():
        return F.transform(old, lambda x, i: F.when(
            i == int(part), _written(x, old_type.elementType, rest, value)).otherwise(x))
    if not isinstance(old_type, T.StructType):
        return F.struct(_written(F.lit(None), None, rest, value).alias(part))
    fields = []
    for f in old_type.fields:
        child = old.getField(f.name)
        fields.append((_written(child, f.dataType, rest, value) if f.name == part else child).alias(f.name))
    if part not in old_type.fieldNames():
        fields.append(_written(F.lit(None), None, rest, value).alias(part))
    return F.struct(*fields)


def nested_paths(schema: T.StructType) -> list[str]:
    """All dotted paths of a schema, sorted; list positions are left out."""
    found: set[str] = set()

    def walk(data_type: T.DataType, path: str) -> None:
        if isinstance(data_type, T.ArrayType):
            walk(data_type.elementType, path)
        elif isinstance(data_type, T.StructType):
            for f in data_type.fields:
                child = f"{path}.{f.name}" if path else f.name
                found.add(child)
                walk(f.dataType, child)

    walk(schema, "")
    return sorted(found)


def template_leaves(structure: Mapping, wildcard: bool = False) -> list[str]:
    """Leaf paths of a template: ``a.b`` and ``messages[0].content`` (or ``messages[*].content``)."""
    leaves: list[str] = []

    def walk(node: Mapping, prefix: str) -> None:
        for key, child in node.items():
            if isinstance(child, Mapping):
                walk(child, f"{prefix}{key}.")
            elif is_object_list(child) and wildcard:
                walk(child[0], f"{prefix}{key}[*].")
            elif is_object_list(child):
                for i, element in enumerate(child):
                    walk(element, f"{prefix}{key}[{i}].")
            else:
                leaves.append(prefix + key)

    walk(structure, "")
    return leaves


def is_object_list(node: object) -> bool:
    return isinstance(node, list) and bool(node) and isinstance(node[0], Mapping)


def suggest_mapping(schema: T.StructType, structure: Mapping) -> dict[str, str]:
    """Input path per template leaf: the full path if the input has it, else its last part."""
    available = set(nested_paths(schema))
    suggestion = {}
    for leaf in template_leaves(structure, wildcard=True):
        last = leaf.rsplit(".", 1)[-1]
        if leaf in available:
            suggestion[leaf] = leaf
        elif last in available:
            suggestion[leaf] = last
    return suggestion
