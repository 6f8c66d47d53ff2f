"""Project records into an output template with one ``select``."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import TEMPLATES
from ..functions import paths


def template_structure(template: str | Mapping) -> Mapping:
    """Structure of a catalogue template, or the caller's own nested literal."""
    if isinstance(template, Mapping):
        return template
    if template not in TEMPLATES:
        raise ValueError(f"Unknown template: {template}")
    return TEMPLATES[template]


def template_schema(template: str | Mapping) -> T.StructType:
    """Spark schema of a template; every leaf is a string."""

    def walk(node: Mapping) -> T.StructType:
        fields = []
        for key, child in node.items():
            if isinstance(child, Mapping):
                data_type: T.DataType = walk(child)
            elif paths.is_object_list(child):
                data_type = T.ArrayType(walk(child[0]))
            else:
                data_type = T.StringType()
            fields.append(T.StructField(key, data_type))
        return T.StructType(fields)

    return walk(template_structure(template))


def _leaf_paths(node: Mapping, prefix: str = "") -> list[str]:
    """Every leaf of a template, list positions included."""
    found = []
    for key, child in node.items():
        path = prefix + key
        if isinstance(child, Mapping):
            found += _leaf_paths(child, path + ".")
        elif paths.is_object_list(child):
            found += [p for i, e in enumerate(child) for p in _leaf_paths(e, f"{path}[{i}].")]
        else:
            found.append(path)
    return found


def map_to_template(
    df: DataFrame,
    template: str | Mapping,
    mapping: Mapping[str, str],
    literals: str = "blank",
    keep: Sequence[str] = (),
    types: str = "text",
) -> DataFrame:
    """Fill a template from dotted input paths.

    ``mapping`` is ``{template path: input path}``; list positions are written
    ``messages[0].content``, and ``messages[*].content`` stands for every position.  A leaf that
    is not mapped, or whose input is missing, becomes ``""``; ``literals="keep"`` leaves the
    template's own text (such as a role) in unmapped leaves.  ``keep`` columns come first.
    ``types="native"`` lets mapped leaves keep their type, numbers, booleans, lists and objects; leaves that
    differ in type between the positions of a list become VARIANT.  Missing texts are then ``""`` and other
    missing values NULL; ``types="variant"`` makes every mapped leaf a VARIANT and every missing one ``""``.
    The result is a narrow projection: no shuffle, only mapped columns are read, and it works on
    streams as well.
    """
    if not template or not mapping:
        raise ValueError("Template and field mapping must be set before processing")
    if literals not in ("blank", "keep"):
        raise ValueError("literals must be 'blank' or 'keep'")
    if types not in ("text", "native", "variant"):
        raise ValueError("types must be 'text', 'native' or 'variant'")
    structure = template_structure(template)
    anywhere = lambda path: re.sub(r"\[\d+\]", "[*]", path)
    source_of = lambda path: mapping.get(path, mapping.get(anywhere(path)))
    #: Types that a leaf has at the positions of a list.
    seen: dict[str, set[str]] = {}
    for path in _leaf_paths(structure):
        seen.setdefault(anywhere(path), set()).add(paths.leaf_type(df.schema, source_of(path)).simpleString())

    def leaf(path: str, literal: object) -> Column:
        source, mixed = source_of(path), types == "variant" or types == "native" and len(seen[anywhere(path)]) > 1
        if source is not None:
            return paths.read_text(df.schema, source) if types == "text" else paths.read_native(df.schema, source, mixed)
        text = F.lit(str(literal) if literals == "keep" and literal is not None else "")
        in_list_of_variants = mixed and (types == "native" or any(source_of(p) for p in _leaf_paths(structure) if anywhere(p) == anywhere(path)))
        return text.cast("variant") if in_list_of_variants else text

    def build(node: Mapping, prefix: str) -> list[Column]:
        columns = []
        for key, child in node.items():
            path = prefix + key
            if isinstance(child, Mapping):
                column = F.struct(*build(child, path + "."))
            elif paths.is_object_list(child):
                column = F.array(*[F.struct(*build(e, f"{path}[{i}].")) for i, e in enumerate(child)])
            else:
                column = leaf(path, child)
            columns.append(column.alias(key))
        return columns

    return df.select(*[paths.top(c) for c in keep], *build(structure, ""))


def available_fields(df: DataFrame) -> list[str]:
    """Top-level field names, sorted."""
    return sorted(df.columns)


def available_keys(df: DataFrame, record: str) -> DataFrame:
    """Distinct top-level keys over all records of a VARIANT column: ``field``."""
    return df.select(F.explode(record_keys(paths.top(record))).alias("field")).distinct()


def record_keys(record: Column) -> Column:
    """Sorted top-level keys of a VARIANT object; NULL for anything else."""
    return F.sort_array(F.json_object_keys(F.to_json(record)))


def preview(df: DataFrame, n: int = 100, order_by: Sequence[str] = ()) -> DataFrame:
    """First rows as text, with ``""`` for NULL."""
    ordered = df.orderBy(*order_by) if order_by else df
    return ordered.limit(n).select(
        *[F.coalesce(paths.ty.as_text(paths.top(f.name), f.dataType), F.lit("")).alias(f.name)
          for f in df.schema.fields])
