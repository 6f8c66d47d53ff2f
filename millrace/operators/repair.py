"""Repair missing and malformed values.

The whole repair is one projection: every column becomes an expression over the old row, and the
log of what was done travels in the same row as ``actions``.  Nothing shuffles, and a repaired
table repaired again stays as it is.

Typed columns hold NULL both for "null" and for "absent".  A scalar NULL is filled with the empty
value of its type; a NULL object or list counts as absent and is created only if a template asks
for it.  Dates and other types without an empty value keep their NULLs.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import AUTO_FILLED
from ..functions import text as tx
from ..functions import types as ty
from ..functions.paths import is_object_list, top
from .project import template_structure

_ACTIONS = "array<struct<field:string,action:string>>"
NULL_FILLED = "null filled with empty value"
FIELD_ADDED = "missing template field added"
OBJECT_CREATED = "missing object created"
LIST_CREATED = "missing list created"
ELEMENT_ADDED = "missing list element added"
AUTO = "empty template field auto-filled"
ITEM_FILLED = "null list item filled"
EMPTY_REMOVED = "empty container removed"
TEMPLATE_ACTIONS = (FIELD_ADDED, OBJECT_CREATED, LIST_CREATED, ELEMENT_ADDED, AUTO)


def repair(df: DataFrame, template: str | Mapping | None = None, depth: str = "deep") -> DataFrame:
    """Input columns repaired, template fields added, plus ``actions array<struct<field,action>>``.

    ``shallow`` fills top-level NULLs and adds missing template fields with the template's own
    default.  ``deep`` also works inside objects and lists, fills blank template leaves with a
    marker, pads message lists to the template's length, and removes empty containers that no
    template asks for.
    """
    if depth not in ("deep", "shallow"):
        raise ValueError("depth must be 'deep' or 'shallow'")
    structure = template_structure(template) if template else {}
    columns: list[Column] = []
    logs: list[Column] = []
    for f in df.schema.fields:
        node = structure.get(f.name)
        if depth == "shallow":
            value, log = _fill_null(top(f.name), f.dataType, F.lit(f.name))
        elif node is not None:
            value, log = _conform(top(f.name), f.dataType, node, f.name, F.lit(f.name))
        else:
            value, log = _fill(top(f.name), f.dataType, F.lit(f.name))
        columns.append(value.alias(f.name))
        logs += log
    for name, node in structure.items():
        if name not in df.columns:
            if depth == "shallow":
                value, log = _literal(node), [_entry(F.lit(True), F.lit(name), FIELD_ADDED)]
            else:
                value, log = _conform(F.lit(None), None, node, name, F.lit(name))
            columns.append(value.alias(name))
            logs += log
    return df.select(*columns, _joined(logs).alias("actions"))


def repair_log(repaired: DataFrame, key: str) -> DataFrame:
    """``row_key, field, action``, one row per repair."""
    return repaired.select(top(key).alias("row_key"), F.inline("actions"))


def repaired_count(repaired: DataFrame) -> DataFrame:
    """``record_count, repaired_count, action_count``."""
    return repaired.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count(F.when(F.size("actions") > 0, 1)).alias("repaired_count"),
        F.coalesce(F.sum(F.size("actions")), F.lit(0)).alias("action_count"))


def template_problems(df: DataFrame, template: str | Mapping, key: str) -> DataFrame:
    """``row_key, field, action``: where records do not conform to a template, without repairing."""
    fields = [c for c in df.columns if c in template_structure(template) or c == key]
    return repair_log(repair(df.select(*map(top, fields)), template), key).filter(
        F.col("action").isin(*TEMPLATE_ACTIONS))


def _entry(condition: Column, path: Column, action: str) -> Column:
    one = F.array(F.struct(path.alias("field"), F.lit(action).alias("action"))).cast(_ACTIONS)
    return F.when(condition, one).otherwise(F.array().cast(_ACTIONS))


def _joined(logs: list[Column]) -> Column:
    return F.concat(*logs) if logs else F.array().cast(_ACTIONS)


def _guarded(condition: Column, logs: list[Column]) -> list[Column]:
    return [F.when(condition, _joined(logs)).otherwise(F.array().cast(_ACTIONS))] if logs else []


def _item(path: Column, i: Column) -> Column:
    return F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))


def _fill_null(value: Column, data_type: T.DataType, path: Column, action: str = NULL_FILLED):
    empty = ty.empty_value(data_type)
    if empty is None or isinstance(data_type, T.StructType):
        return value, []
    missing = ty.is_missing(value, data_type)
    return F.when(missing, empty).otherwise(value), [_entry(missing, path, action)]


def _fill(value: Column, data_type: T.DataType, path: Column, keep_empty: bool = False):
    """Null repair at any depth, for parts that no template describes."""
    if isinstance(data_type, T.StructType):
        return _fill_object(value, data_type, path)
    if isinstance(data_type, T.ArrayType):
        return _fill_list(value, data_type, path, keep_empty)
    if isinstance(data_type, T.MapType):
        empty = F.coalesce(F.size(value) == 0, F.lit(False))
        default = ty.empty_value(data_type.valueType)
        filled = value if default is None else F.transform_values(value, lambda _, v: F.coalesce(v, default))
        log = [] if keep_empty else [_entry(empty, path, EMPTY_REMOVED)]
        return (filled if keep_empty else F.when(~empty, filled)), log
    return _fill_null(value, data_type, path)


def _fill_object(value: Column, data_type: T.StructType, path: Column):
    fields, logs = [], []
    for f in data_type.fields:
        child, log = _fill(value.getField(f.name), f.dataType, F.concat(path, F.lit("." + f.name)))
        fields.append(child.alias(f.name))
        logs += log
    return F.when(value.isNotNull(), F.struct(*fields)), _guarded(value.isNotNull(), logs)


def _fill_list(value: Column, data_type: T.ArrayType, path: Column, keep_empty: bool):
    element = data_type.elementType

    def fixed(x: Column, i: Column):
        inner, logs = _fill(x, element, _item(path, i))
        empty = ty.empty_value(element)
        if isinstance(element, (T.StructType, T.ArrayType, T.MapType)) or empty is None:
            return inner, logs
        missing = ty.is_missing(x, element)
        return F.when(missing, empty).otherwise(x), [_entry(missing, _item(path, i), ITEM_FILLED)]

    filled = F.transform(value, lambda x, i: fixed(x, i)[0])
    item_logs = F.flatten(F.transform(value, lambda x, i: _joined(fixed(x, i)[1])))
    logs = [F.coalesce(item_logs, F.array().cast(_ACTIONS))]
    empty = F.coalesce(F.size(value) == 0, F.lit(False)) & value.isNotNull()
    if keep_empty:
        return filled, logs
    return F.when(~empty, filled), logs + [_entry(empty, path, EMPTY_REMOVED)]


def _conform(value: Column, data_type: T.DataType | None, node: object, key: str, path: Column):
    """Bring a value into the shape of its template part."""
    if isinstance(node, Mapping):
        usable = isinstance(data_type, T.StructType)
        missing = value.isNull() if usable else F.lit(True)
        fields, logs = _conform_fields(value if usable else None, data_type if usable else None, node, path)
        return F.struct(*fields), [_entry(missing, path, OBJECT_CREATED)] + logs
    if is_object_list(node):
        return _conform_list(value, data_type, node, path)
    return _conform_leaf(value, data_type, node, key, path)


def _conform_fields(value: Column | None, data_type: T.StructType | None, node: Mapping, path: Column):
    fields, logs = [], []
    known = data_type.fields if data_type is not None else []
    for f in known:
        child_path = F.concat(path, F.lit("." + f.name))
        child = value.getField(f.name)
        part = node.get(f.name)
        new, log = _conform(child, f.dataType, part, f.name, child_path) if f.name in node else _fill(
            child, f.dataType, child_path)
        fields.append(new.alias(f.name))
        logs += log
    for name, part in node.items():
        if name not in [f.name for f in known]:
            new, log = _conform(F.lit(None), None, part, name, F.concat(path, F.lit("." + name)))
            fields.append(new.alias(name))
            logs += log
    return fields, logs


def _conform_list(value: Column, data_type: T.DataType | None, node: list, path: Column):
    merged = {k: v for element in node for k, v in element.items()}
    element_type = conformed_type(
        data_type.elementType if isinstance(data_type, T.ArrayType) else None, merged)
    blank = ty.null_struct(element_type)
    if not (isinstance(data_type, T.ArrayType) and isinstance(data_type.elementType, T.StructType)):
        return F.array(blank), [_entry(F.lit(True), path, LIST_CREATED)]

    source_type = data_type.elementType
    missing = F.greatest(F.lit(len(node)) - F.coalesce(F.size(value), F.lit(0)), F.lit(0))
    padded = F.concat(value, F.array_repeat(ty.null_struct(source_type), missing))

    def element(x: Column, i: Column):
        """Every variant of the element: one per template position, one for the rest."""
        variants = []
        for j, part in enumerate(node):
            fields, logs = _conform_fields(x, source_type, {**_absent(merged, part), **part}, _item(path, i))
            variants.append((i == j, F.struct(*fields), logs))
        rest, logs = _fill(x, source_type, _item(path, i))
        return variants, _widened(rest, source_type, element_type), logs

    def new_value(x: Column, i: Column) -> Column:
        variants, rest, _ = element(x, i)
        chain = F.when(variants[0][0], variants[0][1])
        for condition, struct, _ in variants[1:]:
            chain = chain.when(condition, struct)
        return chain.otherwise(rest)

    def new_log(x: Column, i: Column) -> Column:
        variants, _, rest_logs = element(x, i)
        chain = F.when(variants[0][0], _joined(variants[0][2]))
        for condition, _, logs in variants[1:]:
            chain = chain.when(condition, _joined(logs))
        return chain.otherwise(_joined(rest_logs))

    absent = value.isNull()
    result = F.when(absent, F.array(blank)).otherwise(F.transform(padded, new_value))
    added = F.array_repeat(
        F.struct(path.alias("field"), F.lit(ELEMENT_ADDED).alias("action")), missing).cast(_ACTIONS)
    inner = F.concat(added, F.flatten(F.transform(padded, new_log)))
    return result, [_entry(absent, path, LIST_CREATED),
                    F.when(absent, F.array().cast(_ACTIONS)).otherwise(inner)]


def _absent(merged: Mapping, part: Mapping) -> dict:
    return {k: "" for k in merged if k not in part}


def _widened(value: Column, source: T.StructType, target: T.StructType) -> Column:
    """A list element beyond the template, with the template's fields as NULL."""
    have = source.fieldNames()
    return F.struct(*[
        (ty.as_text(value.getField(f.name), source[f.name].dataType)
         if f.name in have and isinstance(f.dataType, T.StringType)
         else value.getField(f.name) if f.name in have
         else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in target.fields])


def _conform_leaf(value: Column, data_type: T.DataType | None, node: object, key: str, path: Column):
    if isinstance(node, str):
        marker = F.lit(AUTO_FILLED.format(key))
        if data_type is None or isinstance(data_type, T.NullType):
            return marker, [_entry(F.lit(True), path, AUTO)]
        text = ty.as_text(value, data_type)
        empty = ty.is_missing(value, data_type) | F.coalesce(tx.is_blank(text), F.lit(True))
        return F.when(empty, marker).otherwise(text), [_entry(empty, path, AUTO)]
    default = F.lit(0) if isinstance(node, int) else F.array().cast("array<string>") if isinstance(node, list) else F.lit("")
    if data_type is None or isinstance(data_type, T.NullType):
        return default, [_entry(F.lit(True), path, AUTO)]
    own = ty.empty_value(data_type)
    missing = ty.is_missing(value, data_type)
    return F.coalesce(value, own if own is not None else value), [_entry(missing, path, AUTO)]


def conformed_type(data_type: T.DataType | None, node: object) -> T.DataType:
    """Type of a value after it was brought into a template's shape."""
    if isinstance(node, Mapping):
        known = data_type.fields if isinstance(data_type, T.StructType) else []
        fields = [T.StructField(f.name, conformed_type(f.dataType, node[f.name]) if f.name in node else f.dataType)
                  for f in known]
        fields += [T.StructField(k, conformed_type(None, v)) for k, v in node.items()
                   if k not in [f.name for f in known]]
        return T.StructType(fields)
    if is_object_list(node):
        merged = {k: v for element in node for k, v in element.items()}
        inner = data_type.elementType if isinstance(data_type, T.ArrayType) else None
        return T.ArrayType(conformed_type(inner, merged))
    if isinstance(node, str) or data_type is None:
        if isinstance(node, bool) or isinstance(node, int):
            return T.IntegerType()
        return T.ArrayType(T.StringType()) if isinstance(node, list) else T.StringType()
    return data_type


def _literal(node: object) -> Column:
    if isinstance(node, Mapping):
        return F.struct(*[_literal(v).alias(k) for k, v in node.items()])
    if is_object_list(node):
        return F.array(*[_literal(e) for e in node])
    if isinstance(node, list):
        return F.array(*[F.lit(e) for e in node]) if node else F.array().cast("array<string>")
    return F.lit(node)
