"""Declarative field rules, compiled to column predicates.

A rule is ``{"field": name or "ALL_FIELDS", "type": …, "value": …}``.  All rules are evaluated in
one projection per row; only violations leave the scan, so the check never shuffles and also
runs on a stream.  A null value violates ``Required`` alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import ALL_FIELDS, RULE_TYPES, TYPE_CHECK_LABELS
from ..functions import text as tx
from ..functions import types as ty
from ..functions.paths import top

_LABEL_OF_CHECK = {"list": "array", "dict": "object"}


def is_empty(value: Column, data_type: T.DataType) -> Column:
    """Missing, or a text without any visible character."""
    missing = ty.is_missing(value, data_type)
    return missing | tx.is_blank(value) if ty.type_label(data_type) == "string" else missing


def _size(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, (T.ArrayType, T.MapType)):
        return F.when(value.isNotNull(), F.size(value))
    return F.length(ty.as_text(value, data_type))


def violates(rule: Mapping, field: str, data_type: T.DataType) -> Column:
    """True where the value of ``field`` breaks the rule; never NULL."""
    kind, wanted, value = rule["type"], rule.get("value"), top(field)
    if kind == "Required":
        broken = is_empty(value, data_type)
    elif kind == "Type Check":
        if wanted not in TYPE_CHECK_LABELS:
            raise ValueError(f"Unknown type in Type Check: {wanted}")
        label = _LABEL_OF_CHECK.get(wanted, wanted)
        if isinstance(data_type, T.VariantType):
            broken = ty.variant_label(value) != label
        else:
            broken = value.isNotNull() & F.lit(ty.type_label(data_type) != label)
    elif kind == "Regex Match":
        broken = ~ty.as_text(value, data_type).rlike(wanted)
    elif kind == "Min Length":
        broken = _size(value, data_type) < int(wanted)
    elif kind == "Max Length":
        broken = _size(value, data_type) > int(wanted)
    elif kind == "Min Value":
        broken = _as_number(value, data_type) < float(wanted)
    elif kind == "Max Value":
        broken = _as_number(value, data_type) > float(wanted)
    elif kind == "Custom Python":
        if callable(wanted):
            broken = value.isNotNull() & ~wanted(value)
        elif str(wanted).strip().startswith("lambda"):
            raise ValueError("give a Python callable or a SQL expression over x, not the text of a lambda")
        else:
            bound = F.expr(f"get(transform(array(`{field}`), x -> ({wanted})), 0)")
            broken = value.isNotNull() & ~bound
    else:
        raise ValueError(f"Unknown rule type: {kind} (known: {', '.join(RULE_TYPES)})")
    return F.coalesce(broken, F.lit(False))


def _as_number(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.VariantType):
        return F.try_variant_get(value, "$", "double")
    if isinstance(data_type, (T.NumericType, T.StringType)):
        return value.try_cast("double")
    return F.lit(None).cast("double")


def expand_rules(df: DataFrame, rules: Sequence[Mapping], skip: Sequence[str] = ()) -> list[tuple[str, Mapping]]:
    """``(field, rule)`` pairs with ``ALL_FIELDS`` spelled out."""
    pairs = []
    for rule in rules:
        names = [c for c in df.columns if c not in skip] if rule["field"] == ALL_FIELDS else [rule["field"]]
        for name in names:
            if name not in df.columns:
                raise ValueError(f"Rule names an unknown field: {name}")
            pairs.append((name, rule))
    return pairs


def violation_structs(df: DataFrame, rules: Sequence[Mapping], skip: Sequence[str] = ()) -> list[Column]:
    """One ``struct<field, rule, value, message>`` per rule and field, NULL where it holds."""
    structs = []
    for field, rule in expand_rules(df, rules, skip):
        data_type = df.schema[field].dataType
        wanted = rule.get("value")
        detail = "" if wanted is None or wanted == "" or callable(wanted) else f" {wanted}"
        structs.append(F.when(violates(rule, field, data_type), F.struct(
            F.lit(field).alias("field"),
            F.lit(rule["type"]).alias("rule"),
            ty.as_text(top(field), data_type).alias("value"),
            F.lit(f"Field '{field}' breaks rule {rule['type']}{detail}").alias("message"))))
    return structs


def violations(df: DataFrame, rules: Sequence[Mapping], key: str) -> DataFrame:
    """``row_key, field, rule, value, message``, one row per broken rule."""
    return explode_findings(df, key, violation_structs(df, rules, skip=[key]))


def explode_findings(df: DataFrame, key: str, findings: Sequence[Column]) -> DataFrame:
    if not findings:
        raise ValueError("No rules given")
    return df.select(top(key).alias("row_key"), F.inline(F.array_compact(F.array(*findings))))


_RULE_SCHEMA = "field string, type string, value string"


def save_rules(spark: SparkSession, rules: Sequence[Mapping], path: str) -> None:
    """Keep a rule list as JSON.  Callables have no text form and are refused."""
    if any(callable(r.get("value")) for r in rules):
        raise ValueError("a Python callable cannot be saved; use a SQL expression over x")
    rows = [(r["field"], r["type"], None if r.get("value") is None else str(r["value"])) for r in rules]
    spark.createDataFrame(rows, _RULE_SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def load_rules(spark: SparkSession, path: str) -> list[dict]:
    """Read a rule list; it is configuration, a handful of rows."""
    return [r.asDict() for r in spark.read.schema(_RULE_SCHEMA).json(path).collect()]
