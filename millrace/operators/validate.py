"""Whole-dataset checks and the combined validation report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..fixed_values import MESSAGE_DUPLICATE, MESSAGE_EMPTY, MESSAGE_FIELD_SET
from ..functions import text as tx
from ..functions import types as ty
from ..functions.paths import record_entries, top
from .duplicates import mark_duplicates
from .project import record_keys
from .repair import template_problems
from .rules import explode_findings, is_empty, violation_structs

CHECKS = ("missing", "types", "duplicates", "template", "rules")


def field_drift(df: DataFrame, record: str, order_by: str) -> DataFrame:
    """``row_key, fields``: records whose key set differs from that of the first record.

    The first record's keys are a scalar subquery, so no join takes place.
    """
    keyed = df.select(top(order_by).alias("row_key"), record_keys(top(record)).alias("fields"))
    first = keyed.agg(F.min_by("fields", "row_key")).scalar()
    return keyed.filter(~F.col("fields").eqNullSafe(first))


def not_objects(df: DataFrame, record: str, key: str) -> DataFrame:
    """``row_key, type``: records of a VARIANT column that are not JSON objects."""
    label = ty.variant_label(top(record))
    return df.select(top(key).alias("row_key"), label.alias("type")).filter(
        ~F.col("type").eqNullSafe("object"))


def validate_records(df: DataFrame, record: str, order_by: str) -> DataFrame:
    """``row_key, message``: duplicates and field-set drift of a VARIANT column of records.

    Key order inside a record does not matter.  An empty input gives one row that says so.
    """
    canonical = df.select(top(order_by).alias("row_key"), F.to_json(top(record)).alias("_text"))
    duplicates = mark_duplicates(canonical, ["_text"], "row_key").filter("is_duplicate").select(
        "row_key", F.lit(MESSAGE_DUPLICATE).alias("message"))
    drift = field_drift(df, record, order_by).select("row_key", F.lit(MESSAGE_FIELD_SET).alias("message"))
    empty = df.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
        F.lit(None).cast(df.schema[order_by].dataType).alias("row_key"), F.lit(MESSAGE_EMPTY).alias("message"))
    return duplicates.unionByName(drift).unionByName(empty)


def _field_types(df: DataFrame, record: str, key: str) -> DataFrame:
    entries = record_entries(df.select(top(key).alias("row_key"), top(record)), record)
    return entries.select(
        "row_key", F.col("key").alias("field"), ty.variant_label(F.col("value")).alias("type"),
        F.to_json("value").alias("value")).filter(F.col("type").isNotNull())


def type_counts(df: DataFrame, record: str, key: str) -> DataFrame:
    """``field, type, n, types``: how often each type occurs per field, and how many types it has."""
    counted = _field_types(df, record, key).groupBy("field", "type").agg(F.count(F.lit(1)).alias("n"))
    # At most one row per field and type is left here.
    return counted.withColumn("types", F.count(F.lit(1)).over(Window.partitionBy("field")))


def type_conflicts(df: DataFrame, record: str, key: str) -> DataFrame:
    """``row_key, field, type, value``: values whose type is not the most common one of their field."""
    usual = type_counts(df, record, key).filter("types > 1").groupBy("field").agg(
        F.max_by("type", F.struct("n", "type")).alias("usual"))
    # One row per field with mixed types; the shuffle's own statistics decide how it is joined.
    return (
        _field_types(df, record, key).join(usual, "field")
        .filter(F.col("type") != F.col("usual"))
        .select("row_key", "field", "type", "value"))


def validation_report(
    df: DataFrame,
    key: str,
    checks: Sequence[str] = ("missing", "duplicates", "rules"),
    rules: Sequence[Mapping] = (),
    template: str | Mapping | None = None,
    record: str | None = None,
) -> DataFrame:
    """``row_key, field, rule, value, message``: every finding of the chosen checks.

    Missing values and rules share one pass.  ``types`` needs a VARIANT column ``record``;
    ``template`` needs a template.
    """
    unknown = set(checks) - set(CHECKS)
    if unknown:
        raise ValueError(f"Unknown checks: {sorted(unknown)}")
    branches: list[DataFrame] = []
    typed = df.drop(record) if record else df
    per_row = []
    if "missing" in checks:
        per_row += [F.when(is_empty(top(f.name), f.dataType), F.struct(
            F.lit(f.name).alias("field"), F.lit("missing").alias("rule"),
            ty.as_text(top(f.name), f.dataType).alias("value"),
            F.lit(f"Field '{f.name}' has no value").alias("message")))
            for f in typed.schema.fields if f.name != key]
    if "rules" in checks and rules:
        per_row += violation_structs(typed, rules, skip=[key])
    if per_row:
        branches.append(explode_findings(typed, key, per_row))
    if "missing" in checks and record:
        label, text = ty.variant_label(F.col("value")), F.try_variant_get("value", "$", "string")
        entries = record_entries(df.select(top(key).alias("row_key"), top(record)), record)
        branches.append(entries.filter(
            F.col("key").isNotNull() & (F.is_variant_null("value") | ((label == "string") & tx.is_blank(text)))).select(
            "row_key", F.col("key").alias("field"), F.lit("missing").alias("rule"),
            F.when(~F.is_variant_null("value"), text).alias("value"),
            F.concat(F.lit("Field '"), "key", F.lit("' has no value")).alias("message")))
    if "duplicates" in checks:
        # A record is compared whole, by its canonical text.
        whole = df.select(*[F.to_json(top(c)).alias(c) if c == record else top(c) for c in df.columns])
        fields = [c for c in whole.columns if c != key]
        branches.append(mark_duplicates(whole, fields, key).filter("is_duplicate").select(
            top(key).alias("row_key"), F.lit(None).cast("string").alias("field"),
            F.lit("duplicate").alias("rule"), F.lit(None).cast("string").alias("value"),
            F.lit(MESSAGE_DUPLICATE).alias("message")))
    if "types" in checks:
        if record is None:
            raise ValueError("the types check needs a VARIANT column of records")
        branches.append(type_conflicts(df, record, key).select(
            "row_key", "field", F.lit("type").alias("rule"), "value",
            F.concat(F.lit("Unusual type "), "type").alias("message")))
    if "template" in checks:
        if template is None:
            raise ValueError("the template check needs a template")
        branches.append(template_problems(typed, template, key).select(
            "row_key", "field", F.lit("template").alias("rule"),
            F.lit(None).cast("string").alias("value"), F.col("action").alias("message")))
    if not branches:
        raise ValueError("No checks chosen")
    report = branches[0]
    for branch in branches[1:]:
        report = report.unionByName(branch)
    return report


def summarize(report: DataFrame) -> DataFrame:
    """``field, rule, n`` of a validation report."""
    return report.groupBy("field", "rule").agg(F.count(F.lit(1)).alias("n"))
