"""Generate records for a template from seeded providers."""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seeded
from ..functions.paths import is_object_list, template_leaves, top
from ..functions.providers import provider
from .project import template_structure


def generate_for(
    ids: DataFrame,
    key: str,
    template: str | Mapping,
    providers: Mapping[str, str] | None = None,
    auto: bool = True,
    seed: int = 42,
) -> DataFrame:
    """One record per row of ``ids``: ``row_id`` and the template's columns.

    A leaf takes its provider from ``providers`` (``messages[*].content`` for every position);
    others keep the template's own text or, if that is empty, a filler sentence.  ``auto=False``
    leaves them empty.  Narrow: every task generates its own rows.
    """
    structure = template_structure(template)
    if not structure:
        raise ValueError("the template has no fields")
    providers = dict(providers or {})
    known = set(template_leaves(structure)) | set(template_leaves(structure, wildcard=True))
    for leaf in set(providers) - known:
        raise ValueError(f"no such template leaf: {leaf}")

    def value(path: str, literal: object) -> Column:
        name = providers.get(path, providers.get(re.sub(r"\[\d+\]", "[*]", path)))
        if name is None and literal != "":
            return F.lit(str(literal))
        if name is None and not auto:
            return F.lit("")
        make = provider(name or "sentence")
        if make is None:
            warnings.warn(f"No provider for '{name}'; '{path}' stays empty.", stacklevel=3)
            return F.lit("")
        return make(seeded.seed_text(top(key), path, seed))

    def build(node: Mapping, prefix: str) -> list[Column]:
        out = []
        for name, child in node.items():
            path = prefix + name
            if isinstance(child, Mapping):
                column = F.struct(*build(child, path + "."))
            elif is_object_list(child):
                column = F.array(*[F.struct(*build(e, f"{path}[{i}].")) for i, e in enumerate(child)])
            else:
                column = value(path, child)
            out.append(column.alias(name))
        return out

    return ids.select(top(key).alias("row_id"), *build(structure, ""))


def generate(
    spark: SparkSession,
    template: str | Mapping,
    n: int,
    seed: int = 42,
    providers: Mapping[str, str] | None = None,
    auto: bool = True,
) -> DataFrame:
    """``n`` records, numbered from 1."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return generate_for(spark.range(1, n + 1), "id", template, providers, auto, seed)
