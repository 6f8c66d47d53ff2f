"""Replace sensitive values by generated ones, row by row and JVM-side."""

from __future__ import annotations

import hashlib
import re
import warnings
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..fixed_values import ANONYMIZED, SENSITIVE_NAME_PATTERNS
from ..functions import seeded
from ..functions import types as ty
from ..functions.paths import top
from ..functions.providers import TYPE_PROVIDERS, Provider, provider

#: Providers whose values are hashes already and stay apart without a suffix.
WIDE_PROVIDERS = ("md5", "sha1", "sha256", "uuid4")


def detect_sensitive(columns: Iterable[str]) -> dict[str, str]:
    """Sensitive type per column name; the first matching pattern wins."""
    found = {}
    for column in columns:
        for kind, shape in SENSITIVE_NAME_PATTERNS.items():
            if re.search(shape, column.lower()):
                found[column] = kind
                break
    return found


def _to_replace(df: DataFrame, field: str, skip_empty: bool) -> Column:
    value, data_type = top(field), df.schema[field].dataType
    filled = value.isNotNull()
    return filled & (value != "") if skip_empty and ty.type_label(data_type) == "string" else filled


def consistent_key(secret: str, name: str) -> str:
    """The key of a provider: a hash of fixed length, so that no secret and name read as another pair."""
    return hashlib.sha256(f"{len(secret)}:{secret}:{name}".encode()).hexdigest()


def _distinct(make: Provider, name: str, secret: str, text: Column) -> Column:
    base = F.sha2(F.concat(F.lit(consistent_key(secret, name)), text), 256)
    value = make(base)
    if TYPE_PROVIDERS.get(name, name) in WIDE_PROVIDERS:
        return value
    tag = F.substring(base, 1, 24)
    return F.when(F.contains(value, F.lit("@")), F.replace(value, F.lit("@"), F.concat(F.lit("."), tag, F.lit("@")))).otherwise(
        F.concat(value, F.lit("-"), tag))


def anonymize(
    df: DataFrame,
    key: str,
    fields: Mapping[str, str] | None = None,
    mode: str = "random",
    seed: int = 42,
    secret: str = "",
    skip_empty: bool = False,
    on_unknown: str = "keep",
    observation: Observation | None = None,
) -> DataFrame:
    """Same columns with the values of ``fields`` (``{column: provider}``) replaced.

    Replaced columns become text; NULLs stay NULL.  Without ``fields``, sensitive columns are
    detected by name, the key included.  ``mode="random"`` draws every cell on its own, from the row's unique
    ``key``; ``mode="consistent"`` gives equal values equal replacements and different values
    different ones, from a non-empty ``secret`` and the value, so that joins survive: most providers
    have few values, so 96 bits of a keyed hash are appended, before the ``@`` of an address.  An unknown provider keeps the column with a warning, or writes
    a constant (``on_unknown="constant"``).  ``observation`` counts the replaced values.
    """
    if mode not in ("random", "consistent") or on_unknown not in ("keep", "constant"):
        raise ValueError("mode is 'random' or 'consistent', on_unknown is 'keep' or 'constant'")
    if mode == "consistent" and not secret:
        raise ValueError("consistent replacements need a secret")
    fields = dict(fields) if fields else detect_sensitive(df.columns)
    if not fields:
        warnings.warn("No fields to anonymize.", stacklevel=2)
        return df
    replaced: dict[str, Column] = {}
    for field, name in fields.items():
        if field not in df.columns:
            continue
        make = provider(name)
        if make is None and on_unknown == "keep":
            warnings.warn(f"No provider for '{name}'. Skipping field '{field}'.", stacklevel=2)
            continue
        text = ty.as_text(top(field), df.schema[field].dataType)
        if make is None:
            new = F.lit(ANONYMIZED.format(field))
        elif mode == "random":
            new = make(seeded.seed_text(top(key), field, seed))
        else:
            new = _distinct(make, name, secret, text)
        replaced[field] = F.when(_to_replace(df, field, skip_empty), new).otherwise(text)
    out = df
    if observation is not None and replaced:
        touched = sum((_to_replace(df, f, skip_empty).cast("bigint") for f in replaced), F.lit(0))
        out = out.observe(observation, F.sum(touched).alias("anonymized"))
    return out.select(*[replaced.get(c, top(c)).alias(c) for c in df.columns])


def sensitive_report(df: DataFrame, fields: Mapping[str, str] | None = None, skip_empty: bool = False) -> DataFrame:
    """``field, type, n``: how many values of each sensitive column would be replaced."""
    fields = dict(fields) if fields else detect_sensitive(df.columns)
    if not fields:
        return df.sparkSession.createDataFrame([], "field string, type string, n bigint")
    row = df.agg(*[F.count(F.when(_to_replace(df, f, skip_empty), 1)).alias(f"n{i}") for i, f in enumerate(fields)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), F.lit(t).alias("type"), F.col(f"n{i}").alias("n"))
        for i, (f, t) in enumerate(fields.items())])))
