"""Masking by rules of one's own: ordered, without overlaps, all in one pass over a text.

A text is scanned once for all rules.  At each place the first rule that fits wins, what it takes is gone
for the others, and what it writes is never looked at again, unlike in a chain of replacements.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import pieces
from ..functions.paths import top


#: What a mask writes for each class of characters.
FORMAT = ((r"\p{Nd}", "#"), (r"\p{Lu}", "X"), (r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]", "x"))


@dataclass(frozen=True)
class MaskRule:
    """``pattern`` and what replaces it: a text in which ``\\1`` to ``\\9`` are its groups, or a mask.

    A mask (``replacement=None``) keeps the format: digits become ``#``, upper-case letters ``X``, lower-case
    ones ``x``, and all but the last ``keep_last`` characters are masked.
    """

    pattern: str
    replacement: str | None = None
    keep_last: int = 0


def _new(match: Column, rule: MaskRule) -> Column:
    if rule.replacement is not None:
        parts = re.split(r"\\([1-9])", rule.replacement)
        groups = [F.lit(p) if i % 2 == 0 else F.regexp_extract(match, f"^(?:{rule.pattern})$", int(p)) for i, p in enumerate(parts)]
        return F.concat(*groups)
    size = F.greatest(F.length(match) - rule.keep_last, F.lit(0))
    hidden = F.substr(match, F.lit(1), size)
    for shape, sign in FORMAT:
        hidden = F.regexp_replace(hidden, shape, sign)
    return F.concat(hidden, F.substr(match, size + 1))


def masked(text: Column, rules: Sequence[MaskRule]) -> Column:
    """The text with every match of any rule replaced; NULL stays."""
    if not rules:
        return text
    for rule in rules:
        if re.search(rule.pattern, ""):
            raise ValueError(f"the pattern {rule.pattern!r} matches nothing at all, everywhere")
    any_rule = "|".join(f"(?:{r.pattern})" for r in rules)

    def replaced(match: Column) -> Column:
        new = F
        for rule in rules:
            new = new.when(match.rlike(f"^(?:{rule.pattern})$"), _new(match, rule))
        return new.otherwise(match)

    parts = F.transform(pieces(text, any_rule), lambda p: F.concat(p["gap"], F.when(p["match"].isNull(), "").otherwise(replaced(p["match"]))))
    return F.when(text.rlike(any_rule), F.array_join(parts, "")).otherwise(text)


def mask_fields(df: DataFrame, fields: Sequence[str], rules: Sequence[MaskRule]) -> DataFrame:
    """Same rows, the texts of ``fields`` masked."""
    return df.select(*[masked(top(c), rules).alias(c) if c in fields else top(c) for c in df.columns])
