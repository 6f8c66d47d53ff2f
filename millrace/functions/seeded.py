"""Repeatable randomness.

Every draw is a hash of (row key, purpose, seed), never of the row's position or partition.
A lost executor therefore recomputes the same values, a re-partitioned input gives the same
output, and any engine with ``md5`` can check the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once


def seed_text(key: Column, purpose: str, seed: int, *more: Column) -> Column:
    """``key:purpose:seed[:more…]``, the text that a draw hashes."""
    return F.concat_ws(":", key.cast("string"), F.lit(purpose), F.lit(str(seed)),
                       *[m.cast("string") for m in more])


def extend(base: Column, *more: Column | str | int) -> Column:
    """A sub-draw of ``base``."""
    parts = [m.cast("string") if isinstance(m, Column) else F.lit(str(m)) for m in more]
    return F.concat_ws(":", base, *parts)


def number(base: Column, hex_digits: int = 8) -> Column:
    """Non-negative integer from the first hex digits (at most 15) of the md5."""
    return F.conv(F.substring(F.md5(base), 1, hex_digits), 16, 10).cast("bigint")


def unit(base: Column) -> Column:
    """Uniform in [0, 1)."""
    return number(base) / F.lit(4294967296.0)


def below(base: Column, n: int | Column) -> Column:
    """Integer in [0, n)."""
    return number(base) % (n if isinstance(n, Column) else F.lit(n))


def pick(values: Column, base: Column) -> Column:
    """One element of a non-empty array."""
    return F.get(values, below(base, F.size(values)).cast("int"))


def digits(base: Column, n: int) -> Column:
    """``n`` decimal digits (n <= 12) as text."""
    return F.lpad((number(base, 15) % F.lit(10 ** n)).cast("string"), n, "0")


def shuffled(values: Column, base: Column) -> Column:
    """The array of texts in seeded order: sorted by the hash of (base, position).

    The hash is put in front of each text, so that one sort of plain strings does it.
    """
    keyed = once(base, lambda b: F.transform(values, lambda v, i: F.concat(item_hash(b, i), v)))
    return F.transform(F.sort_array(keyed), lambda s: F.substr(s, F.lit(33)))


def item_hash(base: Column, i: Column) -> Column:
    """Hash of one item of a list, 32 hex digits."""
    return F.md5(F.concat(base, F.lit(":"), i.cast("string")))


def happens(item: Column, chance: float) -> Column:
    """True with the given chance: the hash, read as a fraction of 2^32, lies below it."""
    limit = math.ceil(chance * 4294967296)
    return F.lit(True) if limit >= 4294967296 else item < F.lit(f"{limit:08x}")
