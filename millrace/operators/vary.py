"""Noise and new sentence orders: variations of a text in one narrow step each.

Both are positional: what happens to a character or a sentence depends on a hash of (row key, field,
place), so results repeat on any partitioning and rates hold on any length.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seeded
from ..functions import text as tx
from ..functions.paths import top

#: What may befall a character.
EDITS = ("drop", "swap", "double")
#: Characters whose draws come from one hash, two of its bytes each.
PER_HASH = 8
#: Words whose full stop ends no sentence, in lower case.
ABBREVIATIONS = (
    "approx", "art", "bzw", "ca", "cf", "co", "corp", "dept", "dr", "e.g", "ed", "eg", "est", "etc", "fig", "hr", "i.e", "ie", "inc", "jr", "ltd",
    "m.e", "mme", "mr", "mrs", "ms", "no", "nr", "p", "p.ej", "pp", "prof", "sr", "sra", "st", "str", "u.a", "usw", "vgl", "vol", "vs", "z.b")
#: Marks that stand for a boundary while a text is taken apart; texts that hold one are left alone.
KEEP, END, NEXT = "\ue000", "\ue001", "\ue002"
#: White space, spelled out so that all engines agree.
BLANK = r" \t\n\r\f"
#: A full stop after an abbreviation, an initial or initials, or a number of one or two digits.
NO_END = (r"(?i)((?:^|[^\p{L}\p{N}.])(?:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
          + r"|(?:\p{L}\.){0,5}\p{L}|[0-9]{1,2}))\.")
#: The end of a sentence, white space, and what can begin another: no lower-case letter.
BOUNDARY = rf"([.!?…][.!?…\"'”’)\]]*)([{BLANK}]+)([^{BLANK}\p{{Ll}}])"


def noisy(text: Column, base: Column, rate: float) -> Column:
    """The text with a share ``rate`` of its characters dropped, doubled or swapped with the next one.

    A swap needs a next character; of swaps in a row the first one counts, and the character that is
    swapped to the front is spared its own edit.
    """
    if not 0 <= rate <= 1:
        raise ValueError("rate must be between 0 and 1")
    # Defined inside, so that it travels with the plan: workers need not have this package.
    limit = min(round(rate * 65536), 65535)

    def edited(text: str, base: str) -> str:
        """The text with the edits of those places whose draw is below ``limit``; other places cost no step of their own."""
        n, start = len(text), base.encode() + b":"
        hashes = b"".join([md5(start + b"%d" % k, usedforsecurity=False).digest() for k in range((n + PER_HASH - 1) // PER_HASH)])
        draws = np.frombuffer(hashes, ">u2")[:n]
        places = np.flatnonzero(draws < limit)
        kinds = dict(zip(places.tolist(), (draws[places] % len(EDITS)).tolist()))
        drop, swap, double = range(len(EDITS))
        out, done = [], 0
        for i, kind in kinds.items():  # in ascending order
            swaps = kind == swap and kinds.get(i - 1) != swap and i + 1 < n
            if i < done or kind == swap and not swaps:
                continue
            out.append(text[done:i])
            done = i + 1
            if swaps:
                out.append(text[i + 1] + text[i])
                done = i + 2
            elif kind == double:
                out.append(text[i] * 2)
        out.append(text[done:])
        return "".join(out)

    @F.pandas_udf("string")
    def changed(texts: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([edited(t, b) if t else t for t, b in zip(texts, bases)], dtype="object")

    return changed(text, base)


def sentence_pieces(text: Column) -> Column:
    """Sentences and the gaps between them, in turn: ``[sentence, gap, sentence, …]``.

    Full stops of abbreviations, initials and numbers end no sentence, nor does one before a lower-case letter.
    """
    marked = F.regexp_replace(F.regexp_replace(text, NO_END, f"$1.{KEEP}"), BOUNDARY, f"$1{END}$2{NEXT}$3")
    cut = F.split(F.replace(marked, F.lit(KEEP), F.lit("")), f"[{END}{NEXT}]", -1)
    return F.when(text.rlike(f"[{KEEP}{END}{NEXT}]"), F.array(text)).otherwise(cut)


def reordered(text: Column, base: Column) -> Column:
    """The sentences in seeded order; the gaps stay where they are."""
    def joined(pieces: Column) -> Column:
        odd = lambda rest: F.filter(pieces, lambda p, i: i % 2 == rest)
        return tx.once(seeded.shuffled(odd(0), base), lambda s: F.array_join(
            F.zip_with(s, odd(1), lambda a, gap: F.concat(a, F.coalesce(gap, F.lit("")))), ""))

    return tx.once(sentence_pieces(text), lambda p: F.when(F.size(p) > 1, joined(p)).otherwise(text))


def _varied(df: DataFrame, fields: Sequence[str], key: str, purpose: str, seed: int, change) -> DataFrame:
    new = {f: change(top(f), seeded.seed_text(top(key), purpose, seed, F.lit(f))) for f in fields}
    return df.select(*[new[c].alias(c) if c in new else top(c) for c in df.columns])


def add_noise(df: DataFrame, fields: Sequence[str], key: str, rate: float = 0.02, seed: int = 42) -> DataFrame:
    """Same rows with noise in the texts of ``fields``; ``key`` is unique, NULLs and empty texts stay."""
    return _varied(df, fields, key, "noise", seed, lambda text, base: noisy(text, base, rate))


def reorder_sentences(df: DataFrame, fields: Sequence[str], key: str, seed: int = 42) -> DataFrame:
    """Same rows with the sentences of ``fields`` in another order; NULLs and single sentences stay."""
    return _varied(df, fields, key, "sentences", seed, reordered)
