"""What the tokenizer operators share: byte tables, and texts in units that tokens do not cross."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

#: Distinct units in the newer half of what a Python worker remembers; at this many it becomes the older half.
CACHE_UNITS = 300_000
#: Longer units are worked out each time and not remembered.
CACHED_CHARS = 48
#: Characters of joined units that a tokenizer gets at once.
PORTION = 1 << 14
#: Before a blank or a line break that follows no white space.
CUT = re.compile(r"(?<=\S)(?=[ \n])")


@cache
def byte_signs() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte.

    Bytes that are printable in Latin-1 stand for themselves; the others follow, in order, from U+0100.
    """
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


@cache
def sign_bytes() -> dict[str, int]:
    return {sign: b for b, sign in byte_signs().items()}


#: White space before a blank or a line break.
SPACED = re.compile(r"\s[ \n]")
SPACED_ASCII = [chr(c) + end for c in (*range(9, 14), *range(28, 33)) for end in " \n"]


def units(text: str) -> list[str]:
    """The text cut before each blank or line break that follows a visible character.

    Byte-level tokens start with white space at most, and so do pieces with word marks, none of which
    holds a line break; no token crosses such a place, so units are tokenized alone and a unit seen before is looked up.
    """
    if "\0" in text or any(w in text for w in SPACED_ASCII) or not text.isascii() and SPACED.search(text):
        return CUT.split(text)
    parts = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    return parts if parts[0] else parts[1:]


class Remembered:
    """What units came to, in two halves: the older one is forgotten when the newer is full, but for units seen meanwhile."""

    def __init__(self) -> None:
        self.newer, self.older = {}, {}

    def missing(self, wanted: set[str]) -> set[str]:
        """Units that are in neither half; the others are in the newer one from now on."""
        if len(self.newer) > CACHE_UNITS:
            self.newer, self.older = {}, self.newer
        new = wanted.difference(self.newer)
        again = [u for u in new if u in self.older]
        self.newer.update(zip(again, map(self.older.__getitem__, again)))
        return new.difference(again)


def portions(new: Iterable[str]) -> Iterator[list[str]]:
    """Units in lists that may be joined, as each one's end and the next one's start are a cut again."""
    part, chars = [], 0
    for u in new:
        if u[:1] not in (" ", "\n") or u[-1:].isspace():
            yield [u]
            continue
        part.append(u)
        chars += len(u)
        if chars >= PORTION:
            yield part
            part, chars = [], 0
    if part:
        yield part


def char_of_byte(raw: bytes) -> np.ndarray:
    """For each byte the number of the character that it belongs to."""
    return np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
