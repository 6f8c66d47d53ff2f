"""Text expressions.

White space is spelled out as one explicit class, so that Spark's regex engine, other SQL
engines and Python's ``str.split`` agree on every character, Unicode spaces included.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
#: White space that does not end a line.
INLINE_WS = WS.replace(r"\t-\r", r"\t\x0b\x0c", 1)
#: The same characters one by one.
BLANKS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
TOKEN = f"[^{WS}]+"
STRIP = f"^[{WS}]+|[{WS}]+$"
#: Words and single punctuation marks.
WORD_OR_MARK = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{WS}]"

ASCII_WORD_OR_MARK = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\t-\r\x1c-\x20]"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """Bind a value to a lambda variable, so that many uses evaluate it once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def is_blank(text: Column) -> Column:
    """True for an empty or all-white-space text; NULL for NULL."""
    return ~text.rlike(f"[^{WS}]")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value; NULL for NULL.

    Spark's JSON functions stop after the first value and ignore what follows.  So the text is
    put in front of a seal that it cannot contain: only if it ends where its value ends is the
    seal seen as the next field.
    """
    seal = F.md5(text)
    keys = F.json_object_keys(F.concat(F.lit('{"value":'), text, F.lit(',"'), seal, F.lit('":0}')))
    return F.when(text.isNotNull(), F.coalesce((F.size(keys) == 2) & F.array_contains(keys, seal), F.lit(False)))


def tokens(text: Column) -> Column:
    """White-space separated words.  A cut at one plain character is much cheaper than a pattern."""
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def word_tokens(text: Column) -> Column:
    """Words and punctuation marks as separate tokens.  Plain ASCII text, the common case, takes a smaller pattern."""
    return _all(text, ASCII_WORD_OR_MARK, WORD_OR_MARK)


def _all(text: Column, ascii_pattern: str, pattern: str) -> Column:
    return F.when(is_ascii(text), F.regexp_extract_all(text, F.lit(f"({ascii_pattern})"), F.lit(1))).otherwise(
        F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))


def lines(text: Column) -> Column:
    """Lines of a text; a final line break does not open another line."""
    cut = F.when(text.endswith("\r\n"), F.substr(text, F.lit(1), F.length(text) - 2)).when(
        text.endswith("\n"), F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    parts = F.when(text.contains("\r\n"), F.split(cut, r"\r?\n")).otherwise(F.split(cut, "\n"))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(parts)


def has_trailing_space(text: Column) -> Column:
    """Whether any line ends in white space."""
    last = F.substr(text, F.lit(-1))
    return text.rlike(rf"\n(?<=[{INLINE_WS}]\r?\n)") | last.rlike(f"[{INLINE_WS}]")
