"""Line scans over text columns.

A text is split into lines once; hits and their context are array expressions on that row, so a
scan is a single narrow stage however large the corpus is.  Only hits leave the row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import CONTROL_CHARACTERS, ERROR_KEYWORDS, FORBIDDEN_KEYWORDS, MAX_SIZE_KB
from ..functions import text as tx
from ..functions.paths import top


def _first_keyword(line: Column, keywords: Sequence[str], case_sensitive: bool) -> Column:
    """The first listed keyword that the line contains."""

    def chain(haystack: Column) -> Column:
        found = F.when(haystack.contains(_fold(keywords[0], case_sensitive)), keywords[0])
        for keyword in keywords[1:]:
            found = found.when(haystack.contains(_fold(keyword, case_sensitive)), keyword)
        return found

    return chain(line) if case_sensitive else tx.once(F.lower(line), chain)


def _fold(keyword: str, case_sensitive: bool) -> str:
    return keyword if case_sensitive else keyword.lower()


def _may_hit(text: Column, keywords: Sequence[str], case_sensitive: bool) -> Column:
    """Whether the whole text contains any keyword: cheap, and rules most texts out before the
    split into lines.  A keyword with a line break is in no line, and the line test decides."""

    def any_of(haystack: Column) -> Column:
        hit = haystack.contains(_fold(keywords[0], case_sensitive))
        for keyword in keywords[1:]:
            hit = hit | haystack.contains(_fold(keyword, case_sensitive))
        return hit

    return F.coalesce(any_of(text) if case_sensitive else tx.once(F.lower(text), any_of), F.lit(False))


def _hits(lines: Column, keywords: Sequence[str], case_sensitive: bool) -> Column:
    marked = F.transform(lines, lambda line, i: F.struct(
        (i + 1).alias("line_no"), _first_keyword(line, keywords, case_sensitive).alias("keyword"), line.alias("line")))
    return F.filter(marked, lambda hit: hit["keyword"].isNotNull())


def _hit_count(text: Column, keywords: Sequence[str], case_sensitive: bool) -> Column:
    return F.when(_may_hit(text, keywords, case_sensitive),
                  F.size(_hits(tx.lines(text), keywords, case_sensitive))).otherwise(0)


def keyword_scan(
    df: DataFrame,
    id: str,
    text: str,
    keywords: Sequence[str] = ERROR_KEYWORDS,
    context: int = 2,
    case_sensitive: bool = False,
    max_bytes: int | None = None,
) -> DataFrame:
    """``id, line_no, keyword, line, context``: lines with a keyword, one hit per line.

    The keyword is the first of the list that the line contains.  ``context`` is an array of
    ``struct<line_no, line, is_hit>`` for the lines around the hit, cut at the ends of the text.
    ``max_bytes`` leaves out larger texts; by default none is left out.
    """
    if not keywords:
        raise ValueError("No keywords given")

    def around(hit: Column) -> Column:
        first = F.greatest(hit["line_no"] - context, F.lit(1))
        window = F.slice(F.col("_lines"), first, hit["line_no"] + context - first + 1)
        return F.transform(window, lambda line, i: F.struct(
            (first + i).cast("int").alias("line_no"), line.alias("line"),
            (first + i == hit["line_no"]).alias("is_hit")))

    found = F.transform(_hits(F.col("_lines"), keywords, case_sensitive), lambda hit: F.struct(
        hit["line_no"].alias("line_no"), hit["keyword"].alias("keyword"),
        tx.strip(hit["line"]).alias("line"), around(hit).alias("context")))
    if max_bytes is not None:
        df = df.filter(F.octet_length(top(text)) <= max_bytes)
    return (
        df.filter(_may_hit(top(text), keywords, case_sensitive))
        .select(top(id), tx.lines(top(text)).alias("_lines"))
        .select(top(id), F.inline(found)))


def keyword_context(scan: DataFrame, id: str) -> DataFrame:
    """``id, hit_line, keyword, line_no, line, is_hit``: the context lines of a scan, one per row."""
    return scan.select(top(id), F.col("line_no").alias("hit_line"), "keyword", F.inline("context"))


def keyword_hits_per_text(
    df: DataFrame, id: str, text: str, keywords: Sequence[str] = ERROR_KEYWORDS, case_sensitive: bool = False
) -> DataFrame:
    """``id, hits`` of the texts with any hit; counted inside the row."""
    return df.select(top(id), _hit_count(top(text), keywords, case_sensitive).alias("hits")).filter("hits > 0")


def top_keywords(scan: DataFrame, k: int = 10) -> DataFrame:
    """``keyword, n``: the most frequent keywords of a scan."""
    return scan.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "keyword").limit(k)


def keyword_summary(df: DataFrame, text: str, keywords: Sequence[str] = ERROR_KEYWORDS, case_sensitive: bool = False) -> DataFrame:
    """``scanned, with_hits, hits``."""
    per_text = df.select(_hit_count(top(text), keywords, case_sensitive).alias("h"))
    return per_text.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count(F.when(F.col("h") > 0, 1)).alias("with_hits"),
        F.coalesce(F.sum("h"), F.lit(0)).alias("hits"))


#: Parts of a pattern that look at what surrounds a match, or that give up on alternatives.
_CONTEXT = re.compile(r"[\^$]|\(\?|\\[AZzGB]|[*+?}]\+")


def _forbidden(text: Column, keywords: Sequence[str]) -> Column:
    """All ``struct<line_no, keyword>`` of a text; the keywords are regular expressions."""

    def in_line(line: Column, i: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(line.rlike("(?i)" + k), F.struct((i + 1).alias("line_no"), F.lit(k).alias("keyword")))
            for k in keywords]))

    found = F.flatten(F.transform(tx.lines(text), in_line))
    if any(_CONTEXT.search(k) for k in keywords):
        return found
    # Without anchors and the like, a match in a line is a match in the text.
    may_hit = text.rlike("(?i)" + keywords[0])
    for k in keywords[1:]:
        may_hit = may_hit | text.rlike("(?i)" + k)
    return F.when(may_hit, found)


def forbidden_scan(df: DataFrame, id: str, text: str, keywords: Sequence[str] = FORBIDDEN_KEYWORDS) -> DataFrame:
    """``id, line_no, keyword``: every keyword pattern per line that matches, case-insensitively."""
    if not keywords:
        raise ValueError("No keywords given")
    return df.select(top(id), F.inline(_forbidden(top(text), keywords)))


def hygiene(
    df: DataFrame,
    id: str,
    text: str,
    max_size_kb: int = MAX_SIZE_KB,
    forbidden: Sequence[str] = (),
) -> DataFrame:
    """``id``, one boolean per flag, ``forbidden_hits`` and ``issues`` (flags and hits, but not ``empty``).

    An empty text is allowed and has no other flags.
    """
    value = F.coalesce(top(text), F.lit(""))
    flags = {
        "oversize": F.octet_length(value) > max_size_kb * 1024,
        "trailing_space": tx.has_trailing_space(value),
        "byte_order_mark": value.startswith("\ufeff"),
        "no_final_newline": ~value.endswith("\n"),
        "control_characters": value.rlike(CONTROL_CHARACTERS),
    }
    filled = F.length(value) > 0
    out = df.select(
        top(id), (~filled).alias("empty"),
        *[(filled & c).alias(n) for n, c in flags.items()],
        F.coalesce(F.array_size(_forbidden(value, forbidden)) if forbidden else F.lit(0), F.lit(0)).alias("forbidden_hits"))
    issues = sum((F.col(n).cast("int") for n in flags), F.col("forbidden_hits"))
    return out.withColumn("issues", issues)


def hygiene_summary(checked: DataFrame) -> DataFrame:
    """``checked, with_issues, issues``."""
    return checked.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count(F.when(F.col("issues") > 0, 1)).alias("with_issues"),
        F.coalesce(F.sum("issues"), F.lit(0)).alias("issues"))


@F.pandas_udf(T.BooleanType())
def yaml_ok(text: pd.Series) -> pd.Series:
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    def parses(value: str | None) -> bool | None:
        if value is None:
            return None
        try:
            for _ in yaml.parse(value, Loader=loader):
                pass
            return True
        except yaml.YAMLError:
            return False

    return text.map(parses)


@F.pandas_udf(T.BooleanType())
def xml_ok(text: pd.Series) -> pd.Series:
    """Spark's own XML parser stops after the root element and ignores what follows, so this
    check uses a parser that reads to the end."""
    from xml.parsers import expat

    def parses(value: str | None) -> bool | None:
        if value is None:
            return None
        try:
            expat.ParserCreate().Parse(value, True)
            return True
        except expat.ExpatError:
            return False

    return text.map(parses)


def well_formed(df: DataFrame, id: str, text: str, kind: str) -> DataFrame:
    """``id, well_formed`` for JSON, XML, YAML or plain text (no control characters)."""
    checks = {
        "json": tx.is_json,
        "xml": xml_ok,
        "yaml": yaml_ok,
        "text": lambda c: ~c.rlike(CONTROL_CHARACTERS),
    }
    if kind not in checks:
        raise ValueError(f"Unknown kind: {kind}")
    return df.select(top(id), checks[kind](top(text)).alias("well_formed"))


def well_formed_summary(checked: DataFrame) -> DataFrame:
    """``checked, failed``."""
    return checked.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count(F.when(~F.coalesce(F.col("well_formed"), F.lit(False)), 1)).alias("failed"))
