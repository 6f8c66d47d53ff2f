"""Visible text of HTML pages, laid out as a browser would.

A tree builder turns tags into balanced open and close events: it supplies the tags that HTML leaves
out, closes what a new tag ends, and ignores stray ends.  A renderer follows the events: it leaves out
what is not displayed, folds white space, separates blocks, numbers and indents lists and lines up the
cells of tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import plain, rows_at_once

#: Where something other than text may start; each kind then has a pattern that matches there without going back.
START = re.compile(r"<(?=[!?]|/?[a-zA-Z])")
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?", re.S)
#: A quoted value may hold ">"; a quote elsewhere is a sign like others.
TAG = re.compile(r"</?[a-zA-Z](?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
SPACE = re.compile(r"[ \t\n\r\f]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
#: Not displayed, whatever they hold.
HIDDEN = frozenset(
    "head script style template noscript title iframe object audio video canvas datalist "
    "annotation annotation-xml desc metadata defs".split())
#: A blank line before and after; a new line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset hr".split())
BLOCK = SPACED | frozenset(
    "html body div article section nav aside header footer main address form li dt dd tr caption details summary "
    "figcaption legend option center dir menu".split())
ENDS_P = BLOCK - frozenset("html body tr caption option li dt dd".split()) | frozenset(["li", "dt", "dd"])
IN_HEAD = frozenset("title meta link base style script template noscript".split())
#: A new tag closes the open tags of the first set, as far up as the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "caption": ({"caption"}, {"table"}),
    **{t: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}) for t in ("thead", "tbody", "tfoot")}}
SCOPE = frozenset("td th table caption".split())
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)


def shown(tag: str, source: str) -> bool:
    if tag in HIDDEN:
        return False
    if "hidden" not in source.lower() and "none" not in source.lower() and tag != "dialog":
        return True
    attributes = {}
    for m in ATTRIBUTE.finditer(source):
        attributes.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    if tag == "dialog" and "open" not in attributes:
        return False
    return "hidden" not in attributes and not NOT_SHOWN.search(unescape(attributes.get("style", "")))


def events(html: str) -> Iterator[tuple[str, str, str]]:
    """Balanced ``open``, ``close`` and ``text`` events; the source of the tag comes with ``open``.

    One pass forward.  A tag that the page ends within is not displayed, as in a browser.
    """
    stack: list[str] = []
    places: dict[str, list[int]] = {}  # where each open tag stands in the stack
    at, size = 0, len(html)

    def push(tag: str) -> None:
        places.setdefault(tag, []).append(len(stack))
        stack.append(tag)

    def pop() -> str:
        places[stack[-1]].pop()
        return stack.pop()

    def close_to(depth: int) -> Iterator[tuple[str, str, str]]:
        while len(stack) > depth:
            yield "close", pop(), ""

    def highest(names) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def last(names, barrier=frozenset()) -> int:
        """Place of the innermost open tag among ``names``, unless one of ``barrier`` is further in."""
        i = highest(names)
        return i if i >= highest(barrier) else -1

    def place(tag: str) -> Iterator[tuple[str, str, str]]:
        """Supply html, head or body, and end what this tag ends."""
        if not stack and tag != "html":
            push("html")
            yield "open", "html", ""
        if stack == ["html"] and tag not in ("html", "head", "body"):
            part = "head" if tag in IN_HEAD else "body"
            push(part)
            yield "open", part, ""
        elif stack == ["html", "head"] and tag not in IN_HEAD:
            yield from close_to(1)
            if tag != "body":
                push("body")
                yield "open", "body", ""
        if tag in CLOSES and (i := last(*CLOSES[tag])) >= 0:
            yield from close_to(i)
        if tag in ENDS_P and (i := last({"p"}, SCOPE)) >= 0:
            yield from close_to(i)
        if tag in ("td", "th") and last({"tr"}, {"table"}) < 0 and last({"table"}) >= 0:
            push("tr")
            yield "open", "tr", ""

    while at < size:
        m = START.search(html, at)
        text = html[at:m.start() if m else size]
        if text and (text.strip() or len(stack) > 2):
            yield from place("#text")
            yield "text", unescape(text) if "&" in text else text, ""
        if not m:
            break
        if html[m.end()] in "!?":
            at = COMMENT.match(html, m.start()).end()
            continue
        m = TAG.match(html, m.start())
        if not m:
            break
        at, source = m.end(), m[0]
        tag = NAME.match(source)[1].lower()
        if source[1] == "/":
            if tag in ("html", "body"):
                continue
            if tag == "p" and last({"p"}, SCOPE) < 0:  # an end without a start is an empty paragraph
                yield from place("p")
                yield "open", "p", ""
                yield "close", "p", ""
            elif tag == "br":
                yield "open", "br", ""
                yield "close", "br", ""
            elif (i := last({tag}, SCOPE - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else {"table"} - {tag})) >= 0:
                yield from close_to(i)
            continue
        if tag in ("html", "head", "body") and tag in stack:
            continue
        yield from place(tag)
        yield "open", tag, source
        if tag in VOID:
            yield "close", tag, ""
            continue
        push(tag)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?![^\s/>])[^>]*+(?:>|\Z)", re.I).search(html, at)
            yield "text", html[at:end.start() if end else size], ""
            at = end.end() if end else size
            yield "close", pop(), ""
    yield from close_to(0)


class Page:
    """Lines of a box under construction: the page itself, or one cell of a table."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False
        self.prefix: list[str] = []
        self.marker = ""

    def add(self, text: str, keep: bool) -> None:
        if keep:
            first, *more = text.split("\n")
            self.line.append(first)
            for part in more:
                self.end(True)
                self.line.append(part)
            return
        text = SPACE.sub(" ", text)
        if text[:1] == " " and (not self.line or self.line[-1][-1:] in ("", " ")):
            text = text[1:]
        if text:
            self.line.append(text)

    def end(self, keep: bool = False) -> None:
        text = "".join(self.line)
        text = text if keep else text.strip(" ")
        self.line = []
        if not text and not keep:
            return
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        indent = "".join(self.prefix)
        if self.marker:
            indent = indent[:len(indent) - len(self.marker)] + self.marker
            self.marker = ""
        self.lines.append((indent + text).rstrip(" "))

    def block(self, spaced: bool) -> None:
        self.end()
        self.gap = self.gap or spaced

    def text(self) -> str:
        self.end()
        return "\n".join(self.lines)


#: Columns are padded up to this width; a longer cell is shown whole and moves what follows it on its line.
WIDEST = 200


def aligned(rows: list[list[str]]) -> list[str]:
    """Cells under each other; a cell of several lines takes several lines."""
    widths: list[int] = []
    split = [[c.split("\n") for c in r] for r in rows]
    for row in split:
        widths += [0] * (len(row) - len(widths))
        for i, cell in enumerate(row):
            widths[i] = max(widths[i], *(min(len(line), WIDEST) for line in cell))
    out = []
    for row in split:
        for k in range(max(map(len, row), default=0)):
            out.append(" | ".join((c[k] if k < len(c) else "").ljust(w) for c, w in zip(row, widths)).rstrip(" "))
    return out


def has(attribute: str, source: str) -> bool:
    return any(m[1].lower() == attribute for m in ATTRIBUTE.finditer(source[source.find(" "):])) if " " in source else False


def chosen(options: list[tuple[bool, str]], several: bool) -> str:
    """What a closed list shows: the last selected option, or the first; a list of several shows all."""
    if several:
        return " ".join(text for _, text in options)
    return next((text for on, text in reversed(options) if on), options[0][1] if options else "")


def render(html: str | None) -> str:
    """All visible text.  Null and empty pages give ""."""
    if not html:
        return ""
    pages, tables, lists = [Page()], [], []
    choices: list[tuple[bool, list[tuple[bool, str]]]] = []
    selected = False
    hidden = pre = 0
    for kind, what, source in events(html):
        if hidden:
            hidden += (kind == "open") - (kind == "close")
            continue
        page = pages[-1]
        if kind == "text":
            page.add(what, pre > 0)
        elif kind == "open":
            if not shown(what, source):
                hidden = 1
            elif what == "br":
                page.end(True)
            elif what == "hr":
                page.block(True)
                page.line.append("---")
                page.block(True)
            elif what in ("td", "th"):
                pages.append(Page())
            elif what == "select":
                choices.append((has("multiple", source), []))
                pages.append(Page())
            elif what == "option" and choices:
                selected = has("selected", source)
                pages.append(Page())
            elif what == "tr" and tables:
                tables[-1].append([])
            elif what in BLOCK:
                page.block(what in SPACED and not (lists and what in ("ul", "ol")))
                if what in ("ul", "ol", "menu", "dir"):
                    lists.append(0 if what == "ol" else None)
                elif what == "li":
                    if lists and lists[-1] is not None:
                        lists[-1] += 1
                    page.marker = f"{lists[-1]}. " if lists and lists[-1] else "- "
                    page.prefix.append(" " * len(page.marker))
                elif what == "dd":
                    page.prefix.append("  ")
                elif what == "blockquote":
                    page.prefix.append("> ")
                elif what == "pre":
                    pre += 1
                elif what == "table":
                    tables.append([])
        elif what == "option" and choices:
            choices[-1][1].append((selected, pages.pop().text()))
        elif what == "select":
            pages.pop()
            several, options = choices.pop()
            pages[-1].add(chosen(options, several), False)
        elif what in ("td", "th"):
            cell = pages.pop().text()
            if not tables:
                pages[-1].add(f" {cell} ", False)
            else:
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append(cell)
        elif what == "table":
            page.end()
            for line in aligned([r for r in tables.pop() if r]):
                page.line.append(line)
                page.end(True)
            page.block(True)
        elif what in BLOCK and what not in ("hr", "tr"):
            if what == "pre" and page.line:
                page.end(True)
            page.block(what in SPACED and not (len(lists) > 1 and what in ("ul", "ol")))
            if what in ("ul", "ol", "menu", "dir"):
                lists.pop()
            elif what in ("li", "dd", "blockquote"):
                page.prefix.pop()
                page.marker = ""
            elif what == "pre":
                pre -= 1
    return pages[0].text()


RESULT = pa.schema([("page_id", pa.int64()), ("text", pa.string())])


def _renderer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([render(h) for h in batch.column(1).to_pylist()], pa.string())], schema=RESULT)


def extract(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """``page_id, text`` for every row; null ids and repeated rows stay as they are, an empty table has no rows.

    Pages of any length are taken whole, in time and memory in proportion to them.  Further columns do not matter.
    """
    rows_at_once(pages.sparkSession)
    return plain(pages, page_id=page_id, html=html).mapInArrow(_renderer, "page_id long, text string")
