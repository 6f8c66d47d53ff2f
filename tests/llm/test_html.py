"""Pages with formulas, drawings and lists to choose from; broken and very long pages in proportional time."""

import time

import pytest

from millrace.llm import html_text


@pytest.mark.parametrize("html,text", [
    ("E=<math><mi>m</mi><mo>c</mo><annotation>no</annotation></math>", "E=mc"),
    ("<svg><title>t</title><desc>d</desc><text>label</text></svg>", "label"),
    ("Size <select><option>S<option selected>M</select> ok", "Size M ok"), ("<select><option>S<option>M</select>", "S"),
    ("<select multiple><option>S<option>M</select>", "S M"), ("<select></select>x", "x"),
    ("<table><tr><td><select><option>q</select><td>r</table>z", "q | r\n\nz"),
    ("<datalist><option>no</datalist>x", "x"), ("<p don't>hi <b title=\"a>b\">c</b>", "hi c"), ("a < b <c", "a < b"),
    ("a<!-- <b> -->b<!x>c", "abc"), ("<script>x</script y>z", "z"), ("<script>x</scripty>z", "")])
def test_pages(html, text):
    assert html_text.render(html) == text


@pytest.mark.parametrize("html", [
    "<div " * 200_000, "<a b='" * 150_000, "<div>" * 60_000 + "x", "<p><table><td>" + "<div>" * 60_000, "<script>" + "</script " * 100_000,
    "a<!--" * 100_000, "<" * 300_000, "<p>" + "<b><i>" * 30_000 + "</p>" * 30_000, "<table>" * 20_000, "<select>" * 50_000 + "<option>x"])
def test_long_broken_pages(html):
    start = time.time()
    html_text.render(html)
    assert time.time() - start < 10


def test_one_wide_cell_does_not_widen_all_rows():
    wide = "x" * 100_000
    text = html_text.render(f"<table><tr><td>{wide}<td>a</tr>" + "<tr><td>b<td>c</tr>" * 3000 + "</table>")
    assert wide + " | a" in text and len(text) < 1_000_000
