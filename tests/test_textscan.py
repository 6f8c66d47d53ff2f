import re

import pytest
from pyspark.sql import functions as F

from millrace.fixed_values import ERROR_KEYWORDS
from millrace.functions import text as tx
from millrace.operators import textscan

DOC = "all ok\nFatal ERROR here\nx\nfailed twice, failed"
WORDS = ["error", "fail", "failed", "fatal"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, DOC), (2, "nothing"), (3, ""), (4, None), (5, "error\r\n\r\nerror\n")], "k int, t string")


def test_lines(spark):
    texts = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb", "a\rb\n", "\r\n\r\n", "a\nb\n c \n"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.lines(F.col("t")).alias("l")).collect()
    for r in got:
        want = re.split(r"\r?\n", texts[r.i])
        assert r.l == (want[:-1] if want[-1] == "" else want), repr(texts[r.i])


def test_first_match(docs, rows):
    found = textscan.keyword_scan(docs, "k", "t", WORDS, context=1)
    assert rows(found.select("k", "line_no", "keyword")) == [(1, 2, "error"), (1, 4, "fail"), (5, 1, "error"), (5, 3, "error")]
    context = found.filter("k = 1 AND line_no = 2").first().context
    assert [(c.line_no, c.line, c.is_hit) for c in context] == [(1, "all ok", False), (2, "Fatal ERROR here", True), (3, "x", False)]
    assert [c.line_no for c in found.filter("k = 1 AND line_no = 4").first().context] == [3, 4]
    assert rows(textscan.keyword_scan(docs, "k", "t", WORDS, case_sensitive=True).select("k", "line_no", "keyword"))[0] == (1, 4, "fail")
    assert textscan.keyword_scan(docs, "k", "t", WORDS, max_bytes=20).filter("k = 1").count() == 0


def test_counts(docs, rows):
    assert rows(textscan.keyword_hits_per_text(docs, "k", "t", WORDS)) == [(1, 2), (5, 2)]
    assert rows(textscan.top_keywords(textscan.keyword_scan(docs, "k", "t", WORDS))) == [("error", 3), ("fail", 1)]
    assert tuple(textscan.keyword_summary(docs, "t", WORDS).first()) == (5, 2, 4)


def test_forbidden(docs, rows):
    assert rows(textscan.forbidden_scan(docs, "k", "t", WORDS).filter("k = 1")) == [
        (1, 2, "error"), (1, 2, "fatal"), (1, 4, "fail"), (1, 4, "failed")]
    assert rows(textscan.forbidden_scan(docs, "k", "t", ["^x$", r"twice.*d$"])) == [(1, 3, "^x$"), (1, 4, "twice.*d$")]


def test_no_keywords(docs):
    for scan in (textscan.keyword_scan, textscan.forbidden_scan):
        with pytest.raises(ValueError):
            scan(docs, "k", "t", [])


def test_hygiene(spark):
    texts = {"clean": "a\nb\n", "blank_end": "a \nb\n", "last": "a\nb ", "bom": "\ufeffa\n", "control": "a\x01\n", "empty": "", "big": "x" * 2000 + "\n"}
    df = spark.createDataFrame(list(texts.items()), "k string, t string")
    got = {r.k: r for r in textscan.hygiene(df, "k", "t", max_size_kb=1, forbidden=["a"]).collect()}
    assert got["clean"].issues == 1 and got["clean"].forbidden_hits == 1
    assert got["blank_end"].trailing_space and not got["clean"].trailing_space
    assert got["last"].trailing_space and got["last"].no_final_newline and got["last"].issues == 3
    assert got["bom"].byte_order_mark and got["control"].control_characters and got["big"].oversize
    assert got["empty"].empty and got["empty"].issues == 0
    assert tuple(textscan.hygiene_summary(textscan.hygiene(df, "k", "t", 1)).first()) == (7, 5, 6)


@pytest.mark.parametrize("kind, good, bad", [
    ("json", ['{"a":1}', "[1]", '"x"'], ["{a}", "", "[1", '{"a":1}}', "1,2", '1,"b":2', "[1] x", '1} {"c":1']),
    ("xml", ["<a><b>x</b></a>", '<a x="1"/>', '<?xml version="1.0" encoding="UTF-8"?>\n<a>é</a>', "<!DOCTYPE a><a/>\n", "<a/><!-- c -->"],
     ["<a><b></a>", "plain", "", "<a/>junk", "<a/><b/>", "<a>&nbsp;</a>", '<a x="1" x="2"/>', "<a>\x01</a>"]),
    ("yaml", ["a: 1", "- x\n- y", ""], ["a: [1", "a: b: c"]),
    ("text", ["plain\ttext\n"], ["bell\x07"]),
])
def test_well_formed(spark, kind, good, bad):
    df = spark.createDataFrame([(t, True) for t in good] + [(t, False) for t in bad] + [(None, None)], "t string, want boolean")
    checked = textscan.well_formed(df.withColumn("k", F.col("want")), "k", "t", kind)
    assert checked.filter("NOT (k <=> well_formed)").count() == 0
    assert tuple(textscan.well_formed_summary(checked).first()) == (len(good) + len(bad) + 1, len(bad) + 1)


def test_against_brute_force(spark, folder):
    """Default keywords over whole texts, with words planted, beside plain Python."""
    planted = spark.read.parquet(f"{folder}/documents.parquet").select(
        "doc_id", F.regexp_replace("text", "(?i)the", "Timeout Error").alias("t"))
    want = set()
    for doc_id, text in planted.collect():
        for i, line in enumerate(re.split(r"\r?\n", text), 1):
            word = next((w for w in ERROR_KEYWORDS if w in line.lower()), None)
            if word:
                want.add((doc_id, i, word))
    got = {tuple(r) for r in textscan.keyword_scan(planted, "doc_id", "t").select("doc_id", "line_no", "keyword").collect()}
    assert got == want and len(want) > 100
