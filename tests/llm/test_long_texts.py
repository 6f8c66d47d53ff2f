"""Texts that make patterns with repeated groups overflow their stack, or retry from each sign."""

import pytest

from millrace.llm import credentials, licenses, quality, surrogates

LONG = {
    "dotted address": "x@" + "a." * 100_000 + "com", "hyphens": "x@" + "a-" * 100_000, "no address": "a" * 200_000 + " @ 1",
    "dotted word": "copyright " + "a." * 100_000, "hyphened word": "license " + "a-" * 100_000 + "b", "numbers": "1 " * 50_000, "one line": "word " * 100_000}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(list(enumerate(LONG.values())), "doc_id long, text string")


def test_surrogates(documents):
    got = {r["doc_id"]: r for r in surrogates.replace(documents, "key").collect()}
    assert len(got) == len(LONG) and got[0]["n_entities"] == 1 and got[0]["text"].endswith("@example.com")
    assert got[1]["n_entities"] == got[2]["n_entities"] == 0


def test_licenses(documents):
    files = documents.selectExpr("cast(doc_id as string) AS path", "text")
    got = {r["path"]: r["license"] for r in licenses.inherit(files).collect()}
    assert got["3"] == got["4"] == "unknown" and got["6"] is None and len(got) == len(LONG)


def test_secrets_and_quality(documents):
    assert credentials.find_secrets(documents).count() == len(LONG)
    assert quality.judge(documents, [0.0] * 64).filter("n_words > 0").count() == len(LONG)
