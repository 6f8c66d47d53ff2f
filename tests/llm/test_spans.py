"""Spans and marks against Python's own, over more pieces than one run sums, and base columns by brute force."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from millrace.llm import credentials as C
from millrace.llm import spans as S

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base_by_hand(text):
    text = text or ""
    found = {
        "assign": [m.span() for m in re.finditer(ASSIGN, text) if len(m[2]) >= 12],
        "access": [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18],
        "hex": [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]}
    order = sorted((a, k, b) for k, (kind, at) in enumerate(found.items()) for a, b in at)
    return [len(v) for v in found.values()], ",".join(f"{list(found)[k]}:{a}:{b}" for a, k, b in order)


def made(seed, pieces):
    r = random.Random(seed)
    parts = ["é", "😀 ", "token = ", "Secret:'", "API_KEY=", "abcdefghijkl", "0123456789abcdef", "AKIAABCDEFGHIJKLMN", " ", "\n", "x", "tokentoken=", "0a" * 9, "short1"]
    return "".join(r.choice(parts) for _ in range(pieces))


@pytest.fixture(scope="module")
def documents(spark):
    texts = [None, "", "x"] + [made(i, n) for i, n in enumerate((1, 3, 10, 50, 50, 50, 400, 2000, 9000))]
    rows = [(i, t, "mine", False, 1) for i, t in enumerate(texts)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, `_digest` string, `_suspect` boolean, `_SPANS` int")


def test_base_by_brute_force(documents):
    got = C.find_secrets(documents).select("doc_id", *[F.size(k).alias(k) for k in ("assign", "access", "hex")], F.sha2("base", 256).alias("d")).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert len(got) == 2 * len(texts)
    for r in got:
        counts, listed = base_by_hand(texts[r["doc_id"]])
        assert [r["assign"], r["access"], r["hex"]] == counts and r["d"] == hashlib.sha256(listed.encode()).hexdigest()


def test_redaction_by_brute_force_and_clashing_columns(documents):
    clean = C.redact(documents)
    assert clean.columns == documents.columns
    spans = {r["doc_id"]: r["spans"] for r in C.find_secrets(documents).collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in clean.collect():
        assert (r["_digest"], r["_suspect"], r["_SPANS"]) == ("mine", False, 1)
        at, out, old = 0, [], texts[r["doc_id"]]
        for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans[r["doc_id"]].split(",") if s):
            if a >= at:
                out += [old[at:a], "[SECRET]"]
            at = max(at, b)
        assert r["text"] == (None if old is None else "".join(out) + old[at:])


def test_empty_tables(documents):
    assert C.find_secrets(documents.limit(0)).count() == 0 and C.redact(documents.limit(0)).count() == 0


def test_matches_at_the_edges_of_runs(spark):
    for n in (S.RUN - 1, S.RUN, S.RUN + 1, 3 * S.RUN):
        text = "é-ab" * n
        got = spark.range(1).select(S.matches(F.lit(text), "ab", lambda m: m == "ab").alias("s")).first()["s"]
        assert [(s["start"], s["end"]) for s in got] == [m.span() for m in re.finditer("ab", text)]


def test_time_follows_the_matches(spark):
    def seconds(n):
        one = spark.createDataFrame([(1, "é0123456789abcdef01 " * n)], "doc_id long, text string")
        start = time.time()
        assert C.redact(one).select(F.length("text")).first()[0] == 10 * n
        return time.time() - start

    seconds(10)
    assert seconds(32_000) < 10 * max(seconds(8_000), 2)
