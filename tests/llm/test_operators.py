"""Small cases of every operator: nulls, empty and repeated rows, ties, clashing columns, brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from millrace.llm import credentials, decontaminate, hilbert, html_text, licenses, packing, quality, surrogates, toxicity

DOCS = "doc_id long, text string, n long, h string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in rows], DOCS)


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("<p>a<p>b &amp; c", "a\n\nb & c"),
    ("<ul><li>x<li>y<ol><li>1<li>2</ol></ul>", "- x\n- y\n  1. 1\n  2. 2"),
    ("<table><tr><td>aa<td>b<tr><th>c</th><th>dd</table>", "aa | b\nc  | dd"),
    ("<head><title>t</title></head><div hidden>no</div><span style='display:none'>h</span>yes<script>1<2</script>", "yes"),
    ("a <b>b</b>  c<br>d</i>", "a b c\nd"), ("<pre>k  l\n  m</pre>", "k  l\n  m"), ("<div>" * 3000 + "deep", "deep")])
def test_html(html, text):
    assert html_text.render(html) == text


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "<p>a", 3), (1, "<p>a", 3), (None, None, 4)], "page_id long, html string, text int")
    assert sorted((r["page_id"] or 0, r["text"]) for r in html_text.extract(df).collect()) == [(0, ""), (1, "a"), (1, "a")]


def test_surrogates_keep_identity_and_format(spark):
    rows = [(1, "mail Ann.B@x.org or ann.b@X.org, +1 (499) 555-6503 and +1 499 555 6503"), (2, "Mrs Anna Smith, 4467920212765298, 10.1.2.3"),
            (3, None), (4, "nothing"), (4, "nothing")]
    got = [(r["doc_id"], r["text"], r["n_entities"]) for r in surrogates.replace(frame(spark, rows), "key").collect()]
    first = next(t for i, t, _ in got if i == 1)
    mails = re.findall(r"\S+@\S+?(?=[, ])", first)
    assert mails[0] == mails[1] and "x.org" not in first.lower()
    numbers = re.findall(r"\+1 \(?\d{3}\)? \d{3}[- ]\d{4}", first)
    assert len(numbers) == 2 and len({re.sub(r"\D", "", n) for n in numbers}) == 1
    second = next(t for i, t, _ in got if i == 2)
    assert second.startswith("Mrs ") and "Smith" not in second and re.search(r" 4467\d{12},", second)
    assert sorted(n for _, _, n in got) == [0, 0, 0, 3, 4] and None in [t for _, t, _ in got]
    with pytest.raises(ValueError):
        surrogates.replace(frame(spark, rows), "")


def test_surrogates_stay_distinct(spark):
    ids = spark.range(3000).selectExpr("'ssn' AS kind", "cast(123456789 + id AS string) AS entity")
    got = surrogates.assign(ids, "key").collect()
    assert len({r["surrogate"] for r in got}) == len(got) == 3000
    assert not {r["surrogate"] for r in got} & {r["entity"] for r in got}


def test_quality_counts_and_score(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice("ab cd ef gh #x".split()) for _ in range(n)) for n in (0, 3, 12, 60, 300)] + [None, "a\na\nb " * 9]
    good = [(i, t) for i, t in enumerate(texts)]
    df, trusted = frame(spark, good), spark.createDataFrame([(3,), (3,), (None,)], "doc_id long")
    got = {x["doc_id"]: x for x in quality.judge(df, quality.gram_weights(df, trusted, buckets=64)).collect()}
    for i, t in good:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        inside = {k + j for k in range(len(w) - 4) if c[tuple(w[k:k + 5])] > 1 for j in range(5)}
        assert (got[i]["n_words"], got[i]["n_repeat_words"]) == (len(w), len(inside))
    assert got[5]["base_failed"] and not got[5]["kept"]
    assert quality.judge(df.limit(0), [0.0] * 64).count() == 0


def test_quality_windows_are_told_apart_by_whole_hashes(spark):
    """Hashes with the same first bits, alone, between equal ones and in one run with them."""
    rows = [[5, 4, 5, 9, 100, 4, 7], [1, 2, 3], [-1, 3, -1, -1, -2, 8, 8, 8], [7] * 9, [0, 1, 0, 1, 2, 3], [2 ** 62, 5, 2 ** 62, *range(9, 14)], []]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, h array<long>")
    for i, n in df.select("i", quality._covered(F.col("h"), 5)).collect():
        assert n == len({k + j for k, x in enumerate(rows[i]) if rows[i].count(x) > 1 for j in range(5)})


def test_quality_grams_are_counted_without_lambdas(spark):
    """In rows the same buckets as in arrays; what is surely not trusted is not scored a second time."""
    df = frame(spark, [(i, t) for i, t in enumerate(["a b a b c", "one", "", None, "x y"])])
    grams = quality._gram_rows(df, "text", 64)
    assert "lambda" not in grams._jdf.queryExecution().optimizedPlan().toString()
    arrays = df.select("doc_id", F.explode(quality.let(quality.words(F.col("text")), lambda w: quality._grams(
        w, F.transform(w, lambda x: F.xxhash64(x)), 64))).alias("b"))
    assert sorted(grams.select("doc_id", "b").collect()) == sorted(arrays.collect()) and grams.count() == 13
    trusted = spark.createDataFrame([(0,)], "doc_id long")
    held = quality._measured(df, [0.5] * 64, "doc_id", "text", [[0.5] * 64] * 2, trusted).filter("held_out IS NOT NULL")
    assert [r["doc_id"] for r in held.collect()] == [0]


def test_quality_threshold_follows_trusted_documents(spark):
    """The third lowest of 2,000 held-out scores; others, repeated ids and what fails the base rule do not count."""
    rows = [(i, False, (i - 150) / 1000 + 0.0005) for i in range(2000)] + [(2000, True, -9.0), (2001, False, -9.0), (None, False, -9.0)]
    measured = spark.createDataFrame(rows, "doc_id long, base_failed boolean, held_out double")
    trusted = spark.createDataFrame([(i,) for i in range(2001)] + [(3,), (None,)], "doc_id long")
    assert quality._threshold(measured, trusted, 0.001) == -0.148
    assert quality._threshold(measured, trusted.limit(0), 0.001) == float("-inf")


def test_decontamination_in_blocks_and_spans(spark):
    words = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words[:20]), 0), (2, "tiny item", 0), (3, None, 0), (None, " ".join(words[20:]), 0)], "item_id long, text string, hit int")
    rows = [(1, "Ä say, W0 " + "-".join(words[1:15]) + " end"), (2, "a Tiny, ITEM"), (3, None), (4, ""), (5, "tiny items"), (5, "tiny items"), (6, " ".join(words[20:]))]
    for size in (1 << 20, 30):
        got = {r["doc_id"]: r for r in decontaminate.find_passages(frame(spark, rows), bench, block_bytes=size).collect()}
        assert (got[1]["n_words"], got[1]["n_hit"], list(got[1]["items"])) == (18, 15, ["1"])
        assert [rows[0][1][s["start"]:s["end"]] for s in got[1]["spans"]] == ["W0 " + "-".join(words[1:15])]
        assert got[2]["contaminated"] and not got[5]["contaminated"] and got[6]["n_hit"] == 20 and got[6]["n_items"] == 0
        assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(frame(spark, rows), bench, block_bytes=size).collect()) == [3, 4, 5, 5]


def test_secrets_and_links(spark):
    key = "Ab3" + "x7Y" * 12 + "Q"
    rows = [(1, f"é login: bob then {key} ."), (2, key), (3, "login: bob"), (4, None), (5, 'Token = "0123456789abcdef0"'), (6, "secret=token: abcdefghijklmnop"),
            (7, "login: bob" + " " * 500 + key), (1, f"é login: bob then {key} .")]
    got = {r["doc_id"]: r["spans"] for r in credentials.find_secrets(frame(spark, rows)).collect()}
    assert got[1] == f"ident:2:12,bare:18:{18 + len(key)}" and got[5] == "assign:0:26,hex:9:26"
    assert {got[i] for i in (2, 3, 4, 6, 7)} == {""}
    clean = {r["doc_id"]: r["text"] for r in credentials.redact(frame(spark, rows)).collect()}
    assert clean[1] == "é [SECRET] then [SECRET] ." and clean[4] is None and clean[2] == key and clean[5] == '[SECRET]"'


def test_links_at_every_offset(spark):
    """Weak spans before, over and behind a part, shorter and longer than the scope, against the condition itself."""
    scope, weak, parts = 40, [], []
    for at in range(2 * scope + 1):
        for size in (0, 7, scope - 1, scope, scope + 1, 3 * scope):
            for gap in (0, 1, scope - 1, scope, scope + 1):
                for start in (at + size + gap, at - gap - 5):  # behind the weak span, before it
                    case = f"{len(weak)}"
                    weak.append((case, at, 3, at + size))
                    parts.append((case, start, 0, start + 5))
    schema = "digest string, start int, order int, end int"
    got = {r["digest"] for r in credentials._near(spark.createDataFrame(weak, schema), spark.createDataFrame(parts, schema), scope).collect()}
    assert got == {w[0] for w, p in zip(weak, parts) if p[1] <= w[3] + scope and p[3] >= w[1] - scope}
    assert credentials._near(spark.createDataFrame(weak[:1] * 2, schema).limit(1), spark.createDataFrame(parts[:1] * 3, schema), scope).count() == 1


def test_a_long_name_before_its_secret(spark):
    text = " " * 395 + "login: " + "z" * 28 + " " * 190 + "token = 0123456789ABCDEF"
    assert credentials.find_secrets(frame(spark, [(1, text)])).collect()[0]["spans"] == "ident:395:430,assign:620:644"


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(2)
    texts = [None, "", "<|endoftext|> X", "Don't stop...now,ok É́"] + [" ".join(r.choice(["Alpha", "beta,", "x.", "it's", "é"]) for _ in range(r.randrange(3000))) for _ in range(40)]
    t = Tokenizer.from_file(path)
    pieces = packing.pack(frame(spark, list(enumerate(texts))), path, length=512).collect()
    for i, text in enumerate(texts):
        ids = [x for p in sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"]) for x in np.frombuffer(p["ids"], "<u4")]
        assert ids == t.encode(text or "", add_special_tokens=False).ids + [2]
    ends = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == ends.get(p["sequence_id"], 0) and p["ids_crc32"] == zlib.crc32(p["ids"])
        ends[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(ends.values()) <= 512 and sum(512 - e for e in ends.values()) < 0.05 * sum(ends.values())
    assert packing.pack(frame(spark, []), path).count() == 0


def test_licences(spark):
    files = spark.createDataFrame([
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.txt", "prose"), ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0."),
        ("a/b/c/y.txt", None), ("z.txt", ""), (None, "prose"), ("a/own.txt", "words\nThis work is licensed under the GNU General Public License, version 3.")], "path string, text string")
    got = {r["path"]: (r["license"], r["origin"]) for r in licenses.inherit(files).collect()}
    assert got["a/b/x.txt"] == got["a/b/c/y.txt"] == ("Apache-2.0", "a/b") and got["a/own.txt"] == ("GPL-3.0", "header")
    assert got["z.txt"] == got[None] == (None, None) and len(got) == 7


def test_licences_of_their_own_are_not_overridden(spark):
    said = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under CC BY-SA 3.0.": "CC-BY-SA-3.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "CC-BY-NC-SA-4.0",
        "Released under the BSD 2-Clause License.": "BSD-2-Clause", "Released under the ISC License.": "ISC", "Released under the Unlicense.": "Unlicense",
        "Licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0", "Licensed under the Eclipse Public License, version 2.0.": "EPL-2.0",
        "Licensed under terms that nobody has heard of.": "unknown", "no word on it": "MIT"}
    rows = [("a/LICENSE", "Released under the MIT License.")] + [(f"a/{i}.txt", f"words\n{t}") for i, t in enumerate(said)]
    rows += [("a/b/LICENSE", "Licence: the Frobnitz terms of 1987"), ("a/b/x.txt", "prose")]
    got = {r["path"]: (r["license"], r["origin"]) for r in licenses.inherit(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [got[f"a/{i}.txt"] for i in range(len(said))] == [(n, "a" if n == "MIT" else "header") for n in said.values()]
    assert got["a/b/LICENSE"] == ("unknown", "header") and got["a/b/x.txt"] == ("unknown", "a/b")


def test_toxicity_learns_without_held_out_labels(spark):
    r = random.Random(4)
    rows = [(i, " ".join([f"w{r.randrange(300)}" for _ in range(40)] + (["awful", "nasty"] if i % 6 == 0 else []))) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(600) if i % 5 < 2] + [(None, 1)], "doc_id long, toxic int")
    docs = frame(spark, rows + [(None, None), (700, "")])
    model = toxicity.fit(docs, labels)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model).collect()}
    wrong = [i for i in range(600) if (got[i] >= 0.5) != (i % 6 == 0)]
    assert len(wrong) < 12 and got[700] < 0.5 and got[None] < 0.5
    assert toxicity.score(docs, toxicity.fit(docs.limit(0), labels.limit(0))).count() == 602


def test_hilbert_curve_and_equal_shards(spark):
    cells = np.argsort(hilbert.curve(2, 3))
    steps = np.abs(np.diff(np.stack([cells // 8, cells % 8]), axis=1)).sum(0)
    assert (steps == 1).all() and sorted(hilbert.curve(3, 2)) == list(range(64))
    df = spark.createDataFrame([(i if i % 9 else None, "same" if i % 3 else None, i % 7, 1) for i in range(101)], "doc_id long, lang string, size long, shard int")
    got = hilbert.shard_rows(df, ["lang", "size"], ["doc_id"]).collect()
    sizes = Counter(x["shard"] for x in got)
    assert len(got) == 101 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(x["slot"] for x in got if x["shard"] == s) == list(range(n)) for s, n in sizes.items())
    assert hilbert.shard_rows(df.limit(0), ["lang"], ["doc_id"]).count() == 0
