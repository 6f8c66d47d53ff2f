"""Near-duplicates, noise, sentence order, balance, personal data and masks."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.arrays import BLOCK, running_sum
from millrace.operators import balance, mask, near_duplicates, personal, vary


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


# -- near-duplicates -----------------------------------------------------------------------------

def families(seed, count, copies):
    """Texts of 60 words, each with copies in which some words differ."""
    r, rows = random.Random(seed), []
    for f in range(count):
        base = [f"w{r.randrange(5000)}" for _ in range(60)]
        for _ in range(copies):
            text = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                text[r.randrange(60)] = f"x{r.randrange(10 ** 6)}"
            rows.append(" ".join(text))
    return list(enumerate(rows))


def links(rows, words, percent):
    sets = {i: {tuple(t.split()[k:k + words]) for k in range(len(t.split()) - words + 1)} for i, t in rows}
    return [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


def closure(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicate_recall(spark):
    rows = families(1, 60, 4)
    df = spark.createDataFrame(rows, "id long, text string")
    sets = df.select(F.col("id").cast("string").alias("id"), near_duplicates.shingle_set(F.col("text"), 5).alias("hashes")).withColumn("n", F.size("hashes"))
    got = {tuple(sorted((int(r["a"]), int(r["b"])))) for r in near_duplicates.near_duplicate_links(sets, 80).collect()}
    want = set(links(rows, 5, 80))
    assert got <= want and len(want) > 50 and len(got) >= 0.98 * len(want)


def test_large_group_and_copies(spark):
    """A group beyond every bucket's size, many exact copies, and records without words."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:i] + [f"n{i}"] + base[i + 1:]), "a") for i in range(120)]
    rows += [(1000 + i, "Same words in  each of these", "b") for i in range(50)] + [(2000, "", "c"), (2001, None, "d"), (2002, " \t", None)]
    df = spark.createDataFrame(rows, "id long, text string, n string")
    got = {r["id"]: r["representative"] for r in near_duplicates.near_duplicates(df, ["text"], "id").collect()}
    assert got == {i: 0 if i < 120 else 1000 if i < 2000 else i for i, _, _ in rows}
    kept = near_duplicates.drop_near_duplicates(df, ["text"], "id")
    assert kept.columns == df.columns and sorted(r["id"] for r in kept.collect()) == [0, 1000, 2000, 2001, 2002]
    assert near_duplicates.near_duplicates(df.limit(0), ["text"], "id").count() == 0


def test_several_fields_and_closure(spark):
    rows = families(2, 12, 5)
    df = spark.createDataFrame([(i, t, i % 2) for i, t in rows], "id int, text string, flag int")
    got = {r["id"]: r["representative"] for r in near_duplicates.near_duplicates(df, ["text"], "id", words=3, percent=70).collect()}
    assert got == closure([i for i, _ in rows], links(rows, 3, 70))


# -- noise and sentences -------------------------------------------------------------------------

def test_noise_rate(spark):
    text = "abcdefghij" * 2000
    df = spark.createDataFrame([(1, text, None), (2, text, ""), (3, text, "x")], "id int, text string, other string")
    for rate in (0.0, 0.05, 0.3):
        got = vary.add_noise(df, ["text", "other"], "id", rate=rate, seed=3).collect()
        for r in got:
            dropped_less_doubled = len(text) - len(r["text"])
            assert abs(dropped_less_doubled) < 0.03 * len(text)
            assert (r["text"] == text) == (rate == 0)
        assert got[0]["other"] is None and got[1]["other"] == ""
        if rate:
            assert got[0]["text"] != got[1]["text"]
            again = vary.add_noise(df.repartition(3), ["text", "other"], "id", rate=rate, seed=3).collect()
            assert {r["id"]: r["text"] for r in again} == {r["id"]: r["text"] for r in got}


def test_noise_keeps_characters(spark):
    """Swaps alone would keep the multiset; drops and doubles change it by one each; all edits near the rate."""
    text = "".join(chr(0x4E00 + i) for i in range(8000)) + "😀"
    got = one(spark, vary.noisy(F.col("t"), F.lit("seed"), 0.1), t=text)
    counts = [got.count(c) for c in text]
    dropped, doubled = counts.count(0), counts.count(2)
    order = [c for c in got if got.count(c) == 1] if len(got) < 3000 else None
    assert order is None and 0.02 < dropped / 8000 < 0.05 and 0.02 < doubled / 8000 < 0.05 and set(counts) <= {0, 1, 2}
    with pytest.raises(ValueError):
        vary.noisy(F.col("t"), F.lit("s"), 1.5)


@pytest.mark.parametrize("text,sentences", [
    ("One. Two! Three?  Four", ["One.", "Two!", "Three?", "Four"]),
    ("Dr. A. B. Smith met Mr. Jones, e.g. at 3. Mai. Then U.S. Army came.", ["Dr. A. B. Smith met Mr. Jones, e.g. at 3. Mai.", "Then U.S. Army came."]),
    ("It was 3.14 or so... and more. \"Yes!\" He left.\n\nNew.", ["It was 3.14 or so... and more.", "\"Yes!\"", "He left.", "New."]),
    ("no end", ["no end"]), ("", [""]), ("Ünï. Éa? ñu. Да.", ["Ünï.", "Éa? ñu.", "Да."]),
])
def test_sentences(spark, text, sentences):
    pieces = one(spark, vary.sentence_pieces(F.col("t")), t=text)
    assert pieces[::2] == sentences and "".join(pieces) == text and all(g.isspace() for g in pieces[1::2])
    new, rest = one(spark, vary.reordered(F.col("t"), F.lit("base")), t=text), sorted(pieces[::2], key=len, reverse=True)
    assert len(new) == len(text) and sorted(new) == sorted(text) and all(s in new for s in rest)


def test_marks_and_nulls(spark):
    marked = "One. Two. Three."
    df = spark.createDataFrame([(1, marked), (2, None), (3, "A b c. D e f. " * 500)], "id int, text string")
    got = {r["id"]: r["text"] for r in vary.reorder_sentences(df, ["text"], "id").collect()}
    assert got[1] == marked and got[2] is None and len(got[3]) == 7000


# -- balance -------------------------------------------------------------------------------------

@pytest.mark.parametrize("target,size", [("largest", 700), ("smallest", 3), (50, 50), (0, 0)])
def test_balance(spark, target, size):
    rows = [(i, "big" if i < 700 else "mid" if i < 790 else "small" if i < 793 else None) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, label string").repartition(5)
    got = balance.balance(df, "label", "id", target)
    counts = {r["label"]: r["count"] for r in got.groupBy("label").count().collect()}
    assert counts == {k: v for k, v in {"big": size, "mid": size, "small": size, None: 7}.items() if v}
    each = got.filter("label IS NOT NULL").groupBy("label", "id").count().groupBy("label").agg(F.min("count").alias("a"), F.max("count").alias("b"))
    assert all(r["b"] - r["a"] <= 1 for r in each.collect())
    assert got.select("id", "copy_no").distinct().count() == got.count()


def test_balance_of_nothing(spark):
    df = spark.createDataFrame([], "id long, label string, whole int")
    assert balance.balance(df, "label", "id").count() == 0
    with pytest.raises(ValueError):
        balance.balance(df, "label", "id", "middle")


# -- personal data and masks ---------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, BLOCK, BLOCK + 1, BLOCK * BLOCK + 3])
def test_running_sum(spark, n):
    values = spark.range(1).select(F.expr(f"transform(sequence(1, {max(n, 1)}), x -> cast(x % 7 as int))").alias("v")).select(
        F.slice("v", 1, n).alias("v"))
    got, total, want = values.select(running_sum(F.col("v"))).first()[0], 0, []
    for i in range(1, n + 1):
        total += i % 7
        want.append(total)
    assert got == want


@pytest.mark.parametrize("text,found", [
    ("mail a.b@x.org, x@y..com @ b@c.d.", [("email", "a.b@x.org")]),
    ("card 4111 1111 1111 1111 or 4111 1111 1111 1112; 378282246310005", [("credit_card", "4111 1111 1111 1111"), ("credit_card", "378282246310005")]),
    ("IBAN DE89 3704 0044 0532 0130 00 not DE88 3704 0044 0532 0130 00.", [("iban", "DE89 3704 0044 0532 0130 00")]),
    ("123-45-6789 000-12-3456 987-65-4321 123-00-1234", [("ssn", "123-45-6789")]),
    ("10.0.0.255 10.0.0.256 v1.2.3.4", [("ip", "10.0.0.255")]),
    ("+49 30 1234567, (555) 123-4567 and 555-123-4567x", [("phone", "+49 30 1234567"), ("phone", "(555) 123-4567")]),
    ("", []), ("nothing here", []), ("😀 1.1.1.1", [("ip", "1.1.1.1")])])
def test_personal_spans(spark, text, found):
    got = one(spark, personal.personal_spans(F.col("t")), t=text)
    assert [(s["kind"], s["value"]) for s in got] == found
    assert all(text[s["start"]:s["end"]] == s["value"] for s in got)


def test_personal_data_in_many_places(spark):
    """Twenty thousand addresses in one text, long runs of one sign, nulls."""
    text = " ".join(f"u{i}@x.org" for i in range(20_000))
    df = spark.createDataFrame([(1, text), (2, None), (3, "a." * 100_000 + "@" + "b." * 100_000), (4, "1 " * 100_000), (5, "@ " + "a" * 400_000)], "id int, t string")
    got = personal.detect_personal(df, ["t"], "id").groupBy("id").agg(F.count("*").alias("n"), F.max("end").alias("e")).collect()
    assert [(r["id"], r["n"], r["e"]) for r in got] == [(1, 20_000, len(text))]


def test_masks(spark):
    rules = [mask.MaskRule(r"ID-([0-9]+)-([A-Z])", r"<\2\1>"), mask.MaskRule(r"[0-9]{4,}", keep_last=2), mask.MaskRule(r"[A-Z][a-z]+ [A-Z]+"), mask.MaskRule("x", r"\\")]
    apply = lambda t: one(spark, mask.masked(F.col("t"), rules), t=t)
    assert apply("ID-1234-B 12345 Anna BÉ") == "<B1234> ###45 Xxxx XÉ"
    assert apply("nothing") == "nothing" and apply("") == ""
    swapped = [mask.MaskRule("b", "c"), mask.MaskRule("a", "b")]
    assert one(spark, mask.masked(F.col("t"), swapped), t="aabb") == "bbcc"
    overlap = [mask.MaskRule("ab", "1"), mask.MaskRule("abc", "2"), mask.MaskRule("c", "3")]
    assert one(spark, mask.masked(F.col("t"), overlap), t="abcabc") == "1313"
    with pytest.raises(ValueError):
        mask.masked(F.col("t"), [mask.MaskRule("z*")])
    df = spark.createDataFrame([(1, None, "12345")], "id int, t string, u string")
    assert tuple(mask.mask_fields(df, ["t"], rules).first()) == (1, None, "12345")


def test_noise_costs_no_step_for_each_character(spark):
    """Against a plain loop over characters; the plan has no expression that runs for every character."""
    from hashlib import md5

    def plain(text, base, rate):
        limit, n = min(round(rate * 65536), 65535), len(text)
        draws = [int(md5(f"{base}:{i // 8}".encode()).hexdigest()[i % 8 * 4:i % 8 * 4 + 4], 16) for i in range(n)]
        kind = [d % 3 if d < limit else -1 for d in draws] + [-1]
        swaps = [kind[i] == 1 and (i == 0 or kind[i - 1] != 1) and i + 1 < n for i in range(n)]
        return "".join(text[i + 1] if swaps[i] else text[i - 1] if i and swaps[i - 1] else "" if kind[i] == 0
                       else text[i] * 2 if kind[i] == 2 else text[i] for i in range(n))

    texts = ["", "a", "ab", "abcdefgh", "abcdefghi", "é😀ü\n\t x" * 30, "x y" * 99]
    df = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "id long, t string")
    for rate in (0.0, 0.02, 0.4, 1.0):
        noise = vary.add_noise(df, ["t"], "id", rate)
        assert {r.id: r.t for r in noise.collect()} == {
            **{i: plain(t, f"{i}:noise:42:t", rate) for i, t in enumerate(texts)}, len(texts): None}
    assert "lambdafunction" not in noise._jdf.queryExecution().optimizedPlan().toString()
