import pytest
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import augment

TEXTS = ["one two three", "one two three four", "a b c d e f g h i j", "x y\u3000z w\tv\nu t s", "", "the end is the end of the world is near"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string")


def copies(df, copy_no=1):
    return {r.k: r.t for r in df.filter(F.col("copy_no") == copy_no).collect()}


def test_counts_and_originals(texts):
    out = augment.augment(texts, "k", 4)
    assert out.count() == 4 * len(TEXTS)
    assert copies(out, 0) == dict(enumerate(TEXTS))
    assert augment.augment(texts, "k", 1).count() == len(TEXTS)
    assert tuple(augment.augment_count(out).first()) == (24, 6, 18)


def test_shuffle_keeps_words(texts):
    free = copies(augment.augment(texts, "k", 2, ["shuffle"], keep_ends=0))
    ends = copies(augment.augment(texts, "k", 2, ["shuffle"]))
    for k, original in enumerate(TEXTS):
        words = original.split()
        if len(words) <= 3:
            assert free[k] == ends[k] == original
            continue
        assert sorted(free[k].split(" ")) == sorted(words)
        if len(words) <= 6:
            assert ends[k] == original
        else:
            got = ends[k].split(" ")
            assert sorted(got) == sorted(words) and got[:2] == words[:2] and got[-2:] == words[-2:]
    assert free[2] != TEXTS[2]


def test_repeatable_on_any_partitioning(texts):
    a = augment.augment(texts.repartition(7), "k", 3, seed=1)
    b = augment.augment(texts.coalesce(1), "k", 3, seed=1)
    assert a.exceptAll(b).count() == 0
    assert augment.augment(texts, "k", 3, ["shuffle"], seed=2).exceptAll(augment.augment(texts, "k", 3, ["shuffle"], seed=1)).count() > 0


def test_template_scope(spark):
    df = spark.sql("SELECT 1 AS k, 'a b c d e f g h' AS question, 'a b c d e f g h' AS other")
    got = augment.augment(df, "k", 2, ["shuffle"], template="qa", keep_ends=0).filter("copy_no = 1").first()
    assert got.other == "a b c d e f g h" and got.question != got.other
    chat = spark.sql("SELECT 1 AS k, array(named_struct('role', 'a b c d e', 'content', 'a b c d e f g h', 'x', 'a b c d e f g')) AS messages")
    got = augment.augment(chat, "k", 2, ["shuffle"], template="chat", keep_ends=0).filter("copy_no = 1").first().messages[0]
    assert got.x == "a b c d e f g" and sorted(got.content.split()) == list("abcdefgh") and got.content != "a b c d e f g h"


def test_synonym_paths_agree(spark, texts, monkeypatch):
    words = {"the": ("this", "that"), "is": ("was",), "end": ("finish",)}
    table = spark.createDataFrame([(w, list(s)) for w, s in words.items()], "word string, synonyms array<string>")
    literal = augment.augment(texts, "k", 9, ["synonym"], thesaurus=words)
    broadcast = augment.augment(texts, "k", 9, ["synonym"], thesaurus=table)
    monkeypatch.setattr(augment, "fits_broadcast", lambda df: False)
    shuffled = augment.augment(texts, "k", 9, ["synonym"], thesaurus=table)
    assert literal.exceptAll(broadcast).count() == 0 and literal.exceptAll(shuffled).count() == 0
    new = {r.t for r in literal.filter("k = 5 AND copy_no > 0").collect()}
    assert len(new) > 1
    allowed = [{w, *words.get(w, ())} for w in TEXTS[5].split()]
    assert all(len(t.split()) == len(allowed) and all(w in a for w, a in zip(t.split(), allowed)) for t in new)


def test_thesaurus_is_cleaned(spark):
    df = spark.createDataFrame([(i, "aa aa aa aa aa aa") for i in range(20)], "k int, t string")
    words = {"aa": ("aa", "b_c", "b_c")}
    table = spark.createDataFrame([("aa", list(words["aa"]))], "word string, synonyms array<string>")
    for thesaurus in (words, table):
        out = augment.augment(df, "k", 2, ["synonym"], thesaurus=thesaurus).filter("copy_no = 1")
        assert {w for r in out.collect() for w in r.t.replace("b c", "b_c").split()} == {"aa", "b_c"}


def test_mixed_methods_with_a_table(spark, texts):
    """Copies that get no synonyms do not take part in the join, and all rows come back."""
    table = spark.createDataFrame([("the", ["this"])], "word string, synonyms array<string>")
    a = augment.augment(texts, "k", 6, thesaurus=table)
    b = augment.augment(texts, "k", 6, thesaurus={"the": ("this",)})
    assert a.count() == 6 * len(TEXTS) and a.exceptAll(b).count() == 0


def test_rephrase(spark, texts):
    got = copies(augment.augment(texts, "k", 2, ["rephrase"]))
    assert got[0] == TEXTS[0] and len(got[1].split()) == 4 and got[1].endswith(".") and got[1][0].isupper()
    long = spark.createDataFrame([(i, "w " * 11) for i in range(30)], "k int, t string")
    sentences = {r.t.count(".") for r in augment.augment(long, "k", 2, ["rephrase"]).filter("copy_no = 1").collect()}
    assert sentences == {1, 2, 3}
    half = augment.augment(long, "k", 2, ["rephrase"], rephrase_chance=0.5).filter("copy_no = 1")
    assert 0 < half.filter(F.col("t") == "w " * 11).count() < 30
    assert copies(augment.augment(texts, "k", 2, ["rephrase"], rephrase_min_chars=500))[2] == TEXTS[2]


def test_errors(texts):
    for methods in ([], ["nope"]):
        with pytest.raises(ValueError):
            augment.augment(texts, "k", 2, methods)


def test_white_space_is_that_of_python(spark):
    every = [chr(c) for c in range(0x3100) if chr(c).isspace()] + ["\u200b", "\ufeff", "a"]
    df = spark.createDataFrame([(i, f"{c}l{c}r{c}") for i, c in enumerate(every)], "i int, t string")
    got = df.select("i", tx.tokens(F.col("t")).alias("w"), tx.strip(F.col("t")).alias("s"), tx.is_blank(F.substring("t", 1, 1)).alias("b")).collect()
    for r in got:
        c = every[r.i]
        assert r.w == f"{c}l{c}r{c}".split() and r.s == f"{c}l{c}r{c}".strip() and r.b == c.isspace(), hex(ord(c))


def test_long_mapping_equals_the_table(spark, rows):
    words = {f"w{i}": [f"s{i}", f"t{i}"] for i in range(2000)}
    texts = spark.range(50).select("id", F.expr("array_join(transform(sequence(1, 40), i -> concat('w', (id * 37 + i * 53) % 2000)), ' ')").alias("text"))
    table = spark.createDataFrame(list(words.items()), "word string, synonyms array<string>")
    by_mapping = rows(augment.augment(texts, "id", 3, ["synonym"], thesaurus=words))
    assert by_mapping == rows(augment.augment(texts, "id", 3, ["synonym"], thesaurus=table))
    assert any("s" in r[1] for r in by_mapping)
    assert augment.augment(texts, "id", 2, ["shuffle"], thesaurus=words).count() == 100


def test_words_are_cut_without_a_pattern(spark):
    """The words of Python's ``str.split``, for every white-space character, by one plain cut."""
    odd = [chr(c) for c in (*range(1, 33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    rows = ["", " ", "a", "  a  b ", "é😀\r\n\tü", "".join(f"x{c}y{c}{c}" for c in odd), "".join(odd), *[f"a{c}b" for c in odd]]
    df = spark.createDataFrame([*enumerate(rows), (len(rows), None)], "k int, t string").select("k", tx.tokens(F.col("t")).alias("w"))
    assert {r.k: r.w for r in df.collect()} == {**{k: t.split() for k, t in enumerate(rows)}, len(rows): None}
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_shuffled_columns_equal_the_expression(spark, texts):
    """Text columns are shuffled in batches, by the order that the expression gives, without carrying their words."""
    rows = texts.unionByName(spark.sql("SELECT 90 AS k, concat_ws('  ', transform(sequence(1, 300), i -> concat('w', i % 7))) AS t UNION ALL SELECT 91, NULL"))
    for ends in (0, 1, 2):
        out = augment.augment(rows, "k", 3, ["shuffle"], keep_ends=ends)
        base = F.concat_ws(":", "k", F.lit("shuffle"), F.lit("42"), "copy_no", F.lit("t"))
        want = rows.crossJoin(spark.range(3).selectExpr("CAST(id AS int) AS copy_no")).select("k", "copy_no", F.when(
            (F.col("copy_no") > 0) & (F.size(tx.tokens(F.col("t"))) > 3), augment.shuffle_words(F.col("t"), base, ends)).otherwise(F.col("t")).alias("t"))
        assert sorted(map(tuple, out.select("k", "copy_no", "t").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "sort_array" not in plan and "_words_" not in plan
