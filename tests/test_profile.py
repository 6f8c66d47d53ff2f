import pytest
from pyspark.sql import functions as F

from millrace.operators import profile


@pytest.fixture(scope="module")
def drifting(spark):
    lines = ['{"a":"x","b":1,"c":null}', '{"a":"y","b":null,"d":true}', '{"a":"x"}']
    df = spark.createDataFrame(list(enumerate(lines)), "n int, t string")
    return df.select("n", F.parse_json("t").alias("record"))


def test_records(drifting, rows):
    assert rows(profile.profile_records(drifting, "record", "n")) == [
        ("a", 3, 3, 0, "string"), ("b", 3, 2, 2, "number"), ("c", 3, 1, 3, None), ("d", 3, 1, 2, "boolean")]
    assert rows(profile.profile_records(drifting, "record", "n", absent_is_missing=False)) == [
        ("a", 3, 3, 0, "string"), ("b", 3, 2, 1, "number"), ("c", 3, 1, 1, None), ("d", 3, 1, 0, "boolean")]


def test_typed(spark, rows):
    df = spark.sql("SELECT * FROM VALUES ('x', 1D, CAST(NULL AS STRING), array(1)), ('yy', double('NaN'), NULL, NULL), ('x', NULL, NULL, array()) t(a, b, c, d)")
    assert rows(profile.profile(df)) == [
        ("a", 3, 3, 0, "string", 4 / 3), ("b", 3, 1, 2, "number", None), ("c", 3, 0, 3, None, 0.0), ("d", 3, 2, 1, "array", None)]
    assert rows(profile.null_counts(df)) == [("b", 2), ("c", 3), ("d", 1)]
    assert [r.field for r in profile.mean_lengths(df).collect()] == ["a", "c"]
    assert profile.profile(df.filter("false")).count() == 0


def test_top_values(spark, rows):
    df = spark.createDataFrame([(v, "long " * 20 + v) for v in "aabbcdefg"] + [(None, None)], "s string, t string")
    want = [("a", 2, 1), ("b", 2, 2), ("c", 1, 3), ("d", 1, 4), ("e", 1, 5)]
    assert [(r.value, r.n, r["rank"]) for r in profile.top_values(df, ["s"]).orderBy("rank").collect()] == want
    by_digest = profile.top_values(df, ["t"], long_texts=["t"]).orderBy("rank").collect()
    assert [(r.value.split()[-1], r.n, r["rank"]) for r in by_digest] == want
    assert profile.top_values(df, long_texts=["t"]).count() == 10


def test_histogram_edges(spark, rows):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,), (float("nan"),)], "x double")
    got = rows(profile.histogram(df, "x", 5).select("bin", "n"))
    assert got == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 3)]
    assert rows(profile.histogram(spark.sql("SELECT 3 AS x"), "x").select("bin", "n")) == [(0, 1)]
    assert profile.histogram(df.filter("x IS NULL"), "x").count() == 0


def test_dispatch(spark):
    df = spark.sql("SELECT 'a' AS s, 1 AS n, true AS b")
    assert profile.field_distribution(df, "s").columns == ["value", "n"]
    assert profile.field_distribution(df, "n").columns == ["bin", "low", "high", "n"]
    with pytest.raises(ValueError):
        profile.field_distribution(df, "b")


def test_unique_and_patterns(spark, rows):
    df = spark.sql("SELECT * FROM VALUES (1, 'x'), (2, NULL), (2, 'x') t(a, b)")
    assert rows(profile.unique_counts(df)) == rows(profile.unique_counts(df, approximate=True)) == [("a", 2), ("b", 1)]
    assert rows(profile.missing_patterns(df)) == [("", 2), ("b", 1)]


def test_correlation(spark):
    df = spark.range(10).select(F.col("id").alias("a"), (F.col("id") * -2).alias("b"))
    assert profile.correlations(df).first().correlation == pytest.approx(-1.0)


def test_ties_with_one_head_keep_k(spark):
    texts = spark.range(20000).select(F.concat(F.lit("x" * 40), F.col("id").cast("string")).alias("text"))
    assert profile.top_values(texts, ["text"], k=5, long_texts=["text"]).count() == 5


def test_unique_counts_of_all_kinds(spark):
    df = spark.createDataFrame(
        [(1, 0.0, None, [1], "a"), (2, -0.0, None, [1], "b"), (2, float("nan"), None, None, "a" * 9999), (None, float("nan"), None, [2], None)],
        "a int, b double, c string, d array<int>, one string")
    from millrace.operators import profile

    assert {r["field"]: r["unique_count"] for r in profile.unique_counts(df).collect()} == {"a": 2, "b": 2, "c": 0, "d": 2, "one": 3}
    assert {r["unique_count"] for r in profile.unique_counts(df.limit(0)).collect()} == {0}
    near = {r["field"]: r["unique_count"] for r in profile.unique_counts(df, ["a", "one"], approximate=True).collect()}
    assert near == {"a": 2, "one": 3}
