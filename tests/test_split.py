import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import edit, split


@pytest.mark.parametrize("n, want", [
    (10, (8, 1, 1)), (15, (12, 1, 2)), (87, (69, 9, 9)), (399, (319, 40, 40)), (1000, (800, 100, 100)), (60000, (48000, 6000, 6000))])
def test_sizes(n, want):
    assert split.split_sizes(n) == want


def test_ratio_cases():
    assert split.split_sizes(10, (1.0, 0.0, 0.0)) == (10, 0, 0)
    assert split.split_sizes(10, (0.8, 0.2, 0.0)) == (8, 2, 0)
    assert split.split_sizes(10, (0.8, 0.0, 0.2)) == (8, 0, 2)
    with pytest.warns(UserWarning):
        assert split.split_sizes(10, (8, 1, 1)) == (8, 1, 1)
    for bad in ((0, 0, 0), (-1, 1, 1)):
        with pytest.raises(ValueError):
            split.split_sizes(10, bad)


@settings(max_examples=200)
@given(st.integers(1, 10 ** 6), st.integers(1, 98), st.data())
def test_sizes_add_up(n, train, data):
    valid = data.draw(st.integers(0, 100 - train))
    ratios = (train / 100, valid / 100, (100 - train - valid) / 100)
    sizes = split.split_sizes(n, ratios)
    assert sum(sizes) == n and min(sizes) >= 0 and abs(sizes[0] - n * ratios[0]) <= 1 + 1e-6 * n
    assert math.isclose(sum(ratios), 1.0)


@pytest.mark.parametrize("n, ratios", [(1, (0.8, 0.1, 0.1)), (7, (0.5, 0.3, 0.2)), (1000, (0.8, 0.1, 0.1)), (777, (0.6, 0.4, 0.0)), (50, (1.0, 0.0, 0.0))])
def test_exact(spark, n, ratios):
    df = spark.range(n)
    parts = split.split_dataset(df, "id", ratios)
    got = {r.split: r.n for r in split.split_counts(parts).collect()}
    assert tuple(got.get(s, 0) for s in ("train", "valid", "test")) == split.split_sizes(n, ratios)
    assert parts.select("id").exceptAll(df).count() == 0 and parts.count() == n


def test_seed_and_partitioning(spark):
    df = spark.range(500)
    a = split.split_dataset(df, "id", seed=1)
    assert a.exceptAll(split.split_dataset(df.repartition(13), "id", seed=1)).count() == 0
    assert a.exceptAll(split.split_dataset(df, "id", seed=2)).count() > 0


def test_split_is_a_projection(spark):
    plan = split.split_dataset(spark.range(100), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_shared_keys_stay_together(spark):
    """A key that holds a third of the rows goes to one part and breaks nothing."""
    df = spark.range(900).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id")).alias("k"))
    parts = split.split_dataset(df, "k")
    assert parts.filter("k = 0").select("split").distinct().count() == 1
    assert parts.count() == 900


def test_empty(spark):
    with pytest.raises(ValueError):
        split.split_dataset(spark.range(0), "id")


def test_approximate(spark):
    got = {r.split: r.n for r in split.split_counts(split.split_dataset(spark.range(20000), "id", exact=False)).collect()}
    assert abs(got["train"] - 16000) < 400 and abs(got["test"] - 2000) < 200


def test_row_numbers(spark):
    df = spark.range(0, 5000, 1, 9).select((F.col("id") * 7 % 5000).alias("k"))
    got = edit.row_numbers(df, "k").collect()
    assert all(r.row_number == r.k + 1 for r in got) and len(got) == 5000
    words = spark.createDataFrame([(w,) for w in "d a c b".split()], "w string")
    assert {r.w: r.row_number for r in edit.row_numbers(words, "w").collect()} == {"a": 1, "b": 2, "c": 3, "d": 4}


def test_edit(spark, rows):
    df = spark.createDataFrame([(1, "Alpha", 1.5), (2, "beta", None), (3, None, 3.0)], "k int, s string, x double")
    assert [r.k for r in edit.search(df, "ALPH").collect()] == [1] and [r.k for r in edit.search(df, "3").collect()] == [3]
    assert rows(edit.delete_records(df, spark.createDataFrame([(2,), (9,)], "k int"), "k").select("k")) == [(1,), (3,)]
    patches = spark.createDataFrame([(1, "s", "A", 1), (1, "s", "B", 2), (2, "x", "7", 1), (3, "x", None, 1), (8, "s", "q", 1)],
                                    "k int, field string, value string, edit_no int")
    assert rows(edit.patch_cells(df, patches, "k")) == [(1, "B", 1.5), (2, "beta", 7.0), (3, None, None)]
    assert rows(edit.append_record(df, {"k": 4}))[-1] == (4, "", None)
    assert edit.append_record(None, {}, spark).first().asDict() == {"prompt": "", "completion": ""}
    assert rows(edit.bulk_edit(df, F.col("k") > 1, {"s": F.lit("z")}).select("s")) == [("Alpha",), ("z",), ("z",)]
    with pytest.raises(ValueError):
        edit.append_record(df, {"nope": 1})
