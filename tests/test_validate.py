import pytest
from pyspark.sql import functions as F

from millrace.operators import duplicates, rules, validate


def records(spark, *lines):
    df = spark.createDataFrame(list(enumerate(lines, 1)), "n int, t string")
    return df.select("n", F.parse_json("t").alias("record"))


def test_duplicates_and_drift(spark, rows):
    df = records(spark, '{"a":1,"b":"x"}', '{"b":"x","a":1}', '{"a":1}', '{"a":1,"b":"x"}')
    assert rows(validate.validate_records(df, "record", "n")) == [
        (2, "Duplicate record found."), (3, "Inconsistent set of fields compared to the first row."), (4, "Duplicate record found.")]


def test_empty(spark, rows):
    assert rows(validate.validate_records(records(spark, "{}").filter("false"), "record", "n")) == [
        (None, "Dataset is empty. Nothing to validate.")]


def test_nested_duplicates(spark):
    df = records(spark, '{"a":[1]}', '{"a":[1]}', '{"a":[1,2]}')
    assert validate.validate_records(df, "record", "n").count() == 1


def test_typed_duplicates_keep_precision_and_nulls(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, timestamp '2024-01-01 00:00:00.000001', NULL), (2, timestamp '2024-01-01 00:00:00.000002', NULL),
                      (3, timestamp '2024-01-01 00:00:00.000001', NULL), (4, timestamp '2024-01-01 00:00:00.000001', 'null') t(k, ts, s)""")
    assert [r.k for r in duplicates.drop_duplicates(df, None, "k").orderBy("k").collect()] == [1, 2, 4]
    assert [r.k for r in duplicates.mark_duplicates(df, None, "k").filter("is_duplicate").collect()] == [3]
    assert tuple(duplicates.duplicate_count(df, None, "k").first()) == (4, 3, 1)


def test_hot_record_is_one_row_per_task(spark):
    """A record that makes up most of the table never forms a group of its rows."""
    df = spark.range(0, 20000, 1, 16).select("id", F.when(F.col("id") % 10 < 9, "same").otherwise(F.col("id").cast("string")).alias("t"))
    marked = duplicates.mark_duplicates(df, ["t"], "id")
    assert marked.filter("is_duplicate").count() == 17999
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min" in plan


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame([(1, "abc", 5), (2, "", -1), (3, None, None), (4, "  ", 12)], "k int, s string, n int")


@pytest.mark.parametrize("rule, want", [
    ({"field": "s", "type": "Required"}, [2, 3, 4]),
    ({"field": "s", "type": "Regex Match", "value": "^[a-z]+$"}, [2, 4]),
    ({"field": "s", "type": "Min Length", "value": "2"}, [2]),
    ({"field": "s", "type": "Max Length", "value": "2"}, [1]),
    ({"field": "n", "type": "Min Value", "value": "0"}, [2]),
    ({"field": "n", "type": "Max Value", "value": "10"}, [4]),
    ({"field": "ALL_FIELDS", "type": "Required"}, [2, 3, 3, 4]),
    ({"field": "s", "type": "Type Check", "value": "number"}, [1, 2, 4]),
    ({"field": "n", "type": "Type Check", "value": "number"}, []),
    ({"field": "n", "type": "Custom Python", "value": "x > 0"}, [2]),
    ({"field": "n", "type": "Custom Python", "value": lambda x: x > 0}, [2]),
])
def test_rules(sample, rule, want):
    assert sorted(r.row_key for r in rules.violations(sample, [rule], "k").collect()) == want


def test_type_check_on_variant(spark):
    df = records(spark, '"t"', "1", "1.5", "true", "[1]", '{"a":1}', "null")
    for label, ok in {"string": [1], "number": [2, 3], "boolean": [4], "list": [5], "dict": [6]}.items():
        broken = rules.violations(df, [{"field": "record", "type": "Type Check", "value": label}], "n")
        assert sorted(r.row_key for r in broken.collect()) == [n for n in range(1, 7) if n not in ok]


def test_rule_errors(sample):
    for rule in ({"field": "s", "type": "Nope"}, {"field": "zz", "type": "Required"},
                 {"field": "s", "type": "Type Check", "value": "str"},
                 {"field": "n", "type": "Custom Python", "value": "lambda x: x > 0"}):
        with pytest.raises(ValueError):
            rules.violations(sample, [rule], "k")


def test_rules_saved(spark, tmp_path):
    some = [{"field": "s", "type": "Required", "value": None}, {"field": "n", "type": "Min Value", "value": "0"}]
    rules.save_rules(spark, some, str(tmp_path / "rules"))
    assert sorted(rules.load_rules(spark, str(tmp_path / "rules")), key=repr) == sorted(some, key=repr)
    with pytest.raises(ValueError):
        rules.save_rules(spark, [{"field": "n", "type": "Custom Python", "value": abs}], str(tmp_path / "x"))


def test_types(spark, rows):
    df = records(spark, '{"a":1,"b":1}', '{"a":2,"b":"x"}', '{"a":null,"b":2}', '{"b":"y","a":3.5}', '{"b":7}')
    assert rows(validate.type_counts(df, "record", "n")) == [("a", "number", 3, 1), ("b", "number", 3, 2), ("b", "string", 2, 2)]
    assert rows(validate.type_conflicts(df, "record", "n")) == [(2, "b", "string", '"x"'), (4, "b", "string", '"y"')]


def test_not_objects(spark, rows):
    df = records(spark, '{"a":1}', "[1]", "null", "3")
    assert rows(validate.not_objects(df, "record", "n")) == [(2, "array"), (3, None), (4, "number")]


def test_report(spark, sample):
    report = validate.validation_report(
        sample, "k", ("missing", "duplicates", "rules", "template"), [{"field": "n", "type": "Min Value", "value": "0"}], {"s": ""})
    got = {(r.field, r.rule): r.n for r in validate.summarize(report).collect()}
    assert got == {("s", "missing"): 3, ("n", "missing"): 1, ("n", "Min Value"): 1, ("s", "template"): 3}
    with pytest.raises(ValueError):
        validate.validation_report(sample, "k", ("nope",))
    with pytest.raises(ValueError):
        validate.validation_report(sample, "k", ("types",))


def test_report_looks_into_records(spark, rows):
    df = spark.createDataFrame(
        [(1, "x", '{"a": 1, "b": "v"}'), (2, "x", '{"b": "v", "a": 1}'), (3, "x", '{"a": 2, "b": " "}'), (4, "x", '{"a": null, "b": "v"}'),
         (5, "y", '{"a": 1, "b": "v"}')],
        "k int, kind string, j string").select("k", "kind", F.parse_json("j").alias("record"))
    report = validate.validation_report(df, "k", ("missing", "duplicates"), record="record")
    assert rows(report.select("row_key", "field", "rule")) == [(2, None, "duplicate"), (3, "b", "missing"), (4, "a", "missing")]
