import re
import uuid

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from millrace.functions import providers
from millrace.operators import anonymize, generate


def test_detection(spark, folder):
    want = {
        "documents": {"doc_id": "id"}, "labels": {"doc_id": "id"}, "conversations": {"conv_id": "id"},
        "events": {"event_id": "id", "user_id": "name"}, "pages": {"page_id": "id"}, "benchmark": {"item_id": "id"},
        "embeddings": {"vec_id": "id"}, "customer": {"c_name": "name"}, "supplier": {"s_name": "name"},
        "part": {"p_name": "name"}, "nation": {"n_name": "name"}, "region": {"r_name": "name"}, "orders": {}, "lineitem": {}}
    for table, found in want.items():
        assert anonymize.detect_sensitive(spark.read.parquet(f"{folder}/{table}.parquet").columns) == found
    assert anonymize.detect_sensitive(["E-Mail", "Mobile", "zip", "ip", "SSN", "card_no", "dob", "x"]) == {
        "E-Mail": "email", "Mobile": "phone", "zip": "address", "ip": "ip", "SSN": "ssn", "card_no": "credit_card", "dob": "dob"}


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(i, None if i == 3 else "" if i == 4 else f"n{i % 2}", i) for i in range(8)], "k int, name string, age int")


def test_nulls_and_rows_stay(people):
    out = anonymize.anonymize(people, "k", {"name": "name", "age": "pyint"})
    got = {r.k: r for r in out.collect()}
    assert len(got) == 8 and got[3].name is None and got[4].name != "" and dict(out.dtypes) == {"k": "int", "name": "string", "age": "string"}
    kept = {r.k: r.name for r in anonymize.anonymize(people, "k", {"name": "name"}, skip_empty=True).collect()}
    assert kept[4] == "" and kept[3] is None


def test_modes(people):
    drawn = [r.name for r in anonymize.anonymize(people, "k", {"name": "uuid4"}).collect() if r.name]
    assert len(set(drawn)) == len(drawn)
    same = {(r.k % 2, r.name) for r in anonymize.anonymize(people, "k", {"name": "uuid4"}, mode="consistent", secret="s").collect() if r.k not in (3, 4)}
    assert len(same) == 2


@pytest.mark.parametrize("kind", ["name", "email", "phone", "id"])
def test_consistent_values_stay_distinct(spark, kind):
    many = spark.range(20000).select("id", F.col("id").cast("string").alias("v"))
    out = anonymize.anonymize(many, "id", {"v": kind}, mode="consistent", secret="s")
    assert out.select("v").distinct().count() == 20000
    assert kind != "email" or out.filter("v rlike '^[^@]+@[^@]+$'").count() == 20000


def test_consistent_needs_a_secret(people):
    with pytest.raises(ValueError):
        anonymize.anonymize(people, "k", {"name": "name"}, mode="consistent")


def test_unknown(people):
    with pytest.warns(UserWarning):
        kept = anonymize.anonymize(people, "k", {"name": "no_such"})
    assert kept.exceptAll(people).count() == 0
    assert {r.name for r in anonymize.anonymize(people, "k", {"name": "no_such"}, on_unknown="constant").collect()} == {"ANONYMIZED_name", None}
    with pytest.warns(UserWarning):
        assert anonymize.anonymize(people.select("k", "age"), "k") is not None


def test_counts(people, rows):
    seen = Observation("anonymized")
    anonymize.anonymize(people, "k", {"name": "name", "age": "pyint"}, skip_empty=True, observation=seen).collect()
    assert seen.get["anonymized"] == 14
    assert rows(anonymize.sensitive_report(people)) == [("name", "name", 7)]


def test_every_provider_makes_text(spark):
    made = spark.range(40).select(*[providers.provider(n)(F.concat(F.lit("s:"), "id")).alias(n) for n in providers.provider_names()])
    for row in made.collect():
        assert all(isinstance(v, str) and v for v in row)


def test_shapes(spark):
    shapes = {
        "email": r"[a-z]+\.[a-z]+\d\d@example\.(com|org|net)", "phone": r"\(\d{3}\) 555-\d{4}", "ssn": r"\d{3}-\d\d-\d{4}",
        "dob": r"\d{4}-\d\d-\d\d", "ip": r"\d+(\.\d+){3}", "credit_card": r"4\d{15}", "name": r"\w+ \w+", "hex_color": "#[0-9a-f]{6}",
        "mac_address": r"([0-9a-f]{2}:){5}[0-9a-f]{2}"}
    made = spark.range(200).select("id", *[providers.provider(n)(F.concat(F.lit("s:"), "id")).alias(n) for n in shapes],
                                   providers.provider("id")(F.col("id").cast("string")).alias("u"))
    for row in made.collect():
        for name, shape in shapes.items():
            assert re.fullmatch(shape, row[name]), (name, row[name])
        assert uuid.UUID(row["u"]).version == 4
        assert all(int(p) <= 255 for p in row["ip"].split("."))
        digits = [int(c) for c in row["credit_card"]][::-1]
        assert sum(digits[::2]) % 10 == -sum(sum(divmod(2 * d, 10)) for d in digits[1::2]) % 10


def test_generate(spark):
    made = generate.generate(spark, "chat", 20, providers={"messages[*].content": "email"})
    assert made.count() == 20 and made.first().messages[0].role == "user" and "@" in made.first().messages[1].content
    assert generate.generate(spark, "qa", 5, auto=False).first().question == ""
    assert generate.generate(spark, "qa", 5).exceptAll(generate.generate(spark, "qa", 5)).count() == 0
    assert generate.generate(spark, "qa", 5, seed=1).exceptAll(generate.generate(spark, "qa", 5)).count() == 5
    for bad in (lambda: generate.generate(spark, "qa", 0), lambda: generate.generate(spark, "custom", 5),
                lambda: generate.generate(spark, "qa", 5, providers={"nope": "email"})):
        with pytest.raises(ValueError):
            bad()
