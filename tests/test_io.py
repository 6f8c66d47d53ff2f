import json
import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from millrace.sources import convert, infer_format, read, read_records, read_texts, write, write_auto, write_splits
from millrace.streaming import convert_stream, drop_repeated


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def values(df):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in df.collect())


def test_infer():
    assert [infer_format(p) for p in ("a.json", "b.JSONL", "c.yml", "d.db", "e.tsv")] == ["json", "jsonl", "yaml", "sqlite", "tsv"]
    for bad in ("x.docx", "noext"):
        with pytest.raises(ValueError):
            infer_format(bad)


def test_json_shapes(spark, tmp_path):
    assert read(spark, put(tmp_path / "a.json", '[{"a":1,"b":null},{"a":2,"c":{"d":[1,2]}}]')).count() == 2
    assert values(read(spark, put(tmp_path / "b.json", '{"data":[{"a":1},{"a":2}]}'))) == ['{"a": 1}', '{"a": 2}']
    assert values(read(spark, put(tmp_path / "c.json", '{"a":1}'))) == ['{"a": 1}']
    assert values(read(spark, put(tmp_path / "d.json", '{"data":5}'))) == ['{"data": 5}']
    for name, n in (("a.json", 2), ("b.json", 2), ("c.json", 1)):
        assert read_records(spark, str(tmp_path / name)).count() == n


def test_jsonl(spark, tmp_path):
    path = put(tmp_path / "a.jsonl", '{"a":1}\n\n{"a":2}\n')
    seen = Observation("load")
    assert values(read(spark, path, observation=seen)) == ['{"a": 1}', '{"a": 2}'] and seen.get["records"] == 2
    assert read_records(spark, path).count() == 2
    with pytest.raises(Exception):
        read(spark, put(tmp_path / "bad.jsonl", '{"a":1}\n{"a":\n')).collect()


@pytest.mark.parametrize("text", ['{"a":1}}', '{"a":1} x', '{"a":1}{"a":2}', '{"a":1},{"a":2}', '{"a":1', '[{"a":1}]\n{"a":2}'])
def test_nothing_is_lost_after_a_record(spark, tmp_path, text):
    line = put(tmp_path / "a.jsonl", text.replace("\n", "") + "\n")
    whole = put(tmp_path / "b.json", text)
    for load in (lambda: read(spark, line).collect(), lambda: read_records(spark, line).collect(),
                 lambda: read(spark, whole).collect(), lambda: read_records(spark, whole).collect()):
        with pytest.raises(Exception, match="(?i)malformed"):
            load()


def test_csv(spark, tmp_path):
    path = put(tmp_path / "a.csv", 'a,b,c,d,e\n1,x,1.5,True,"two\nlines"\n2,,NaN,False,"say ""hi"""\n3,N/A,2,,plain\n')
    got = read(spark, path)
    assert dict(got.dtypes) == {"a": "bigint", "b": "string", "c": "double", "d": "boolean", "e": "string"}
    assert [tuple(r) for r in got.orderBy("a").collect()] == [
        (1, "x", 1.5, True, "two\nlines"), (2, None, None, False, 'say "hi"'), (3, None, 2.0, None, "plain")]
    typed = read(spark, path, schema="a int, b string, c double, d boolean, e string")
    assert typed.count() == 3 and typed.schema["a"].dataType.simpleString() == "int"
    assert read(spark, put(tmp_path / "b.tsv", "a\tb\n1\t2,3\n")).first().b == "2,3"


def test_csv_numbers(spark, tmp_path):
    path = put(tmp_path / "n.csv", "a,b,c,d,e\n9223372036854775807,92233720368547758070, 7,1e3,1d\n-1,1,08,inf,2\n")
    got = read(spark, path)
    assert [t for _, t in got.dtypes] == ["bigint", "string", "bigint", "double", "string"]
    assert tuple(got.first()) == (9223372036854775807, "92233720368547758070", 7, 1000.0, "1d")


def test_csv_row_lengths(spark, tmp_path):
    short = put(tmp_path / "short.csv", 'a,b,c\n1,2,3\n4\n5,"x\ny"\n')
    assert [tuple(r) for r in read(spark, short).orderBy("a").collect()] == [(1, "2", 3), (4, None, None), (5, "x\ny", None)]
    long = put(tmp_path / "long.csv", "a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="surplus"):
        read(spark, long).collect()
    assert read(spark, long, mode="PERMISSIVE").count() == 2


def test_csv_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.csv", 'a,b\n1,"x\ny"\nNA,N/A\n')
    convert_stream(spark, str(tmp_path / "in"), "csv", str(tmp_path / "out"), "parquet", str(tmp_path / "cp"),
                   schema="a int, b string").awaitTermination()
    assert values(read(spark, str(tmp_path / "out"), "parquet")) == ['{"a": 1, "b": "x\\ny"}', '{"a": null, "b": null}']


def test_txt(spark, tmp_path):
    assert values(read(spark, put(tmp_path / "a.txt", "  hi \n\n b\n \n"))) == ['{"text": "b"}', '{"text": "hi"}']


def test_xml(spark, tmp_path):
    path = put(tmp_path / "a.xml", '<dataset><record id="1"><q>x</q><t>a</t><t>b</t></record><record id="2"><q>y</q><t>c</t></record></dataset>')
    got = {r["@id"]: r for r in read(spark, path).collect()}
    assert got[1].q == "x" and got[1].t == ["a", "b"] and got[2].t == ["c"]
    lone = put(tmp_path / "b.xml", '<item id="7">text</item>')
    assert read(spark, lone, row_tag="item").first().asDict() == {"#text": "text", "@id": 7}
    assert read(spark, lone).first().asDict() == {"#text": "text", "@id": 7}
    other = put(tmp_path / "c.xml", '<all><item><q>1</q></item><extra><q>2</q><w>3</w></extra></all>')
    assert values(read(spark, other)) == ['{"q": 1, "w": null}', '{"q": 2, "w": 3}']
    assert read(spark, put(tmp_path / "d.xml", "<dataset/>")).count() == 0


def test_file_tree(spark, tmp_path):
    from millrace.operators import textscan

    (tmp_path / "sub").mkdir()
    put(tmp_path / "a.py", "\ufeffok\nan error \n")
    put(tmp_path / "sub" / "b.md", "x\r\ny")
    put(tmp_path / "sub" / "c.log", "error\n")
    files = read_texts(spark, str(tmp_path), [".py", "md"])
    got = {r.path.split("/")[-1]: r for r in textscan.hygiene(files, "path", "text").collect()}
    assert set(got) == {"a.py", "b.md"}
    assert got["a.py"].byte_order_mark and got["a.py"].trailing_space and got["a.py"].issues == 2
    assert got["b.md"].no_final_newline and got["b.md"].issues == 1
    assert textscan.keyword_scan(read_texts(spark, str(tmp_path)), "path", "text").count() == 2
    assert read_texts(spark, str(tmp_path), recurse=False).count() == 1


def test_yaml(spark, tmp_path):
    for name, text, n in (("a", "data:\n- {a: 1}\n- {a: 2}\n", 2), ("b", "- {a: 1}\n- {a: x, b: [1, 2]}\n", 2), ("c", "a: 1\n", 1), ("d", "", 0)):
        path = put(tmp_path / f"{name}.yaml", text)
        assert read_records(spark, path).count() == n
        if n:
            assert read(spark, path).count() == n


def test_missing(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read(spark, str(tmp_path / "none.parquet"))
    with pytest.raises(ValueError):
        read(spark, "x", "excel")


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.sql("""SELECT * FROM VALUES (1, 'é "q", x', 1.5D, array('a', 'b'), named_struct('k', 'v')),
                        (2, 'two\nlines', NULL, NULL, NULL), (3, NULL, 2.0D, array(), named_struct('k', NULL)) t(i, s, x, l, o)""")


@pytest.mark.parametrize("fmt", ["json", "jsonl", "parquet", "yaml"])
def test_round_trip(spark, mixed, tmp_path, fmt):
    path = str(tmp_path / "out")
    write(mixed.repartition(2), path, fmt)
    back = read(spark, path, fmt)
    assert values(back.select("i", "s", "x", "l", "o")) == values(mixed)


def test_json_parts_are_arrays(spark, mixed, tmp_path):
    write(mixed.repartition(2), str(tmp_path / "out"), "json")
    parts = [p for p in os.listdir(tmp_path / "out") if p.startswith("part-")]
    loaded = [r for p in parts for r in json.loads((tmp_path / "out" / p).read_text(encoding="utf-8"))]
    assert len(loaded) == 3 and all(set(r) == {"i", "s", "x", "l", "o"} for r in loaded)


@pytest.mark.parametrize("fmt", ["csv", "tsv"])
def test_flat_formats(spark, mixed, tmp_path, fmt):
    write(mixed, str(tmp_path / "out"), fmt)
    back = {r.i: r for r in read(spark, str(tmp_path / "out"), fmt).collect()}
    assert back[1].s == 'é "q", x' and back[2].s == "two\nlines" and json.loads(back[1].l) == ["a", "b"] and back[1].o == '{"k":"v"}'


def test_xml_items(spark, mixed, tmp_path):
    write(mixed.coalesce(1), str(tmp_path / "out"), "xml")
    text = "".join((tmp_path / "out" / p).read_text(encoding="utf-8") for p in os.listdir(tmp_path / "out") if p.startswith("part-"))
    assert "<dataset>" in text and "<item>a</item>" in text and "<k>v</k>" in text
    assert read(spark, str(tmp_path / "out"), "xml").count() == 3


def test_txt_sink(spark, mixed, tmp_path):
    write(mixed.select("i", "x"), str(tmp_path / "out"), "txt")
    back = [json.loads(r.text) for r in read(spark, str(tmp_path / "out"), "txt").collect()]
    assert {"i": 2, "x": None} in back and len(back) == 3


def test_modes_and_auto(spark, mixed, tmp_path):
    path = str(tmp_path / "out.jsonl")
    write_auto(mixed, path)
    write_auto(mixed, path, "append")
    assert read(spark, path).count() == 6
    write_auto(mixed, path, "overwrite")
    assert read(spark, path).count() == 3
    with pytest.raises(Exception):
        write_auto(mixed, path)
    with pytest.warns(UserWarning):
        write_auto(mixed, str(tmp_path / "x.odd"))
    assert read(spark, str(tmp_path / "x.odd"), "jsonl").count() == 3
    with pytest.raises(ValueError, match="No data"):
        write(mixed.filter("false"), str(tmp_path / "e"), "json", check_empty=True)
    with pytest.raises(ValueError):
        write(mixed, str(tmp_path / "e"), "excel")


def test_convert(spark, tmp_path):
    convert(spark, put(tmp_path / "a.csv", "a,b\n1,x\n2,y\n"), str(tmp_path / "o.yaml"))
    convert(spark, str(tmp_path / "o.yaml"), str(tmp_path / "o.xml"))
    convert(spark, str(tmp_path / "o.xml"), str(tmp_path / "o.json"))
    assert values(read(spark, str(tmp_path / "o.json"))) == ['{"a": 1, "b": "x"}', '{"a": 2, "b": "y"}']


def test_splits(spark, tmp_path):
    write_splits(spark.range(10).withColumn("split", F.when(F.col("id") < 8, "train").otherwise("test")), str(tmp_path / "s"), "jsonl")
    assert sorted(p for p in os.listdir(tmp_path / "s") if p.startswith("split=")) == ["split=test", "split=train"]


@pytest.mark.parametrize("fmt", ["json", "yaml", "xml", "csv", "tsv", "txt", "parquet"])
def test_splits_in_every_format(spark, tmp_path, fmt):
    parts = spark.range(10).withColumn("split", F.when(F.col("id") < 7, "train").when(F.col("id") < 9, "test"))
    write_splits(parts, str(tmp_path / "s"), fmt)
    assert sorted(p for p in os.listdir(tmp_path / "s") if p.startswith("split=")) == ["split=test", "split=train"]
    counts = [read(spark, str(tmp_path / "s" / f"split={name}"), fmt).count() for name in ("train", "test")]
    assert counts == [7, 2]
    with pytest.raises(Exception):
        write_splits(parts, str(tmp_path / "s"), fmt)
    write_splits(parts.filter("id < 8"), str(tmp_path / "s"), fmt, "overwrite")
    assert read(spark, str(tmp_path / "s" / "split=test"), fmt).count() == 1


def test_gated_formats_say_what_they_need(spark, mixed, tmp_path):
    with pytest.raises(RuntimeError, match="spark-avro"):
        read(spark, str(tmp_path), "avro")
    with pytest.raises(RuntimeError, match="spark-avro"):
        write(mixed, str(tmp_path / "a"), "avro")
    with pytest.raises(RuntimeError, match="JDBC"):
        read(spark, str(tmp_path / "x.db"))
    with pytest.raises(RuntimeError, match="JDBC"):
        write(mixed, str(tmp_path / "x.db"), "sqlite")


def test_stream_convert(spark, folder, tmp_path):
    """New files only, the same result as in batch."""
    from millrace.operators import anonymize, project, rules

    source = tmp_path / "in"
    events = spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("string"))
    write(events.filter("event_id < 400"), str(source), "jsonl", "append")

    def prepare(df):
        hidden = anonymize.anonymize(df, "event_id", {"user_id": "uuid4"})
        return project.map_to_template(hidden, "qa", {"question": "user_id", "answer": "event_type"}, keep=["event_id"])

    def run():
        convert_stream(spark, str(source), "jsonl", str(tmp_path / "out"), "parquet", str(tmp_path / "cp"),
                       prepare, events.schema).awaitTermination()
        return read(spark, str(tmp_path / "out"), "parquet")

    assert run().count() == 400
    write(events.filter("event_id >= 400"), str(source), "jsonl", "append")
    assert values(run()) == values(prepare(events))

    broken = lambda df: rules.violations(df, [{"field": "event_type", "type": "Regex Match", "value": "^view$"}], "event_id")
    convert_stream(spark, str(source), "jsonl", str(tmp_path / "bad"), "jsonl", str(tmp_path / "cp2"), broken, events.schema).awaitTermination()
    assert read(spark, str(tmp_path / "bad"), "jsonl").count() == broken(events).count()


def test_stream_duplicates(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet").select("ts", "user_id", "event_type")
    write(events, str(tmp_path / "in"), "parquet")
    convert_stream(spark, str(tmp_path / "in"), "parquet", str(tmp_path / "out"), "parquet", str(tmp_path / "cp"),
                   lambda df: drop_repeated(df, ["user_id", "event_type"], "ts", "3650 days"), events.schema).awaitTermination()
    assert read(spark, str(tmp_path / "out"), "parquet").count() == events.select("user_id", "event_type").distinct().count()


def test_json_data_field_of_a_record_is_kept(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id":1,"data":[{"a":1},{"a":2}]},{"id":2,"data":[{"a":3}]},{"id":3,"data":[]}]')
    df = read(spark, str(tmp_path / "a.json"))
    assert sorted((r["id"], len(r["data"])) for r in df.collect()) == [(1, 2), (2, 1), (3, 0)]
    (tmp_path / "b.json").write_text('{"data":[{"a":1},{"a":2}]}')
    assert sorted(r["a"] for r in read(spark, str(tmp_path / "b.json")).collect()) == [1, 2]


def test_csv_headers_that_differ(spark, tmp_path, rows):
    (tmp_path / "a b.csv").write_text("x,y\n1,one\n2,two\n")
    (tmp_path / "c.csv").write_text("y,x\nthree,3\n")
    (tmp_path / "d.csv").write_text("x,z\n4,q\n")
    with pytest.raises(Exception, match="(?i)header"):
        read(spark, str(tmp_path), "csv").collect()
    got = read(spark, str(tmp_path), "csv", by_name=True).select("x", "y", "z")
    assert rows(got) == [(1, "one", None), (2, "two", None), (3, "three", None), (4, None, "q")]


def test_json_records_keep_their_data_field(spark, tmp_path, rows):
    (tmp_path / "a.json").write_text('[{"id":1,"data":[{"a":1},{"a":2}]},{"id":2,"data":[{"a":3}]},{"id":3,"data":[]}]')
    assert rows(read(spark, str(tmp_path / "a.json")).selectExpr("id", "size(data)")) == [(1, 2), (2, 1), (3, 0)]


@pytest.mark.parametrize("fmt", ["json", "yaml"])
def test_documents_are_bounded(spark, tmp_path, monkeypatch, fmt):
    """One task with more than a document's worth writes several whole documents; none is lost or cut."""
    from millrace.sources import writers

    monkeypatch.setattr(writers, "DOCUMENT_CHARS", 1000)
    path = str(tmp_path / "out")
    write(spark.range(0, 100, 1, 1).selectExpr("id", "repeat('x y\n', 50) AS t"), path, fmt)
    sizes = [os.path.getsize(os.path.join(path, p)) for p in os.listdir(path) if p.startswith("part-")]
    assert len(sizes) > 20 and max(sizes) < 3000
    back = read(spark, path, fmt)
    assert sorted(r.id for r in back.collect()) == list(range(100)) and back.select("t").distinct().count() == 1
    assert read_records(spark, path, fmt).count() == 100


def test_records_of_a_file_beyond_one_variant(spark, tmp_path):
    """A VARIANT holds 128 MiB; a file's records may be more."""
    record = json.dumps({"t": "x" * (1 << 20)})
    for name, start, end in (("a.json", "[", "]"), ("b.json", '{"data":[', "]}")):
        path = put(tmp_path / name, start + ",".join([record] * 135) + end)
        assert read_records(spark, path).count() == 135
