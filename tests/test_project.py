import pytest
from pyspark.sql import functions as F

from millrace.functions import paths
from millrace.operators import project


@pytest.fixture(scope="module")
def nested(spark):
    return spark.sql("SELECT 'hi' AS q, named_struct('a', CAST(NULL AS STRING), 'l', array('x', 'y')) AS m")


def one(df):
    return df.first().asDict(recursive=True)


def test_present_null_stays_and_missing_is_blank(nested):
    got = one(project.map_to_template(nested, "qa", {"question": "q", "answer": "m.a"}))
    assert got == {"question": "hi", "answer": None}
    assert one(project.map_to_template(nested, "qa", {"question": "m.l.1", "answer": "nope"})) == {"question": "y", "answer": ""}
    assert one(project.map_to_template(nested, "qa", {"question": "m.l.9", "answer": "m.l.-1"})) == {"question": "", "answer": ""}


def test_null_container_is_missing(spark):
    df = spark.sql("SELECT CAST(NULL AS STRUCT<a: STRING>) AS m, map('k', CAST(NULL AS STRING)) AS d")
    got = one(project.map_to_template(df, "qa", {"question": "m.a", "answer": "d.k"}))
    assert got == {"question": "", "answer": None}
    assert one(project.map_to_template(df, "qa", {"question": "d.z"}))["question"] == ""


def test_variant_path_tells_null_from_absent(spark):
    df = spark.sql("""SELECT parse_json('{"a": {"b": [1, null, "x", {"y": 2}]}}') AS v""")
    paths_in = {"v.a.b.0": "1", "v.a.b.1": None, "v.a.b.2": "x", "v.a.b.3": '{"y":2}', "v.a.b.9": "", "v.a.c": ""}
    got = df.select(*[paths.read_text(df.schema, p).alias(str(i)) for i, p in enumerate(paths_in)]).first()
    assert list(got) == list(paths_in.values())


def test_chat_roles(nested):
    blank = one(project.map_to_template(nested, "chat", {"messages[0].content": "q"}))
    assert blank == {"messages": [{"role": "", "content": "hi"}, {"role": "", "content": ""}]}
    kept = one(project.map_to_template(nested, "chat", {"messages[*].content": "q"}, literals="keep"))
    assert kept == {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "hi"}]}


def test_errors(nested):
    for bad in ({}, None):
        with pytest.raises(ValueError):
            project.map_to_template(nested, "qa", bad)
    with pytest.raises(ValueError):
        project.map_to_template(nested, "no_such", {"a": "q"})
    with pytest.raises(ValueError):
        project.map_to_template(nested, "", {"a": "q"})


def test_empty_input_gives_empty_output(nested):
    assert project.map_to_template(nested.filter("false"), "qa", {"question": "q"}).count() == 0


def test_template_schemas():
    assert project.template_schema("alpaca").simpleString() == "struct<instruction:string,input:string,output:string>"
    assert project.template_schema("chat").simpleString() == "struct<messages:array<struct<role:string,content:string>>>"
    assert project.template_schema({"a": {"b": ""}}).simpleString() == "struct<a:struct<b:string>>"


def test_containers_become_json(nested):
    assert one(project.map_to_template(nested, "llama", {"text": "m"})) == {"text": '{"a":null,"l":["x","y"]}'}


def test_paths_and_suggestion(spark):
    df = spark.sql("SELECT named_struct('role', 'u', 'content', 'c') AS one, array(named_struct('role', 'r')) AS messages, 'p' AS prompt")
    assert paths.nested_paths(df.schema) == ["messages", "messages.role", "one", "one.content", "one.role", "prompt"]
    assert paths.suggest_mapping(df.schema, project.template_structure("instruction")) == {"prompt": "prompt"}
    flat = spark.sql("SELECT 'c' AS content, 'r' AS role")
    assert paths.suggest_mapping(flat.schema, project.template_structure("chat")) == {
        "messages[*].role": "role", "messages[*].content": "content"}


def test_set_path(nested):
    df = paths.set_path(nested, "m.a", F.lit("new"))
    df = paths.set_path(df, "m.l.1", F.lit("z"))
    df = paths.set_path(df, "n.o.p", F.lit(1))
    df = paths.set_path(df, "q.r", F.lit(2))
    assert one(df) == {"q": {"r": 2}, "m": {"a": "new", "l": ["x", "z"]}, "n": {"o": {"p": 1}}}


def test_preview(spark):
    df = spark.range(150).withColumn("t", F.when(F.col("id") > 0, F.lit("x")))
    shown = project.preview(df, order_by=["id"])
    assert shown.count() == 100 and tuple(shown.first()) == ("0", "")


def test_native_types(spark):
    from pyspark.sql import functions as F

    from millrace.operators import project

    df = spark.createDataFrame([(1, True, [1, 2], ("x", 5)), (2, None, None, None)], "n int, flag boolean, items array<int>, nested struct<a:string,b:int>")
    template = {"n": "", "flag": "", "items": "", "deep": {"a": "", "b": "", "second": ""}, "none": "", "parts": [{"v": "", "w": "k"}, {"v": "", "w": ""}]}
    mapping = {"n": "n", "flag": "flag", "items": "items", "deep.a": "nested.a", "deep.b": "nested.b", "deep.second": "items.1", "none": "no.where",
               "parts[0].v": "n", "parts[1].v": "nested.a", "parts[*].w": "n"}
    got = project.map_to_template(df, template, mapping, types="native")
    kinds = {f.name: f.dataType.simpleString() for f in got.schema.fields}
    assert kinds["n"] == "int" and kinds["flag"] == "boolean" and kinds["items"] == "array<int>" and kinds["none"] == "string"
    assert kinds["deep"] == "struct<a:string,b:int,second:int>" and kinds["parts"] == "array<struct<v:variant,w:int>>"
    first, second = got.orderBy("n").collect()
    assert (first["n"], first["flag"], first["items"], tuple(first["deep"])) == (1, True, [1, 2], ("x", 5, 2))
    assert (second["flag"], second["items"], tuple(second["deep"]), second["none"]) == (None, None, ("", None, None), "")
    assert [[str(v["v"].toPython()) for v in r["parts"]] for r in (first, second)] == [["1", "x"], ["2", ""]]
    whole = project.map_to_template(df, template, mapping, types="variant").orderBy(F.col("n").cast("int"))
    assert [r["deep"]["b"].toPython() for r in whole.collect()] == [5, ""]
    import pytest

    with pytest.raises(ValueError):
        project.map_to_template(df, template, mapping, types="other")
