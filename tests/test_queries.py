"""Every query of the library's catalogue beside its SQL, and what its plan must not contain."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare, connect
from millrace.plans.oracle import ORACLE
from millrace.plans.queries import QUERIES


@pytest.fixture(scope="module")
def sql(folder):
    return connect(folder)


def test_entry(spark):
    assert entry(spark).columns == ["doc_id", "instruction", "input", "output"] and entry(spark).count() > 0


def test_catalogue():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_values(spark, folder, sql, name):
    assert compare(spark, sql, folder, QUERIES[name], ORACLE[name]) is None


#: Spark has no YAML parser, and its XML parser does not read to the end.
PYTHON = {"wellformed_xml", "wellformed_yaml"}


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("io_")])
def test_plan(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert name in PYTHON or not any(step in plan for step in ("EvalPython", "InPandas", "InArrow"))


@pytest.mark.parametrize("name", ["io_yaml", "io_records"])
def test_whole_records_are_written(spark, folder, name, monkeypatch):
    from millrace.plans import queries as catalogue

    seen, put = [], catalogue.write
    monkeypatch.setattr(catalogue, "write", lambda df, *a, **b: (seen.append(df.columns), put(df, *a, **b))[1])
    QUERIES[name](spark, folder)
    assert all("text" in columns for columns in seen) and seen
