"""The queries that SQL can express, beside their SQL."""

import pytest

from check_oracle import compare, connect
from millrace.llm.queries import QUERIES
from millrace.llm.sql import ORACLE


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_values(spark, folder, name):
    assert compare(spark, connect(folder), folder, QUERIES[name], ORACLE[name]) is None


def test_every_operator_has_its_query():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
