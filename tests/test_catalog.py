import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracle import compare, connect

from __spark_entry__ import oracle_sql, queries


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, small, name):
    equal, text = compare(spark, con, name, small)
    assert equal, text


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_scans_read_only_what_they_need(spark, small):
    plan = queries()["chunk_sizes"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<label:int>" in plan
    plan = queries()["union_sources"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
