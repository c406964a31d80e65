"""Every registered query against its SQL on the smallest data, and rules for all plans."""

import os
import re

import pytest

import oracle
from __spark_entry__ import entry
from __spark_entry__ import oracle_sql as every_sql
from __spark_entry__ import queries as every_query
from postsieve.plans.catalogue import QUERIES
from postsieve.plans.oracles import ORACLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= every_query().items() and ORACLES.items() <= every_sql().items()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert oracle.difference(df, con, ORACLES[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"EvalPython|CartesianProduct|BroadcastNestedLoopJoin|MapInPandas", plan)
    width = {c for schema in re.findall(r"ReadSchema: struct<(.*?)>", plan) for c in re.findall(r"(\w+):", schema)}
    assert not width & {"source", "n_chars", "o_totalprice", "p_retailprice", "value"}, "a column nobody asked for is read"


def test_entry(spark):
    assert entry(spark).columns == ["company", "title", "ord"]


@pytest.mark.parametrize("name", ["stream_dedup", "stream_new_postings"])
def test_streams_read_tables_in_several_files(spark, con, tmp_path, name):
    for table in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    assert oracle.difference(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name]) is None
