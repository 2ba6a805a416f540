"""Queries of the subpackage: equal to their SQL where they have any, and all run."""

import os

import pytest
from conftest import SMALL
from oracle import expected, rows

from corpusloom.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SMALL)
    if name in ORACLE:
        assert rows(df.toPandas()) == expected(ORACLE[name], SMALL)
    else:
        assert df.count() >= 0


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for f in os.listdir(SMALL):
        spark.read.parquet(f"{SMALL}/{f}").limit(0).write.parquet(f"{d}/{f}")
    return str(d)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0
