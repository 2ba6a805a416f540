"""Every query of the core with SQL gives what the SQL gives; every other one runs and keeps its columns on empty tables."""

import os

import pytest
from conftest import SMALL
from oracle import expected, rows

from corpusloom.plans import more_queries, problem_queries, registry

ORACLE = {**registry.ORACLE, **more_queries.ORACLE, **problem_queries.ORACLE}
QUERIES = {**registry.QUERIES, **more_queries.QUERIES, **problem_queries.QUERIES}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    assert rows(QUERIES[name](spark, SMALL).toPandas()) == expected(ORACLE[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() >= 0


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for f in os.listdir(SMALL):
        spark.read.parquet(f"{SMALL}/{f}").limit(0).write.parquet(f"{d}/{f}")
    return str(d)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    full, none = QUERIES[name](spark, SMALL), QUERIES[name](spark, empty)
    assert none.schema.simpleString() == full.schema.simpleString()
    assert none.count() <= 1  # a global count of nothing is one row


def test_llm_is_optional():
    """Nothing outside the subpackage imports it."""
    import corpusloom

    root = os.path.dirname(corpusloom.__file__)
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert "llm" not in open(os.path.join(folder, f), encoding="utf-8").read(), f
