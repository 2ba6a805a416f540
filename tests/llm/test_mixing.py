"""Mixing: shares, repeat caps, permutation, plan."""

import os

import numpy as np
import pytest

from corpusloom.llm import mixing

need = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="tokenizer file absent")


def test_permutation_is_one():
    for n in (1, 2, 3, 10, 257, 1000):
        for seed in (0, 5):
            p = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, seed))
            assert sorted(p.tolist()) == list(range(n))


def test_plan():
    take, total = mixing.plan({"a": 1000, "b": 10}, {"a": (0.5, 1), "b": (0.5, 3), "c": (0.1, 2)}, None)
    assert total == 60 and take == {"a": 30, "b": 30}
    take, _ = mixing.plan({"a": 1000, "b": 10}, {"a": (0.5, 1), "b": (0.5, 3)}, 500)
    assert take == {"a": 470, "b": 30}
    assert mixing.plan({}, {"a": (1.0, 1)}, None) == ({}, 0)


@need
def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "SHARD", 8)
    docs = [(i, f"word {i} and more words to count in this text number {i}", ("Big", "big ", "BIG")[i % 3]) for i in range(400)] + [(1000 + i, f"small text {i}", "small_one" if i % 2 else "Small One") for i in range(20)]
    docs += [(2000, "no target", "other"), (2001, None, "big"), (2002, "", "big"), (2003, "x", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("big", 0.8, 1), ("small-one", 0.2, 3)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(d, "doc_id", "text", "source", t)
    r = {x["source"]: x for x in report.collect()}
    assert abs(r["big"]["reached_share"] - 0.8) < 0.05 and r["small_one"]["most_repeats"] <= 3
    rows = mixed.collect()
    assert {x["doc_id"] for x in rows} & {2000, 2001, 2002, 2003} == set()
    used = {}
    for x in rows:  # no token of a document more often than allowed
        for k in range(x["first"], x["first"] + x["n"]):
            used[(x["doc_id"], k)] = used.get((x["doc_id"], k), 0) + 1
    assert max(v for (k, _), v in used.items() if k < 1000) == 1 and max(used.values()) <= 3
    assert sum(x["n"] for x in rows) == sum(x["reached"] for x in r.values())


@need
def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    t = spark.createDataFrame([("big", 0.8, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(d, "doc_id", "text", "source", t)
    assert mixed.count() == 0 and report.first()["reached"] == 0
