"""Codewords, held-out accuracy, independence of partitioning, no labels."""

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL

from corpusloom.llm import language
from corpusloom.session import table


@pytest.mark.parametrize("k", [3, 5, 7, 9, 12])
def test_codewords(k):
    c = language.codewords(k)
    cols = {tuple(x) for x in c.T} | {tuple(-x) for x in c.T}
    assert len(cols) == 2 * c.shape[1]  # no two bits equal or complementary
    assert min((c[i] != c[j]).sum() for i in range(k) for j in range(i)) == (c.shape[1] + 1) / 2


def test_no_labels_name_no_language(spark):
    m = language.train([pd.DataFrame({"t": [], "l": []})])
    df = spark.createDataFrame([(1, "Some English words stand here.", None)], "k long, t string, l string")
    assert language.detect(df, "k", "t", "l", m).count() == 0


def test_partitioning_makes_no_difference(spark):
    rows = table(spark, SMALL, "ocr_results")

    def run(df):
        m = language.train([language.labelled_sample(df, "text", "language")])
        return sorted(map(tuple, language.detect(df, "ocr_id", "text", "language", m).select("ocr_id", "segment_no", "language", "confidence").collect()))

    assert run(rows) == run(rows.repartition(7))


def test_held_out_accuracy(spark):
    d = table(spark, SMALL.replace("0.001", "0.01"), "documents")
    s = language.labelled_sample(d, "text", "lang")
    cut = len(s) * 2 // 3
    m = language.train([s[:cut]])
    rest = s[cut:]
    got, _ = m.decode(m.margins([language.evidence(t) for t in rest["t"]]))
    assert np.mean([m.classes[g] == lab for g, lab in zip(got, rest["l"])]) > 0.8


def test_odd_rows(spark):
    m = language.train([pd.DataFrame({"t": ["this is plain english text for you"] * 5 + ["dies ist ein deutscher Text für dich"] * 5, "l": ["en"] * 5 + ["de"] * 5})])
    df = spark.createDataFrame([(1, None, "en", 1), (2, "", "en", 1), (3, "123 456", "en", 1), (4, "this is english text", "de", 1), (4, "this is english text", "de", 1)], "k long, t string, l string, confidence int")
    got = language.relabelled(language.detect(df, "k", "t", "l", m), "k").collect()
    assert [(r["k"], r["segment_no"], r["language"]) for r in got] == [(4, 0, "en")]
