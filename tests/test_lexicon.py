"""Dictionaries, masking, grouping, medical rules and pipelines on fixtures."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import explain, grouping, legal, lexicon, medical, pipelines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_nearest_words_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcd"), rng.integers(1, 7)))
    words, terms = sorted({word() for _ in range(80)}), sorted({(w, int(rng.integers(1, 5))) for w in {word() for _ in range(40)}})
    got = {r["w"]: (r["term"], r["distance"]) for r in lexicon.nearest_words(spark.createDataFrame([(w, 1) for w in words] + [(None, 1), ("", 1)], "w string, n int"), "w", spark.createDataFrame(terms, "term string, n int")).collect()}
    for w in words:
        near = sorted((distance(w, t), -n, t) for t, n in terms if distance(w, t) <= 2)
        assert got.get(w) == ((near[0][2], near[0][0]) if near else None)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["Call +91 98765 43210", "a@b.co", "Section 12A", "AB/2020/11", "110001", "rent  is due ,", "1234 5678 9012", "__x__"]), max_size=5))
def test_masking_is_undone(spark, parts):
    t = " ".join(parts)
    spans = lexicon.kept_spans(F.col("t"))
    r = spark.createDataFrame([(t,)], "t string").select(lexicon.restored(lexicon.masked(F.col("t"), spans), spans).alias("x"), lexicon.corrected(F.col("t"), tx.SPACING).alias("c")).first()
    assert r["x"] == t and ("a@b.co" in r["c"]) == ("a@b.co" in t)


def test_looked_up_tiers(spark):
    d = spark.createDataFrame([("Hemoglobin", ["hb"], 1), ("Platelet Count", None, 2)], "key string, aliases array<string>, ord int")
    t = spark.createDataFrame([(x,) for x in ("hemoglobin", "HB", "platelet count high", "zzz", None, " ")], "t string")
    got = {r["t"]: (r["key"], r["tier"]) for r in lexicon.looked_up(t, "t", d).collect()}
    assert got == {"hemoglobin": ("Hemoglobin", "exact"), "hb": ("Hemoglobin", "alias"), "platelet count high": ("Platelet Count", "partial"), "zzz": (None, "none")}


MEDICAL = [("Hemoglobin: 5.0 g/dL", "critical"), ("Creatinine 1.7", "high"), ("emergency transfusion", "critical"), ("All fine.", "low"), ("stage 4 disease", "critical"), ("", "low")]


@pytest.mark.parametrize("t,level", MEDICAL)
def test_medical_risk(spark, t, level):
    assert spark.createDataFrame([(t,)], "t string").select(medical.medical_risk(F.col("t")).alias("x")).first()["x"]["level"] == level


def test_abnormality_by_sex(spark):
    ranges = spark.createDataFrame([("Hb", "general", 12.0, 16.0, 7.0, 20.0), ("Hb", "female", 11.0, 15.0, 7.0, 20.0)], "test string, sex string, low double, high double, critical_low double, critical_high double")
    rows = spark.createDataFrame([(1, "Hb", 11.5, "F"), (2, "Hb", 11.5, None), (3, "Hb", 6.0, "m"), (4, "x", 1.0, "F"), (5, "Hb", None, "F")], "id int, t string, v double, g string")
    got = {r["id"]: r["level"] for r in medical.assess(rows, ranges, "t", "v", "g").collect()}
    assert got == {1: "normal", 2: "mild", 3: "critical", 4: "unknown", 5: "unknown"}


def test_numbered_items_and_sentences(spark):
    df = spark.createDataFrame([("1. First one.\nmore\n2) Second by Mr. Rao. Then rest follows.",), (None,), ("",)], "t string")
    got = df.select(grouping.numbered_items(F.col("t")).alias("n"), grouping.clause_sentences(F.col("t")).alias("s")).collect()
    assert [(x["number"], x["content"]) for x in got[0]["n"]] == [(1, "First one.\nmore"), (2, "Second by Mr. Rao. Then rest follows.")]
    assert got[1]["n"] is None and got[2]["n"] == [] and any("Mr. Rao" in x for x in got[0]["s"])


def test_clusters_and_merges(spark):
    v = [[1.0, 0.0], [0.99, 0.1], [0.0, 1.0], [0.05, 1.0], [1.0, 0.05]]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(v)] + [("e", 0, [1.0, 0.0]), ("f", 0, None)], "k string, i int, v array<double>")
    c = {(r["k"], r["i"]): r["cluster"] for r in grouping.clusters(df, "k", "i", "v").collect()}
    assert c[("d", 0)] == c[("d", 1)] == c[("d", 4)] == 0 and c[("d", 2)] == c[("d", 3)] == 1 and c[("e", 0)] == 0
    m = {(r["k"], r["i"]): r["clause_no"] for r in grouping.merged(df, "k", "i", "v").collect()}
    assert [m[("d", i)] for i in range(5)] == [0, 0, 1, 1, 2]


def test_law_explanation(spark):
    df = spark.createDataFrame([("Urban Rent Act", "5", "", "1999"), ("Other Act", "", "", "")], "l string, s string, a string, y string")
    got = [r["x"] for r in df.select(explain.law_explanation(*map(F.col, "lsay")).alias("x")).collect()]
    assert got[0].startswith("This law protects tenants") and "Section 5" in got[0] and "1999" in got[0] and got[1].startswith("This is a legal reference to Other Act.")


def test_pipelines(spark):
    t = "RENT\nThe tenant shall pay the monthly rent of Rs. 5,000 to the landlord on the first day of each month without fail.\nDEPOSIT\nThe landlord may forfeit 100% of the security deposit of the tenant within 24 hours without notice to anyone."
    r = pipelines.legal_documents(spark.createDataFrame([(1, t, "x"), (2, None, "y"), (3, "", "z")], "k int, t string, clauses string"), "k", "t").collect()
    assert len(r) == 1 and r[0]["overall"] == "critical" and "₹5,000" in r[0]["key_terms"]
    d = pipelines.right_domain(spark.createDataFrame([("The tenant and landlord sign the lease agreement",)], "t string"), "t", "LEGAL").first()
    assert d["accepted"] and d["domain"] == "legal"


@pytest.mark.parametrize("t", [None, "", "short", "x" * 5000, "In witness whereof the parties have signed this agreement on the day and year above written here."])
def test_filler_and_types_of_odd_texts(spark, t):
    r = spark.createDataFrame([(t,)], "t string").select(legal.is_filler(F.col("t")).alias("f"), legal.clause_type(F.col("t")).alias("c"), legal.domain(F.col("t"))["domain"].alias("d")).first()
    assert t is None or r["f"] is True
