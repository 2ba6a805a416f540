"""Look-alike texts against brute force, and the defined results of odd input."""

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import visual

DOCS = [
    (1, "The Tenant pays 100"), (2, "The Теnant pays 100"), (3, "Ｔｈｅ Tenant pays １００"), (4, "The Tenant pays 100"), (5, "the tenant pays 100"), (6, "café"), (7, "café"), (8, None), (9, ""), (10, "​"),
    (11, "The Tenant pays 100"), (12, "The Tenant pays 101"), (13, "oﬃce"), (14, "office"),
]


def test_pairs_equal_brute_force(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in DOCS], "doc_id long, text string, stored string")
    got = {tuple(r) for r in visual.look_alike_pairs(df, "doc_id", "text").collect()}
    want = {(a, b) for a, x in DOCS for b, y in DOCS if a < b and x is not None and y is not None and x != y and visual.look(x) == visual.look(y)}
    assert got == want
    assert (1, 2) in got and (3, 4) in got and (6, 7) in got and (9, 10) in got and (13, 14) in got
    assert (1, 5) not in got and (1, 11) not in got and (1, 12) not in got


def test_classes(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_docs"], r["n_stored"]) for r in visual.look_classes(df, "doc_id", "text").collect()}
    assert got[11] == (1, 5, 4) and got[5] == (5, 1, 1) and 8 not in got


def test_hot_class(spark):
    """Copies of one text that fill the table meet only the other stored form."""
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id = 7 THEN 'lоng' ELSE 'long' END AS text")
    assert visual.look_alike_pairs(df, "doc_id", "text").count() == 2999


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_canonical_is_stable(t):
    c = visual.canonical(t)
    assert visual.canonical(c) == c
    assert visual.look(visual.look(t)) == visual.look(t)


def test_canonical_column(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").select("doc_id", visual.canonical_text("text").alias("c"))
    got = dict(df.collect())
    assert got[8] is None and got[9] == "" and got[1] == got[2] == got[5] == "the tenant pays 100"
