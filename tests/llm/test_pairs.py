"""Defects of answers on a fixture, and the parts that tell them."""

import pandas as pd

from corpusloom.llm import language, pairs

PROMPTS = [
    "The Lessee shall pay unto the Lessor a monthly rent of Rs. {n} on or before day 5 of each calendar month.", "Either party may determine this instrument by serving not less than {n} days prior notice in writing.",
    "The Owner reserves the right to enter upon and inspect the flat upon {n} hours notice at reasonable hours.", "All charges for electricity and water number {n} shall be borne and discharged by the Tenant as per actuals.",
    "Neither party shall be liable for non-performance number {n} occasioned by causes beyond its reasonable control.",
]
ANSWERS = [
    "You must pay rent of {n} every month.", "Either side can end the contract with {n} days written notice.", "The owner can check the flat after telling you {n} hours before.", "You pay bill number {n} for what you use.",
    "No one is blamed for delay number {n} that they cannot control.",
]
HINDI = "किरायेदार हर महीने मकान मालिक को किराया देगा और घर को अच्छी हालत में रखना होगा।"


def model():
    en = [p.format(n=i) for i in range(12) for p in PROMPTS + ANSWERS]
    hi = [f"{HINDI} यह समझौता दोनों पक्ष समाप्त कर सकते हैं और जमा राशि लौटाई जाएगी।" for _ in range(40)]
    return language.train([pd.DataFrame({"t": en + hi, "l": ["en"] * len(en) + ["hi"] * len(hi)})])


def rows():
    out = [(i, PROMPTS[i % 5].format(n=i), ANSWERS[i % 5].format(n=i)) for i in range(60)]
    out += [(100 + i, PROMPTS[i % 5].format(n=i), "I am unable to process the clause you provided. Ask a lawyer.") for i in range(10)]
    out += [
        (200, PROMPTS[0].format(n=1), None), (201, PROMPTS[0].format(n=1), " ​"), (202, PROMPTS[0].format(n=1), "N/A"), (203, PROMPTS[0].format(n=1), "In plain words: " + PROMPTS[0].format(n=1).upper()),
        (204, PROMPTS[1].format(n=1), HINDI), (205, PROMPTS[1].format(n=1), "Either side can end the contract with 9 days"), (206, PROMPTS[1].format(n=1), "Either side can end the contract with 9 days written notice"), (207, None, ANSWERS[0].format(n=2)),
    ]
    return out


def test_defects(spark):
    df = spark.createDataFrame([(*r, "extra") for r in rows()], "k long, p string, a string, defect string")
    got = {r["k"]: r["defect"] for r in pairs.defects(df, "k", "p", {"a": "en"}, model()).collect()}
    assert all(got[i] is None for i in range(60))
    assert all(got[100 + i] == "refusal" for i in range(10))
    assert [got[k] for k in range(200, 208)] == ["empty", "empty", "empty", "copy", "wrong_language", "truncated", None, None]


def test_empty_table(spark):
    df = spark.createDataFrame([], "k long, p string, a string")
    assert pairs.defects(df, "k", "p", {"a": "en"}, model()).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 60), (60, 55)], "a long, b long")
    got = dict(pairs.components(links).collect())
    assert set(got.values()) == {0, 50} and got[20] == 0 and got[55] == 50


def test_opening_clusters(spark):
    texts = ["as an assistant i am not able to give legal advice", "as an assistant i am not able to give legal advice today", "you must pay rent of 9 every month by day 9", "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "opening_id long, opening string")
    got = dict(pairs.opening_clusters(df).collect())
    assert got[0] == got[1] and len({got[0], got[2], got[3]}) == 3
