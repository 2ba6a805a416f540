"""Scanning noise: furniture, broken and misread words, and the repaired text."""

from corpusloom.llm import scans

PAGE = "CONFIDENTIAL Velmora\nThe tenant shall pay the rent on the first day of\neach month and keep the premises in good repair and the depo-\n\nCONFIDENTIAL Velmora    2\nsit is refundable. The landlord shall give notice.\n\nPage 3 of 9"


def test_furniture_and_joins():
    found, words = scans.parse(PAGE)
    assert {(k, v) for k, v, _ in found if k in ("page_number", "running_header")} == {("running_header", "CONFIDENTIAL Velmora"), ("running_header", "CONFIDENTIAL Velmora    2"), ("page_number", "Page 3 of 9")}
    assert ("broken", "depo-", "sit") in found and "CONFIDENTIAL" not in words


def test_what_is_no_furniture():
    for t in ("Note:\nA b c.\n\nNote:\nD e f.", "Alpha beta.\n\n2.\nGamma delta.", "Please bring the report bearing number\nAC/1 x.\n\nPlease bring the report bearing number\nBD/2 y.", "", "\n\n"):
        assert not [k for k, _, _ in scans.parse(t)[0] if k in ("page_number", "running_header")], t


def corpus():
    base = "the tenant shall pay rent to the landlord every month and the deposit is refundable after notice in writing from either party with good repair of the premises"
    docs = [(i, f"{base.capitalize()}. The well-maintained garden is shared.") for i in range(60)]
    return docs + [(100, "Tbe tenant sha11 pay the depo5it to the landl0rd."), (101, "The well-\nmaintained garden and the refund-\nable deposit."), (102, None), (103, ""), (104, PAGE)]


def test_find(spark):
    df = spark.createDataFrame([(*r, 1) for r in corpus()], "k long, text string, item int")
    got = {(r["k"], r["kind"], r["item"]) for r in scans.find(df, "k", "text").collect()}
    assert {(101, "hyphenation", "well-maintained"), (101, "hyphenation", "refundable"), (104, "hyphenation", "deposit")} <= got
    assert (100, "misread", "depo5it") in got and (100, "misread", "landl0rd") in got
    assert not [x for x in got if x[0] < 100]


def test_repaired_paragraphs(spark):
    got = dict(scans.paragraphs(spark.createDataFrame(corpus(), "k long, text string"), "k", "text").collect())
    assert got[102] is None and got[103] == ""
    assert "deposit is refundable. The landlord" in got[104] and "CONFIDENTIAL" not in got[104] and "Page 3" not in got[104]
    assert got[101] == "The well-maintained garden and the refundable deposit."


def test_misreading_cost():
    assert scans.misreading("modern", "rnodern") == (1.0, 1) and scans.misreading("word", "word") == (0.0, 0) and scans.misreading("cat", "cut")[0] <= 1.0 and scans.misreading("cat", "cxt")[0] == 3.0


def test_empty_table(spark):
    assert scans.find(spark.createDataFrame([], "k long, text string"), "k", "text").count() == 0
