"""Mentions of personal data: spans, checksums, odd input."""

import pytest

from corpusloom.llm import pii

CASES = [
    ("Contact person: Ravi Menon, mobile +91-98765-43210.", {("name", "Ravi Menon"), ("phone", "+91-98765-43210")}),
    ("Write to asha.rao (at) mail [dot] example or a_b+c@x-y.org.", {("email", "asha.rao (at) mail [dot] example"), ("email", "a_b+c@x-y.org")}),
    ("The tenant, Mr. K. Iyer, resides at Flat 7D, Blue\nHeron Apartments, Mill Street, Velmora 076685. Next.", {("name", "K. Iyer"), ("address", "Flat 7D, Blue Heron Apartments, Mill Street, Velmora 076685")}),
    ("श्रीमती निमारा ज़ोरवानी ने रसीद पर हस्ताक्षर किए। संपर्क के लिए ९५५५०३९३९९ पर फ़ोन करें।", {("name", "निमारा ज़ोरवानी"), ("phone", "९५५५०३९३९९")}),
    ("Receipt No. 470469442 was issued. Meter reading stood at 403430711 units on 12-05-2021.", set()),
    ("Goods received from Orchid Housing at Brindle Nagar under registry number RA/2012/631291.", set()),
    ("Le locataire, M. Belwadi, Minoush, est joignable au 022-55503358.", {("name", "Belwadi, Minoush"), ("phone", "022-55503358")}),
    ("Identity proof number 0826 0361 7360 of the lessee is annexed.", {("id_number", "0826 0361 7360")}),
    ("", set()), ("   \n ", set()), ("no mention here", set()),
]


@pytest.mark.parametrize("text,want", CASES)
def test_mentions(text, want):
    assert {(k, " ".join(text[s:e].split())) for k, s, e, _ in pii.mentions(text)} == want


@pytest.mark.parametrize("text,want", [("Dr. Belwadi, Nimara", {"Belwadi, Nimara"}), ("BABY OF Oshela B. Ebenthal", {"Oshela B. Ebenthal"}), ("A. Rao W/O K. Rao", {"A. Rao", "K. Rao"}), ("Asha Rao (36 yrs)", {"Asha Rao"}), ("-", set()), ("", set())])
def test_name_field(text, want):
    assert {text[s:e] for k, s, e, _ in pii.name_field_mentions(text) if k == "name"} == want


def test_checksums():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert pii.verhoeff("2363") and not pii.verhoeff("2364")


def test_redacted_text_keeps_the_rest(spark):
    rows = [(1, CASES[0][0], "a"), (2, None, "b"), (3, "", "c"), (1, CASES[0][0], "a")]
    got = pii.find(spark.createDataFrame(rows, "k long, text string, mentions string"), "k", "text").collect()
    by = {r["k"]: r for r in got}
    assert len(got) == 4 and by[1]["redacted"] == "Contact person: [NAME], mobile [PHONE]." and by[2]["redacted"] is None and by[3]["redacted"] == "" and by[2]["mentions"] == []


def test_long_text():
    t = "The Lessor shall keep the flat. " * 20000 + "Call 9555051234 now."
    assert [k for k, *_ in pii.mentions(t)] == ["phone"]
