"""Pieces cover a text with their overlap; ranges and files agree with the whole."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import splitting


def text(n, seed=1):
    r = random.Random(seed)
    out = []
    while sum(map(len, out)) < n:
        out.append("".join(r.choice("abcdefghijк") for _ in range(r.randint(1, 9))) + r.choice(["", "", "", ".", ",", ";", "\n\n"]) + " ")
    return "".join(out)[:n]


def covers(pieces, n):
    at = 0
    for i, (s, e) in enumerate(pieces):
        assert e - s <= 1200 and (s == 0 if i == 0 else 0 <= at - s <= 120)
        at = e
    assert at == n


@settings(max_examples=60, deadline=None)
@given(st.integers(1201, 9000), st.integers(0, 10_000), st.booleans())
def test_cover(n, seed, blank):
    t = text(n, seed) if not blank else "x" * n
    covers([(s, e) for s, e, _ in splitting.cut_range(t, 0, n)], n)


def test_giant_and_repeated(spark):
    t = text(700_000)
    df = spark.createDataFrame([(1, t, 5), (1, t, 5), (2, "short", 5), (3, None, 5), (4, "", 5)], "k long, t string, piece_no int")
    got = splitting.split_texts(df, ["k"], "t").collect()
    assert {r["k"] for r in got} == {1}
    pieces = sorted({(r["piece_no"], r["start"], r["end"]) for r in got})
    assert [p for p, _, _ in pieces] == list(range(1, len(pieces) + 1)) and len(got) == 2 * len(pieces)
    covers([(s, e) for _, s, e in pieces], len(t))
    assert all(r["piece"] == t[r["start"] : r["end"]] for r in got)


def test_files(spark, tmp_path):
    t = text(600_000, 3)
    (tmp_path / "a.txt").write_text(t, "utf-8")
    (tmp_path / "b.txt").write_text("", "utf-8")
    got = splitting.split_files(spark, str(tmp_path)).collect()
    pieces = sorted((r["piece_no"], r["start"], r["end"]) for r in got)
    covers([(s, e) for _, s, e in pieces], len(t))
    assert all(r["piece"] == t[r["start"] : r["end"]] for r in got)
