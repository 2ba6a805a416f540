"""Leaks against brute force over planted passages; recall of the retrieval is measured here."""

import random

from corpusloom.llm import leakage

LOW = "lease tenant rent notice court clause deposit repair water owner party section act flat days month year paid fine term".split()
ODD = [f"{a}{b}" for a in ("mir", "tol", "ven", "kas", "dor", "pel", "rin", "zul") for b in ("and", "ock", "est", "ive", "ora", "umb", "ath", "iel")]


def planted(seed=4, n=120):
    r = random.Random(seed)
    items = [(i, " ".join(r.choice(ODD + LOW[:6]) for _ in range(r.choice([8, 30, 60])))) for i in range(30)]
    docs = []
    for d in range(n):
        words = [r.choice(LOW + ["the", "of", "and"]) for _ in range(r.randint(5, 120))]
        if d % 3 == 0:
            w = r.choice(items)[1].split()
            k = min(len(w), r.choice([8, 12, 13, 14, 25]))
            s = r.randint(0, len(w) - k)
            at = r.randint(0, len(words))
            words[at:at] = w[s : s + k]
        docs.append((d, " ".join(words).capitalize() + "."))
    return docs, items


def brute(docs, items):
    out = set()
    for i, t in items:
        w = leakage.words(t)
        n = min(13, len(w))
        runs = {tuple(w[s : s + n]) for s in range(len(w) - n + 1)}
        for d, x in docs:
            v = leakage.words(x)
            if any(tuple(v[s : s + n]) in runs for s in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def test_recall_against_brute_force(spark):
    docs, items = planted()
    d, e = spark.createDataFrame(docs + [(900, None), (901, "")], "doc_id long, text string"), spark.createDataFrame(items + [(99, None), (98, " . ")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(d, "doc_id", "text", e, "item_id", "text").where("kind = 'verbatim'").collect()}
    want = brute(docs, items)
    assert want and got <= want and len(got & want) >= 0.9 * len(want)


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items = planted(5, 60)
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 300)
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(d, "doc_id", "text", e, "item_id", "text").where("kind = 'verbatim'").collect()}
    want = brute(docs, items)
    assert got <= want and len(got) >= 0.9 * len(want)


def test_empty_sides(spark):
    d, e = spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert leakage.leaks(d, "doc_id", "text", e.limit(0), "item_id", "text").count() == 0
    assert leakage.leaks(d.limit(0), "doc_id", "text", e, "item_id", "text").count() == 0


def test_common_subsequence():
    assert leakage.common_subsequence("abcbdab", "bdcaba") == 4 and leakage.common_subsequence("", "a") == 0
