"""Sentences grouped into clauses: numbered items, average-linkage clusters, and merging by the mean of what was merged."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .legal import stripped

# Abbreviations that end no sentence, and key words of clauses.
ABBREVIATIONS = "mr mrs ms dr sr jr no nos rs vs etc ie eg".split()
KEYWORDS = "rent deposit security tenant landlord lessor lessee termination notice penalty maintenance repair sublet agreement premises possession breach liable rupees monthly advance refund electricity water charges".split()


def clause_sentences(text: Column) -> Column:
    """Sentences over ten characters: numbered items kept whole, abbreviations no ends, white space collapsed."""
    t = F.regexp_replace(text, r"(\d+)\.\s+", "$1) ")
    t = F.regexp_replace(t, rf"(?i)\b({'|'.join(ABBREVIATIONS)})\.", "$1ABBREV")
    parts = F.split(t, r"(?<=[.!?])\s+(?=[A-Z])|(?<=\n)\s*(?=\d+[\).]\s)|(?<=\n)\s*(?=[A-Z])")
    clean = F.transform(parts, lambda s: F.regexp_replace(stripped(F.replace(s, F.lit("ABBREV"), F.lit("."))), r"\s+", " "))
    return F.filter(clean, lambda s: F.length(s) > 10)


def numbered_items(text: Column) -> Column:
    """``array<struct<number, content>>`` of the lines that begin with a number and what follows them."""
    p = r"(?ms)^(\d+)[.)]\s*(.+?)(?=^\d+[.)]|\z)"
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("number"), F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("content"))
    return F.transform(both, lambda x: F.struct(x["number"].try_cast("long").alias("number"), stripped(x["content"]).alias("content")))


def keywords(text: Column, most: int = 5) -> Column:
    """The first ``most`` key words, in their order, that stand in a text."""
    low = F.lower(text)
    return F.slice(F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: F.contains(low, k)), 1, most)


def _linkage(vectors: np.ndarray, cut: float) -> list[int]:
    """Average-linkage clusters of the rows of the vectors' distance matrix, cut at ``cut``; labels by first member."""
    v = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    rows = 1 - v @ v.T
    np.fill_diagonal(rows, 0)
    d = np.sqrt(np.maximum(((rows[:, None] - rows[None]) ** 2).sum(2), 0))
    np.fill_diagonal(d, np.inf)
    groups = {i: [i] for i in range(len(v))}
    while len(groups) > 1:
        a, b = np.unravel_index(np.argmin(d), d.shape)
        if d[a, b] > cut:
            break
        n, m = len(groups[a]), len(groups[b])
        merged = (d[a] * n + d[b] * m) / (n + m)
        d[a], d[:, a] = merged, merged
        d[a, a] = np.inf
        d[b], d[:, b] = np.inf, np.inf
        groups[a] += groups.pop(b)
    label = [0] * len(v)
    for k, g in enumerate(sorted(groups.values(), key=min)):
        for i in g:
            label[i] = k
    return label


#: Sentences of one document clustered at once; longer documents are refused, not cut.
MOST_SENTENCES = 5000


def clusters(rows: DataFrame, key: str, order: str, vector: str, least: float = 0.6) -> DataFrame:
    """``key, order, cluster``: sentences of each document in average-linkage clusters, numbered by first sentence.

    Three sentences or fewer stand alone; beyond 20 the threshold rises by 0.05.  One document is one task's work,
    quadratic in its sentences, hence ``MOST_SENTENCES``.
    """
    kinds = dict(rows.select(key, order).dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(order)
        if len(g) > MOST_SENTENCES:
            raise ValueError(f"more than {MOST_SENTENCES} sentences in one document")
        t = min(least + 0.05, 0.75) if len(g) > 20 else least
        return pd.DataFrame({key: g[key], order: g[order], "cluster": list(range(len(g))) if len(g) <= 3 else _linkage(np.stack(g[vector].to_numpy()).astype(float), 1 - t)})

    return rows.where(F.col(vector).isNotNull()).select(key, order, vector).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, cluster int")


def merged(rows: DataFrame, key: str, order: str, vector: str, least: float = 0.7) -> DataFrame:
    """``key, order, clause_no``: each item joins the clause before it while its vector resembles the clause's mean."""
    kinds = dict(rows.select(key, order).dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(order)
        no, total, n, out = 0, None, 0, []
        for v in g[vector]:
            v = np.asarray(v, float)
            length = 0 if total is None else np.linalg.norm(total) * np.linalg.norm(v)
            if total is not None and length > 0 and total @ v / length > least:
                total, n = total + v, n + 1
            else:
                no, total, n = no + (total is not None), v, 1
            out.append(no)
        return pd.DataFrame({key: g[key], order: g[order], "clause_no": out})

    return rows.where(F.col(vector).isNotNull()).select(key, order, vector).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, clause_no int")
