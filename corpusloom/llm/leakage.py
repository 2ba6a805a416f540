"""Evaluation texts leaking into a corpus, by latent semantic retrieval and an exact check.

Texts are cut into passages of ``WINDOW`` words every ``STRIDE`` words, so that any
run of ``RUN`` words stands whole in one passage of the document and in one of the
item.  Passages become TF-IDF vectors (document frequencies of the whole corpus);
a distributed randomised SVD of the items' passages gives a latent space, in which
every passage of every document is compared with every passage of the items.
Pairs whose cosine reaches ``THRESHOLD`` are candidates.  The exact check keeps
those with a run of ``RUN`` words in common (or the whole item, if shorter); of the
others a longest-common-subsequence and an answer check keep the paraphrases.

Items are handled in blocks of at most ``BLOCK_WORDS`` words, so what is broadcast
is bounded; documents are read once a block and nothing of them is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import common_subsequence
from .visual import canonical

RUN, WINDOW, STRIDE = 13, 26, 13
#: Rank of the latent space, oversampling and power iterations of the randomised SVD.
RANK, OVERSAMPLE, POWER = 128, 16, 2
#: Least cosine of a candidate.  Recall against brute force is measured in the tests (at least 0.9 is asked; 1.0 found).
THRESHOLD = 0.2
#: Buckets of the document-frequency table; most words of items in one block.
DF_BUCKETS, BLOCK_WORDS = 1 << 16, 400_000
#: A passage without a common run is a paraphrase at this cosine and share of words in a common subsequence.
PARAPHRASE_COSINE, PARAPHRASE_LCS = 0.6, 0.8


@lru_cache(maxsize=1)
def _word_pattern() -> re.Pattern:
    marks, start = [], None
    for c in range(0x20000):
        is_mark = unicodedata.category(chr(c))[0] == "M"
        if is_mark and start is None:
            start = c
        elif not is_mark and start is not None:
            marks.append(f"{chr(start)}-{chr(c - 1)}")
            start = None
    return re.compile(r"[\w" + "".join(marks) + "]+")


_ASCII_WORD = re.compile("[a-z0-9]+")


def words(text: str) -> list[str]:
    """Runs of letters, digits and marks of the text's consistent form."""
    t = canonical(text)
    return _ASCII_WORD.findall(t) if t.isascii() else _word_pattern().findall(t.replace("_", " "))


def passages(n: int) -> list[tuple[int, int]]:
    """Where the passages of a text of ``n`` words begin and end."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    starts = list(range(0, n - WINDOW, STRIDE)) + [n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many documents each word bucket occurs, and how many documents there are; one action over all rows.

    Counted in the JVM, aggregated per partition first; what reaches the driver is at most ``DF_BUCKETS`` numbers.
    """
    terms = F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}\p{M}]+"))
    bucket = F.array_distinct(F.transform(terms, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(DF_BUCKETS)).cast("int")))
    # bucket -1 counts the documents themselves
    counts = docs.where(F.col(text).isNotNull()).select(F.explode(F.concat(F.array(F.lit(-1)), bucket)).alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()
    df = np.zeros(DF_BUCKETS, np.int64)
    total = 0
    for r in counts:
        if r["b"] < 0:
            total = r["n"]
        else:
            df[r["b"]] = r["n"]
    return df, total


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % DF_BUCKETS


class Items:
    """A block of items: their words as numbers, vocabulary, weights, runs and (once fitted) latent passages."""

    def __init__(self, rows: list[tuple[int, list[str]]], df: np.ndarray, total: int):
        self.ids = [i for i, _ in rows]
        self.vocabulary: dict[str, int] = {}
        self.words = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws] for _, ws in rows]
        self.idf_table = np.log((total + 1.0) / (df + 0.5)).clip(0.05).astype(np.float32)
        self.idf = np.array([self.idf_table[_bucket(w)] for w in self.vocabulary] or [1.0], np.float32)
        self.runs: dict[tuple[int, ...], set[int]] = {}
        self.lengths = sorted({min(RUN, len(w)) for w in self.words if w})
        for k, w in enumerate(self.words):
            n = min(RUN, len(w))
            for s in range(len(w) - n + 1 if n else 0):
                self.runs.setdefault(tuple(w[s : s + n]), set()).add(k)
        at = [(k, s, e) for k, w in enumerate(self.words) for s, e in passages(len(w))]
        self.owner = np.array([k for k, _, _ in at], np.int32)
        self.spans = [(s, e) for _, s, e in at]
        self.space = self.queries = None

    def rows(self) -> list[tuple[int, list[int]]]:
        return [(i, self.words[k][s:e]) for i, (k, (s, e)) in enumerate(zip(self.owner, self.spans))]

    def answer(self, k: int) -> set[int]:
        """The words that carry an item's answer: the rarest fifth of its last passage, at least three."""
        tail = sorted(set(self.words[k][-WINDOW:]), key=lambda w: -self.idf[w])
        return set(tail[: max(3, len(tail) // 5)])


def fit(items: Items, spark) -> Items:
    """Fits the latent space: a randomised range finder with power iterations over the items' TF-IDF passages.

    Each task multiplies its own rows, partial products are summed by bands of the vocabulary, and only the
    vocabulary x (rank + oversampling) product reaches the driver.
    """
    v, k = len(items.idf), RANK + OVERSAMPLE
    k = min(k, v, max(1, len(items.spans)))
    q = np.random.default_rng(11).standard_normal((v, k)).astype(np.float32)
    data = spark.createDataFrame(pd.DataFrame({"w": [w for _, w in items.rows()]}) if items.spans else [], "w array<int>").repartition(max(1, min(64, len(items.spans) // 500)))
    idf, band = spark.sparkContext.broadcast(items.idf), 4096
    for _ in range(POWER if items.spans else 0):
        basis = spark.sparkContext.broadcast(q)

        def multiply(batches):
            weight, omega, part = idf.value, basis.value, None
            for b in batches:
                for w in b["w"]:
                    ids, n = np.unique(np.asarray(w, np.int64), return_counts=True)
                    x = n * weight[ids]
                    x = (x / np.sqrt((x * x).sum())).astype(np.float32)
                    part = np.zeros_like(omega) if part is None else part
                    part[ids] += x[:, None] * (x @ omega[ids])[None]
            if part is not None:
                yield pd.DataFrame({"band": range(0, len(part), band), "sums": [part[i : i + band].tobytes() for i in range(0, len(part), band)]})

        def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"band": [key[0]], "sums": [np.sum([np.frombuffer(s, np.float32) for s in rows["sums"]], axis=0, dtype=np.float32).tobytes()]})

        got = data.mapInPandas(multiply, "band int, sums binary").groupBy("band").applyInPandas(add, "band int, sums binary").collect()
        y = np.zeros_like(q)
        for r in got:
            y[r["band"] : r["band"] + band] = np.frombuffer(r["sums"], np.float32).reshape(-1, k)
        q, _ = np.linalg.qr(y)
        q = q.astype(np.float32)
    items.space = (q[:, :RANK] * items.idf[:, None]).astype(np.float32)
    latent = []
    for _, w in items.rows():
        x = items.space[w].sum(0)
        latent.append(x / np.sqrt((items.idf[w] ** 2).sum()))
    items.queries = np.array(latent, np.float32).reshape(len(latent), items.space.shape[1])
    return items


class _Coder(dict):
    """Words of documents as numbers, with a bounded memory: a word of the items has its number in their vocabulary,
    any other one the size of the vocabulary plus its bucket."""

    def __init__(self, items: Items):
        super().__init__()
        self.items, self.size = items, len(items.vocabulary)
        self.weights = np.concatenate([items.idf[: self.size], items.idf_table]).astype(np.float64)

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = self.items.vocabulary.get(word)
        self[word] = code = self.size + _bucket(word) if code is None else code
        return code

    def __call__(self, ws: list[str]) -> list[int]:
        return [self[w] for w in ws]


def _search(items: Items, coder: _Coder, texts: list[str]) -> Iterator[tuple[int, int, float, int, int, str]]:
    """(text, item, cosine, longest run up to ``RUN``, common subsequence, kind) of the texts' leaks, a row per passage."""
    ids, where = [], []
    for i, t in enumerate(texts):
        c, at = coder(words(t)), len(ids)
        ids += c
        where += [(i, at + s, at + e) for s, e in passages(len(c))]
    if not where or not len(items.queries):
        return
    codes = np.array(ids, np.int64)
    weight, known = coder.weights[codes], codes < coder.size
    w2, mine = np.concatenate([[0.0], np.cumsum(weight * weight)]), np.concatenate([[0.0], np.cumsum(np.where(known, weight, 0.0))])
    s, e = np.array([a for _, a, _ in where]), np.array([b for _, _, b in where])
    norm2 = np.maximum(w2[e] - w2[s], 1e-12)
    # a passage is no longer in the latent space than the sum of its known words' weights
    keep = np.flatnonzero((mine[e] - mine[s]) ** 2 >= THRESHOLD**2 * norm2)
    for at in range(0, len(keep), 2048):
        part = keep[at : at + 2048]
        width = int((e[part] - s[part]).max())
        latent = np.zeros((len(part), items.space.shape[1]), np.float32)
        for j in range(width):
            word = np.minimum(s[part] + j, e[part] - 1)
            here = np.flatnonzero((s[part] + j < e[part]) & known[word])
            latent[here] += items.space[codes[word[here]]]
        latent /= np.sqrt(norm2[part])[:, None].astype(np.float32)
        reach = np.flatnonzero((latent * latent).sum(1) >= THRESHOLD**2)  # a cosine can't exceed the latent length
        if not len(reach):
            continue
        # not by BLAS, whose threads spin beyond the cores that a task has
        cosine = np.einsum("ik,jk->ij", latent[reach], items.queries)
        rows, cols = np.nonzero(cosine >= THRESHOLD)
        by: dict[tuple[int, int], tuple[float, int]] = {}
        for r, c, x in zip(rows.tolist(), cols.tolist(), np.minimum(cosine[rows, cols], 1.0).tolist()):
            key = (r, int(items.owner[c]))
            if key not in by or by[key][0] < x:
                by[key] = (x, c)
        runs: dict[int, set[int]] = {}
        for (r, k), (x, c) in by.items():
            p = part[reach[r]]
            got = ids[s[p] : e[p]]
            if r not in runs:
                runs[r] = set()
                for n in items.lengths:
                    for j in range(len(got) - n + 1):
                        runs[r] |= items.runs.get(tuple(got[j : j + n]), set())
            a, b = items.spans[c]
            if k in runs[r]:
                yield where[p][0], k, x, min(RUN, len(items.words[k])), 0, "verbatim"
            elif x >= PARAPHRASE_COSINE:
                lcs = common_subsequence(items.words[k][a:b], got)
                if lcs >= PARAPHRASE_LCS * (b - a) and (items.answer(k) <= set(got) or b < len(items.words[k])):
                    yield where[p][0], k, x, 0, lcs, "paraphrase"


def item_blocks(evaluation: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, list[str]]]]:
    """The items in blocks of at most ``BLOCK_WORDS`` words, streamed a partition at a time."""
    block, n = [], 0
    for r in evaluation.where(F.col(text).isNotNull()).select(F.col(key), F.col(text)).toLocalIterator():
        ws = words(r[1])
        if block and n + len(ws) > BLOCK_WORDS:
            yield block
            block, n = [], 0
        if ws:
            block.append((r[0], ws))
            n += len(ws)
    yield block


def leaks(docs: DataFrame, doc_key: str, doc_text: str, evaluation: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """``doc_key, item_key, cosine, run, common, kind`` of each document and item with a leaked passage.

    ``kind`` is ``verbatim`` (a run of ``RUN`` words, or the whole item if shorter) or ``paraphrase``.  Runs one
    action over all documents (document frequencies) and ``POWER`` small ones a block.  Null, empty and wordless
    texts on either side give no row; repeated documents give rows each, as do items that share passages; other
    columns are ignored; an empty table on either side gives an empty one.
    """
    spark = docs.sparkSession
    df, total = document_frequencies(docs, doc_text)
    out = None
    given = docs.where(F.col(doc_text).isNotNull()).select(F.col(doc_key).cast("long").alias("k"), F.col(doc_text).alias("t"))
    for block in item_blocks(evaluation, item_key, item_text):
        shared = spark.sparkContext.broadcast(fit(Items(block, df, total), spark))

        def run(batches, shared=shared):
            items = shared.value
            coder = _Coder(items)
            for b in batches:
                found: dict[tuple[int, int], tuple] = {}
                keys, texts = list(b["k"]), list(b["t"])
                at = 0
                while at < len(texts):  # chunks bounded by characters, at least one text each
                    end, size = at + 1, len(texts[at])
                    while end < len(texts) and size + len(texts[end]) < 2_000_000:
                        size += len(texts[end])
                        end += 1
                    for i, k, x, n, lcs, kind in _search(items, coder, texts[at:end]):
                        old, new = found.get((at + i, k)), (kind == "verbatim", round(x, 4), n, lcs)
                        if old is None or new > old:
                            found[(at + i, k)] = new
                    at = end
                yield pd.DataFrame(
                    [(keys[i], items.ids[k], x, n, lcs, "verbatim" if v else "paraphrase") for (i, k), (v, x, n, lcs) in found.items()],
                    columns=["k", "i", "cosine", "run", "common", "kind"],
                )

        part = given.mapInPandas(run, "k long, i long, cosine double, run int, common int, kind string").withColumnsRenamed({"k": doc_key, "i": item_key})
        out = part if out is None else out.unionByName(part)
    return out
