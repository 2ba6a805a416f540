"""Noise in scanned text: page furniture, words broken across lines, misread words.

Line pairs are classified by weighted evidence (what a line looks like, what stands
before and after it, where else it stands): page number, running header, or join
of a broken word.  Misread words are found over the whole corpus: every word form
is joined with more frequent forms that share rare character q-grams (an inverted
join with prefix filtering), and gradient-boosted trees, trained on simulated
misreadings of the corpus's own words, rank the candidates and decide.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .language import common_subsequence

# ---- lines ----------------------------------------------------------------------------------------------------------
_PAGE_STRONG = re.compile(
    r"^\W*(?:p\s*a\s*g\s*e|pg|página|seite|पृष्ठ|पान|பக்கம்)[\W_]*(?P<n>[\d०-९]{1,4})(?:\s*(?:of|/|von|de|sur)\s*\d{1,4})?\W*$|^(?:[-–—~]\s*(?P<m>\d{1,4})\s*[-–—~]|\[\s*(?P<k>\d{1,4})\s*\])$", re.I
)
_PAGE_WEAK = re.compile(r"^(?:(?P<n>\d{1,3})(?:\s*/\s*\d{1,3})?|(?P<r>[ivxl]{1,6}))$")  # a number with a full stop counts an item, not a page
_WITH_PAGE = re.compile(r"^(?P<h>\S.*?\S)\s{2,}(?P<n>\d{1,4})$|^(?P<m>\d{1,4})\s{2,}(?P<g>\S.*\S)$")
_ENDS = ".।॥?!"
_OPEN_END = ".।॥?!,;:"
# Characters that recognition takes for one another, folded for the comparison of lines.
_FOLD = str.maketrans({"0": "o", "1": "i", "l": "i", "|": "i", "5": "s", "8": "b", "c": "e", "f": "t", "a": "u", "q": "g"})
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50}
HEADER_MOST, HEADER_LIKE, HEADER_LEAST = 90, 0.85, 2.0
_INNER_END = re.compile(r"[^\W\d_]{3,}[.।?!]\s")


def _roman(s: str) -> int:
    v = [_ROMAN[c] for c in s]
    return sum(-a if i + 1 < len(v) and a < v[i + 1] else a for i, a in enumerate(v))


def _key(line: str) -> str:
    """A line folded for comparison: without page number, case, misreadable differences and punctuation."""
    m = _WITH_PAGE.match(line)
    s = (m["h"] or m["g"]) if m else line
    return re.sub(r"[\W_]+", " ", s.casefold().translate(_FOLD).replace("rn", "m").replace("ii", "u").replace("ri", "n").replace("ei", "d")).strip()


def furniture(lines: list[str]) -> dict[int, tuple[str, str]]:
    """Line number -> (``page_number`` | ``running_header`` | ``maybe_header``, key) of the furniture of a text's lines."""
    s = [ln.strip() for ln in lines]
    body = [i for i, x in enumerate(s) if x]
    out: dict[int, tuple[str, str]] = {}
    if not body:
        return out
    weak: list[tuple[int, int, str]] = []
    for i in body:
        if len(s[i]) > 24:
            continue
        if m := _PAGE_STRONG.match(s[i]):
            out[i] = ("page_number", "")
        elif m := _PAGE_WEAK.match(s[i]):
            shape = "r" if m["r"] else re.sub(r"\d+", "9", s[i])
            weak.append((i, _roman(m["r"]) if m["r"] else int(m["n"]), shape))
    # headers: lines that stand again, apart from page numbers and misread characters
    short = [i for i in body if i not in out and 4 <= len(s[i]) <= HEADER_MOST and s[i][-1] not in _OPEN_END + "-¬‐­" and len(s[i].split()) > 1]
    keys = {i: _key(s[i]) for i in short}
    groups: dict[str, list[int]] = {}
    for i in short:
        if len(keys[i]) >= 4:
            groups.setdefault(keys[i], []).append(i)
    top = body[0]
    # lines that stand once join a repeated line, or the first line of the text, that they resemble
    seeds = [(g, set(g)) for g, at in groups.items() if len(at) > 1 or at[0] == top]
    for g in [g for g, at in groups.items() if len(at) == 1 and at[0] != top]:
        letters = set(g)
        for home, theirs in seeds:
            if abs(len(home) - len(g)) <= 3 and len(letters ^ theirs) <= 6 and 2 * common_subsequence(home, g) >= HEADER_LIKE * (len(g) + len(home)):
                groups[home] = sorted(groups[home] + groups.pop(g))
                break

    def near_page(i: int) -> bool:
        around = [j for j in (i - 1, i - 2, i + 1, i + 2) if 0 <= j < len(s) and s[j]]
        return bool(_WITH_PAGE.match(s[i])) or any(j in out and out[j][0] == "page_number" or any(j == w for w, _, _ in weak) for j in around[:2])

    lengths = sorted(len(s[i]) for i in body)
    width = lengths[int(0.9 * (len(lengths) - 1))]

    def flow(i: int) -> tuple[bool, bool]:
        """Whether a sentence is open before the line, and whether what follows continues one."""
        prev = s[i - 1] if i and s[i - 1] and (i - 1) not in out else ""
        following = s[i + 1] if i + 1 < len(s) else ""
        return bool(prev) and prev[-1] not in _OPEN_END, bool(following) and (any(c.isdigit() for c in following.split()[0]) or (following[0].lower() == following[0] and following[0] != "("))

    for g, at in groups.items():
        evidence = 0.0
        if len(at) > 1:
            line = s[at[0]]
            follow = {s[i + 1].split()[0] if i + 1 < len(s) and s[i + 1] else "" for i in at}
            flows = [flow(i) for i in at]
            evidence = 1.5 * (at[0] == top) + 1.5 * any(near_page(i) for i in at) + 1.0 * (line[0].isupper() and any(p for p, _ in flows)) + 0.5 * any(i and not s[i - 1] for i in at[1:])
            evidence += 0.5 * (len(line) <= 0.6 * width) - 1.0 * (len(line) >= 0.8 * width)
            evidence -= 3.0 * (len(follow) == 1 and "" not in follow) + 1.5 * sum(c and not p for p, c in flows) / len(flows) + 1.5 * line[0].islower()
            evidence -= 3.0 * bool(_INNER_END.search(line))
        if evidence >= HEADER_LEAST:
            out |= {i: ("running_header", keys[at[0]]) for i in at}
        elif at[0] == top and len(at) == 1 and len(body) > 1:
            out[top] = ("maybe_header", keys[top])
    pages = 0
    for i, n, shape in sorted(weak):
        same = sum(1 for _, _, x in weak if x == shape)
        before, after = (s[i - 1] if i else ""), (s[i + 1] if i + 1 < len(s) else "")
        last = next((s[j] for j in range(i - 1, -1, -1) if s[j] and j not in out), "")
        score = 1.0 * (n == pages + 1) + 0.7 * (same > 1) + 0.8 * (not before) + 0.5 * (not after) + 0.8 * any(0 <= j < len(s) and out.get(j, ("",))[0] == "running_header" for j in (i - 1, i + 1, i + 2))
        score += 0.4 * (shape in ("r", "9/9")) + 0.4 * (not last or last[-1] not in _ENDS) - 0.8 * (n > 60)
        if score >= 1.5:
            out[i] = ("page_number", "")
            pages = n
    return out


# ---- words ----------------------------------------------------------------------------------------------------------
_OUTER = re.compile(r"^[^\w]+|[^\w]+$")
_BROKEN = re.compile(r"(\S*[^\W\d_](?:[ऀ-ॣ்ா-ௌ]*))([-‐‑¬­])$")
_BARE = re.compile(r"^[\"'“‘(\[]*((?:[^\W\d_]|[’'\-ऀ-ॣா-்])+)")
_MARKS = "ऀ-ःऺ-ॏ॑-ॗॢॣஂா-்ௗ"
_TRIM = re.compile(rf"^[^\w{_MARKS}]+|[^\w{_MARKS}]+$")


def bare(token: str) -> str:
    """A word without outer punctuation."""
    token = token.strip(".,;:!?\"'()।")
    return token if token.isalnum() else _TRIM.sub("", token)


def parse(text: str) -> tuple[list[tuple[str, str, str]], list[str]]:
    """Findings (kind, value, extra) of one text and the words of its body.

    Kinds: ``page_number`` and ``running_header`` (value: the line), ``maybe_header`` (line, key), ``header_key``
    (key), ``broken`` (left part with its hyphen, right part).
    """
    lines = text.replace("\r\n", "\n").split("\n")
    kinds = furniture(lines)
    found, body = [], []
    for i, ln in enumerate(lines):
        if i in kinds:
            kind, key = kinds[i]
            found.append((kind, ln.strip(), key))
            if kind == "running_header":
                found.append(("header_key", key, ""))
            if kind != "maybe_header":
                continue
        if ln.strip():
            body.append(ln.strip())
    words: list[str] = []
    carry = None  # a broken word's first part
    for ln in body:
        tokens = ln.split()
        if carry is not None and tokens:
            m = _BARE.match(tokens[0])
            if m and m.start(1) == 0:
                found.append(("broken", carry, bare(tokens[0])))
                tokens = tokens[1:]
            carry = None
        if tokens and (m := _BROKEN.search(tokens[-1])) and "@" not in tokens[-1] and "/" not in tokens[-1]:
            carry = _TRIM.sub("", m[1]) + m[2]
            tokens = tokens[:-1]
        words += tokens
    return found, sorted({w for w in map(bare, set(words)) if w})


# ---- correction of misread words ------------------------------------------------------------------------------------
# What is printed, and what recognition takes it for.
CONFUSIONS = [
    ("e", "c"), ("c", "e"), ("a", "u"), ("u", "a"), ("a", "o"), ("o", "a"), ("t", "f"), ("f", "t"), ("n", "ri"), ("i", "1"), ("l", "1"), ("I", "1"), ("I", "l"), ("l", "I"), ("s", "5"), ("S", "5"),
    ("o", "0"), ("O", "0"), ("d", "cl"), ("cl", "d"), ("c", "o"), ("o", "c"), ("u", "ii"), ("m", "rn"), ("rn", "m"), ("h", "b"), ("b", "h"), ("g", "q"), ("q", "g"), ("g", "9"), ("y", "v"), ("v", "y"),
    ("w", "vv"), ("vv", "w"), ("li", "h"), ("h", "li"), ("B", "8"), ("b", "6"), ("z", "2"), ("Z", "2"), ("n", "u"), ("u", "n"), ("i", "l"), ("l", "i"), ("in", "m"), ("nn", "m"), ("ri", "n"), ("ii", "u"),
    ("j", "i"), ("i", "j"), ("t", "l"), ("l", "t"), ("D", "O"), ("Q", "O"), ("C", "G"), ("G", "C"), ("E", "F"), ("F", "E"), ("P", "R"), ("R", "P"), ("U", "V"), ("H", "N"),
]
#: Least number of texts of a form that others may be corrected to, and how many times more frequent it must be.
LEXICON_MIN, TIMES = 5, 8
#: How often a form may stand for one misreading of a word: share of the word's texts, with three deviations and two to spare.
MISREAD_RATE = 0.006
#: Edits looked for, and the length of the grams.
EDITS, Q = 2, 2
#: Words of the sample the trees are trained on (drawn by hash), trees, depth, shrinkage, least score.
TRAIN_WORDS, TREES, DEPTH, RATE, ACCEPT = 4000, 60, 3, 0.3, 0.5

#: Misread forms up to this many are broadcast to the texts' words; more are joined by a shuffle.
BROADCAST_MOST = 200_000

_COST = {}
for _a, _b in CONFUSIONS:
    _COST.setdefault((len(_a), len(_b)), set()).add((_a, _b))


def misreading(true: str, seen: str) -> tuple[float, int]:
    """Cost of reading ``true`` as ``seen`` and the number of steps: a known confusion costs 1, any other edit 3."""
    n, m = len(true), len(seen)
    if abs(n - m) > EDITS + 1:
        return 9.0, 9
    best = [[(99.0, 0)] * (m + 1) for _ in range(n + 1)]
    best[0][0] = (0.0, 0)
    for i in range(n + 1):
        for j in range(max(0, i - 3), min(m, i + 3) + 1):
            x = best[i][j]
            if i and j and true[i - 1] == seen[j - 1]:
                x = min(x, best[i - 1][j - 1])
            for (a, b), pairs in _COST.items():
                if i >= a and j >= b and best[i - a][j - b][0] < x[0] and (true[i - a : i], seen[j - b : j]) in pairs:
                    c = best[i - a][j - b]
                    x = min(x, (c[0] + 1, c[1] + 1))
            for a, b in ((1, 1), (1, 0), (0, 1)):
                if i >= a and j >= b and best[i - a][j - b][0] < 90:
                    c = best[i - a][j - b]
                    x = min(x, (c[0] + 3, c[1] + 1))
            best[i][j] = x
    return best[n][m]


def features(seen: str, n_seen: float, true: str, n_true: float, rivals: int) -> list[float]:
    cost, steps = misreading(true, seen)
    digits = sum(c.isdigit() for c in seen)
    return [
        cost, steps, np.log1p(n_seen), np.log1p(n_true), np.log((n_true + 1) / (n_seen + 1)), len(true), min(digits, 3), float(seen[:1].isupper() == true[:1].isupper()), min(rivals, 10),
        float(seen.isalpha()), cost / max(1, len(true)), float(abs(len(seen) - len(true))),
    ]


class Trees:
    """Gradient-boosted regression trees for a logistic loss."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 24))) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], 1)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score, self.trees = np.full(len(y), self.base), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree, value = self._grow(binned, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            score += RATE * value
        return self

    def _grow(self, b, g, h, rows, depth):
        out = np.zeros(len(g))
        leaf = g[rows].sum() / (h[rows].sum() + 1.0)
        best = (1e-6, -1, 0)
        if depth and len(rows) > 20:
            whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
            for f in range(b.shape[1]):
                k = len(self.cuts[f]) + 1
                gs, hs = np.bincount(b[rows, f], g[rows], k).cumsum(), np.bincount(b[rows, f], h[rows], k).cumsum()
                gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - whole
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
        if best[1] < 0:
            out[rows] = leaf
            return leaf, out
        left = b[rows, best[1]] <= best[2]
        a, va = self._grow(b, g, h, rows[left], depth - 1)
        c, vc = self._grow(b, g, h, rows[~left], depth - 1)
        return (best[1], self.cuts[best[1]][best[2]], a, c), va + vc

    def score(self, x: np.ndarray) -> np.ndarray:
        def walk(tree, rows):
            if not isinstance(tree, tuple):
                return np.full(len(rows), tree)
            f, cut, a, b = tree
            low, out = x[rows, f] <= cut, np.zeros(len(rows))
            out[low], out[~low] = walk(a, rows[low]), walk(b, rows[~low])
            return out

        rows = np.arange(len(x))
        return 1 / (1 + np.exp(-(self.base + RATE * sum(walk(t, rows) for t in self.trees)))) if len(x) else np.zeros(0)


def train(words: list[tuple[str, int]], seed: int = 3) -> Trees:
    """Trees trained on misreadings simulated with the corpus's own words; real words near one another are the counter-examples."""
    rng, count = np.random.default_rng(seed), dict(words)
    frequent = [(w, n) for w, n in words if n >= LEXICON_MIN and len(w) > 1]
    x, y = [], []
    near: dict[str, list[str]] = {}
    for w, _ in words:
        for i in range(len(w) + 1):
            near.setdefault(w[:i] + "*" + w[i + 1 :], []).append(w)
    for w, n in frequent:
        spots = [(i, a, b) for a, b in CONFUSIONS for i in range(len(w)) if w.startswith(a, i)]
        if spots:
            i, a, b = spots[rng.integers(len(spots))]
            seen = w[:i] + b + w[i + len(a) :]
            if seen not in count:
                k = 1 + rng.poisson(n * 0.002)
                x.append(features(seen, k, w, n, 1 + rng.integers(3)))
                y.append(1)
        # an arbitrary edit is no misreading, nor is a word that merely resembles a more frequent one
        i = rng.integers(len(w))
        other = w[:i] + "abdgkmprstvz"[rng.integers(12)] + w[i + 1 :]
        if other not in count and misreading(w, other)[0] > 1:
            x.append(features(other, 1 + rng.poisson(n * 0.01), w, n, 1))
            y.append(0)
        for i in range(len(w) + 1):
            for v in near.get(w[:i] + "*" + w[i + 1 :], [])[:3]:
                if v != w and count[v] > n and n >= LEXICON_MIN:
                    x.append(features(w, n, v, count[v], 2))
                    y.append(0)
    if len(set(y)) < 2:  # too few words to learn from: cost alone decides
        x += [features("tbe", 1, "the", 100, 1), features("abcd", 1, "wxyz", 100, 1)]
        y += [1, 0]
    return Trees().fit(np.array(x, float), np.array(y, float))


def grams(word: str) -> list[str]:
    w = f"^{word}$"
    return sorted({w[i : i + Q] for i in range(len(w) - Q + 1)})


def _grams(words: pd.Series) -> pd.Series:
    return words.map(grams)


_FORM = re.compile(r"^(?=.*[A-Za-zÀ-ÿ])[0-9A-Za-zÀ-ÿ'’\-]+$")


def corrections(vocabulary: DataFrame) -> DataFrame:
    """``word, correction, score`` of the misread forms of a ``vocabulary`` (``word, n``: in how many texts).

    Both sides are distinct forms.  Each form keeps the ``EDITS * Q + 1`` of its grams that are rarest (prefix filter:
    words within ``EDITS`` edits share one of them), and forms meet on a shared gram.  The trees are trained on a
    sample of ``TRAIN_WORDS`` forms drawn by hash; every form is judged.
    """
    spark = vocabulary.sparkSession
    forms = vocabulary.where(F.col("word").rlike(_FORM.pattern) & (F.length("word") > 1) & (F.length("word") <= 40))
    gram = F.pandas_udf(_grams, "array<string>")
    each = materialize(forms.select("word", "n", F.explode(gram("word")).alias("g")), "grams")
    rank = each.groupBy("g").agg(F.count("*").alias("f"))
    ranked = each.join(rank, "g").withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy("f", "g"))).where(F.col("r") <= EDITS * Q + 1)
    seen = ranked.select(F.col("word"), F.col("n"), "g")
    true = ranked.where(F.col("n") >= LEXICON_MIN).select(F.col("word").alias("c"), F.col("n").alias("cn"), "g")
    often = 2 + MISREAD_RATE * F.col("cn") + 3 * F.sqrt(MISREAD_RATE * F.col("cn"))
    meets = seen.join(true, "g").where((F.col("n") <= often) & (F.col("n") * TIMES <= F.col("cn")) & (F.abs(F.length("word") - F.length("c")) <= EDITS) & (F.levenshtein("word", "c", EDITS + 1).between(1, EDITS)))
    pairs = meets.select("word", "n", "c", "cn").distinct()
    sample = forms.orderBy(F.xxhash64("word"), "word").limit(TRAIN_WORDS).select("word", "n").collect()
    trees = spark.sparkContext.broadcast(train(sorted((r["word"], int(r["n"])) for r in sample)))

    def judge(batches):
        for b in batches:
            x = np.array([features(w, n, c, cn, r) for w, n, c, cn, r in zip(b["word"], b["n"], b["c"], b["cn"], b["rivals"])], float).reshape(len(b), -1)
            yield pd.DataFrame({"word": b["word"], "correction": b["c"], "cn": b["cn"], "score": trees.value.score(x) if len(b) else []})

    rivals = pairs.withColumn("rivals", F.count("*").over(Window.partitionBy("word")).cast("int"))
    scored = rivals.mapInPandas(judge, "word string, correction string, cn long, score double")
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), F.desc("cn"), "correction"))).where(F.col("r") == 1)
    return best.where(F.col("score") >= ACCEPT).select("word", "correction", "score")


# ---- the operator ---------------------------------------------------------------------------------------------------
def read(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Facts of every text, written to the shared folder: ``key, found`` (kind, value, extra) and distinct ``words``."""

    def run(batches):
        for b in batches:
            done = [parse(t) for t in b["t"]]
            yield pd.DataFrame({"k": b["k"], "found": [[{"kind": a, "value": v, "extra": e} for a, v, e in f] for f, _ in done], "words": [w for _, w in done]})

    given = rows.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    facts = given.mapInPandas(run, "k long, found array<struct<kind:string,value:string,extra:string>>, words array<string>")
    return materialize(facts.withColumnRenamed("k", key), "scans")


def repairs(facts: DataFrame, key: str) -> DataFrame:
    """``key, kind, item, repaired`` of all noise found; see ``find``."""
    vocabulary = materialize(facts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")
    found = facts.select(key, F.explode("found").alias("f")).select(key, "f.kind", "f.value", "f.extra")
    plain = found.where("kind in ('page_number', 'running_header')").select(key, "kind", F.col("value").alias("item"), F.lit("").alias("repaired"))
    # a line that stands once, at the top, is a header if it is one elsewhere
    known = found.where("kind = 'header_key'").groupBy(F.col("value").alias("extra")).agg(F.count("*").alias("_t"))
    single = found.where("kind = 'maybe_header'").join(known, "extra", "left_semi").select(key, F.lit("running_header").alias("kind"), F.col("value").alias("item"), F.lit("").alias("repaired"))
    # broken words: with a hyphen if the corpus writes it so more often than not
    broken = found.where("kind = 'broken'").withColumn("left", F.expr("substring(value, 1, length(value) - 1)"))
    shapes = broken.select("left", F.col("extra").alias("right")).distinct().withColumn("whole", F.concat("left", "right")).withColumn("dashed", F.concat("left", F.lit("-"), "right"))
    v = vocabulary.select("word", "n")
    counted = shapes.join(v.withColumnsRenamed({"word": "whole", "n": "n1"}), "whole", "left").join(v.withColumnsRenamed({"word": "dashed", "n": "n2"}), "dashed", "left")
    judged = counted.select("left", F.col("right").alias("extra"), F.when(F.coalesce("n2", F.lit(0)) > F.coalesce("n1", F.lit(0)), F.col("dashed")).otherwise(F.col("whole")).alias("made"))
    joined = broken.join(judged, ["left", "extra"]).select(key, F.lit("hyphenation").alias("kind"), F.col("made").alias("item"), F.concat("value", F.lit("\n"), "extra").alias("repaired"))
    wrong = materialize(corrections(vocabulary), "misread")
    few = wrong.limit(BROADCAST_MOST + 1).count() <= BROADCAST_MOST
    misread = facts.select(key, F.explode("words").alias("word")).join(F.broadcast(wrong) if few else wrong, "word").select(key, F.lit("misread").alias("kind"), F.col("word").alias("item"), F.col("correction").alias("repaired"))
    return plain.unionByName(single).unionByName(joined).unionByName(misread)


def find(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, kind, item, repaired`` of the noise in each text.

    ``kind`` is ``hyphenation`` (item: the word made whole; ``repaired``: its parts as they stood), ``misread`` (the
    word as it stands; its correction), ``running_header`` or ``page_number`` (the line; empty).  Counts are taken
    over all texts.  Null and empty texts give no row; repeated texts give rows each; other columns are ignored; an
    empty table gives an empty one.
    """
    return repairs(read(rows, key, text), key)


def paragraphs(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, repaired``: each text without furniture, its broken and misread words made right, a paragraph a line."""
    fixes = find(rows, key, text).groupBy(F.col(key).alias("_k")).agg(F.collect_set(F.struct("kind", "item", "repaired")).alias("fixes"))  # bounded by the text's words

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "repaired": [repair(t, list(f) if f is not None else []) for t, f in zip(b["t"], b["fixes"])]})

    given = rows.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).join(fixes, F.col("k") == F.col("_k"), "left").select("k", "t", "fixes")
    return given.mapInPandas(run, "k long, repaired string").withColumnRenamed("k", key)


def repair(text: str | None, fixes: list) -> str | None:
    """A text with its fixes made; null stays null."""
    if text is None:
        return None
    drop, wrong, whole = Counter(), {}, {}
    for f in fixes:
        kind, item, was = f["kind"], f["item"], f["repaired"]
        if kind == "misread":
            wrong[item] = was
        elif kind == "hyphenation":
            whole[was] = item
        else:
            drop[item] += 1
    lines = [ln.strip() for ln in text.replace("\r\n", "\n").split("\n")]
    out: list[list[str]] = [[]]
    gap = False
    for ln in lines:
        if ln in drop and ln:
            gap = None  # a blank line beside furniture ends no paragraph unless the sentence ended
            continue
        if not ln:
            gap = True if gap is False else gap
            continue
        tokens = ln.split()
        last = out[-1][-1] if out[-1] else ""
        if last and (m := _BROKEN.search(last)) and (made := whole.get(_TRIM.sub("", m[1]) + m[2] + "\n" + bare(tokens[0]))):
            lead = last[: len(last) - len(m[0].lstrip("\"'“‘(["))]
            tail = tokens[0][len(tokens[0].rstrip("\"'”’).,;:!?।]")) :]
            out[-1][-1] = lead + made + tail
            tokens = tokens[1:]
        elif out[-1] and (gap is True or (gap is None and last[-1:] in _ENDS)):
            out.append([])
        out[-1] += tokens
        gap = False
    fixed = [" ".join(t.replace(b, wrong[b], 1) if (b := bare(t)) in wrong else t for t in p) for p in out if p]
    return "\n".join(fixed)
