"""Language of every text and of every block of a mixed text, by error-correcting output codes.

Each language has a codeword; one binary linear classifier over hashed
character n-grams per bit predicts a text's bits, and loss-weighted decoding
takes the language whose codeword costs least.  The gap to the second-best
codeword gives the confidence and flags ambiguity.

The classifiers are trained on blocks of labelled rows (a sample bounded by
``SAMPLE_PER_LANGUAGE``); since labels are unreliable, training repeats after
dropping the blocks whose label the first round contradicts.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ["de", "en", "es", "fr", "hi", "mr", "ta"]
# Usual codes and names of the languages.
NAMES = {
    "de": "de deu ger german deutsch alemán allemand",
    "en": "en eng english anglais englisch inglés",
    "es": "es spa spanish español espanol castellano castilian espagnol",
    "fr": "fr fra fre french français francais französisch francés",
    "hi": "hi hin hindi हिन्दी हिंदी",
    "mr": "mr mar marathi मराठी",
    "ta": "ta tam tamil தமிழ்",
}
MIXED = "mul mixed multi multiple multilingual mixto gemischt"
#: Labelled rows used for training, per language; the only part that does not see all rows.
SAMPLE_PER_LANGUAGE = 1000
#: Characters of one training block, buckets of the n-gram hash, n-gram lengths.
TRAIN_CHARS, BUCKETS, GRAMS = 600, 1 << 16, (1, 2, 3, 4)
#: Fewest letters, and least confidence, for a block to make a text one of several languages.
MIN_LETTERS, SURE = 12, 0.9

_BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")


def label_languages(label: Column) -> Column:
    """The set of languages a label names, sorted; ``["mul"]`` if it says mixed, empty if it names none.

    A region (``en-IN``) is no language; null and blank labels name none.
    """
    pairs = [(w, k) for k, ws in NAMES.items() for w in ws.split()] + [(w, "mul") for w in MIXED.split()]
    lookup = F.create_map(*[F.lit(x) for p in pairs for x in p])
    bare = F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"^\s*([a-z]{2,3})[-_](in|us|gb|uk|fr|de|es|mx|ca|au|at|ch|latn|deva|taml)\s*$", "$1")
    words = F.filter(F.split(bare, r"[^\p{L}\p{M}]+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.filter(F.transform(words, lambda w: F.try_element_at(lookup, w)), lambda x: x.isNotNull())))


def blocks(text: str) -> list[str]:
    """The blocks of a text separated by blank lines, in order."""
    return [b for b in (x.strip() for x in _BLANK.split(text.replace("\r\n", "\n").replace("\r", "\n"))) if b]


_HAS_DIGIT = re.compile(r"\d")


def evidence(text: str) -> str:
    """The text as it counts for language: lower-case words between blanks; tokens with digits, @ or / are left out."""
    words = [w for w in text.split() if not _HAS_DIGIT.search(w) and "@" not in w and "/" not in w]
    return " ".join(" ".join(words).translate(_PUNCT).lower().split())


class _Punct(dict):
    """Maps what is no letter, mark or apostrophe to a blank."""

    def __missing__(self, c: int):
        import unicodedata

        k = unicodedata.category(chr(c))
        self[c] = c if k[0] in "LM" or c in (0x27, 0x2019, 0x200C, 0x200D) else None if c in (0xAD, 0x200B, 0xFEFF) else 0x20
        return self[c]


_PUNCT = _Punct()


# Characters that recognition takes for one another, folded for the comparison of lines.
_FOLD = str.maketrans({"0": "o", "1": "i", "l": "i", "|": "i", "5": "s", "8": "b", "c": "e", "f": "t"})
_OTHER = re.compile(r"[\W\d_]+")


def common_subsequence(a, b) -> int:
    """Length of the longest common subsequence of two sequences, by bit-parallel rows."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for x in b:
        m = where.get(x, 0)
        row = ((row + (row & m)) | (row & ~m)) & full
    return len(a) - row.bit_count()


def furniture(text: str) -> set[str]:
    """Lines that repeat in a text, numbers and misread characters apart, without ending a sentence.

    Such running headers are no evidence of a language.
    """
    lines = {ln.strip() for ln in text.split("\n")}
    open_lines = [ln.strip() for ln in text.split("\n") if 3 < len(ln.strip()) <= 80 and ln.strip()[-1] not in ".।?!,;:-¬‐"]
    shape = {ln: _OTHER.sub(" ", ln.casefold().translate(_FOLD)).strip() for ln in lines}
    seen: dict[str, int] = {}
    for ln in open_lines:
        seen[shape[ln]] = seen.get(shape[ln], 0) + 1
    repeated = [s for s, n in seen.items() if n > 1 and len(s) > 3]
    if not repeated:
        return set()
    near = lambda s: any(abs(len(s) - len(r)) <= 0.2 * len(r) and 2 * common_subsequence(s, r) >= 0.85 * (len(s) + len(r)) for r in repeated)
    return {ln for ln in open_lines if shape[ln] in repeated or near(shape[ln])}


def featurize(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all n-grams of all texts, and where each text's begin; blanks stand only at an n-gram's ends."""
    joined = "\n".join(f" {t} " for t in texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    ends = np.flatnonzero(cp == 10)
    blanks = np.concatenate([[0], np.cumsum(cp == 32)])
    owner = np.searchsorted(ends, np.arange(len(cp)), side="left")
    ids, own, h = [], [], np.zeros(len(cp), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        part = cp[n - 1 :]
        h = (h[: len(part)] * np.uint64(0x100000001B3)) ^ (part + np.uint64((0x9E3779B97F4A7C15 * n) & (1 << 64) - 1))
        if n in GRAMS:
            g = h * np.uint64(0xFF51AFD7ED558CCD)
            ok = owner[: len(part)] == owner[n - 1 :]
            ok &= (part != 10) & ((part != 32) if n == 1 else True)
            if n > 2:  # no blank inside
                ok &= blanks[n - 1 : len(cp)] == blanks[1 : len(part) + 1]
            ids.append((g[ok] >> np.uint64(48)).astype(np.int32) & (BUCKETS - 1))
            own.append(owner[: len(part)][ok])
    ids, own = np.concatenate(ids), np.concatenate(own)
    order = np.argsort(own, kind="stable")
    return ids[order], np.searchsorted(own[order], np.arange(len(texts) + 1))


class _Bags:
    """Texts as bags of words, and the n-gram buckets of each distinct word."""

    def __init__(self, texts: list[str]):
        place: dict[str, int] = {}
        self.texts = [np.unique(np.array([place.setdefault(w, len(place)) for w in t.split()], np.int64), return_counts=True) for t in texts]
        ids, at = featurize(list(place))
        self.ids, self.at = ids.astype(np.uint16), at  # buckets are below 65,536, and short numbers sort fastest

    def batch(self, rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts: counts of their words, and of these words the lengths, the buckets and where they begin."""
        used, inv = np.unique(np.concatenate([self.texts[r][0] for r in rows]), return_inverse=True)
        counts = np.zeros((len(rows), len(used)), np.float32)
        counts[np.repeat(np.arange(len(rows)), [len(self.texts[r][0]) for r in rows]), inv] = np.concatenate([self.texts[r][1] for r in rows])
        n = self.at[used + 1] - self.at[used]
        starts = np.cumsum(n) - n
        return counts, n, self.ids[np.repeat(self.at[used] - starts, n) + np.arange(n.sum())], starts


def codewords(k: int) -> np.ndarray:
    """Codewords of +1/-1 for ``k`` classes: rows of a Hadamard matrix of order ``m``, at a distance of ``m / 2``.

    The rows are the powers of two and their sums with the first, so that no two columns (bits) are equal or
    complementary; the constant column is left out.
    """
    if k < 3:
        return np.array([[1.0], [-1.0]][:k], np.float32)
    bits = int(np.ceil((k + 3) / 3))
    powers = [1 << i for i in range(bits)]
    rows = (powers + [p | 1 for p in powers[1:]] + [p | 2 for p in powers[2:]])[:k]
    cols = np.arange(1, 1 << bits)
    parity = np.array([[bin(r & c).count("1") % 2 for c in cols] for r in rows])
    return (1 - 2 * parity).astype(np.float32)


class Ecoc:
    """Linear bit classifiers with loss-weighted decoding."""

    def __init__(self, classes: list[str]):
        self.classes, self.code = classes, codewords(len(classes))
        self.w = np.zeros((BUCKETS, self.code.shape[1]), np.float32)
        self.trust = np.ones(self.code.shape[1], np.float32)
        #: Classes that had labelled rows; others are never chosen.
        self.known = np.zeros(len(classes), bool)
        self.forget()

    def forget(self) -> None:
        """Empties the memory of word scores."""
        self._place: dict[str, int] = {}
        self._sums, self._count = np.zeros((0, self.code.shape[1]), np.float32), np.zeros(0, np.float32)

    def __getstate__(self) -> dict:
        self.forget()
        return self.__dict__

    def _learn(self, new: list[str]) -> None:
        for i in range(0, len(new), 8192):
            part = new[i : i + 8192]
            ids, at = featurize(part)
            sums = np.zeros((len(part), self.w.shape[1]), np.float32)
            full = np.flatnonzero(np.diff(at))
            if len(full):
                sums[full] = np.add.reduceat(self.w[ids], at[:-1][full], axis=0)
            self._sums, self._count = np.vstack([self._sums, sums]), np.concatenate([self._count, np.diff(at).astype(np.float32)])

    def margins(self, texts: list[str]) -> np.ndarray:
        """Bit margins of texts of words between single blanks.

        N-grams don't cross words, so a text's score is the sum of its words'; words are scored once and remembered
        (at most half a million).  Texts are taken in chunks bounded by words.
        """
        out = np.zeros((len(texts), self.code.shape[1]), np.float32)
        i = 0
        while i < len(texts):
            lists, n, at = [], 0, i
            while i < len(texts) and (n < 200_000 or not lists):
                lists.append(texts[i].split())
                n += len(lists[-1])
                i += 1
            if len(self._place) > 500_000:
                self.forget()
            place, new = self._place, []
            for ws in lists:
                for w in ws:
                    if w not in place:
                        place[w] = len(place)
                        new.append(w)
            self._learn(new)
            index = np.fromiter((place[w] for ws in lists for w in ws), np.int64, n)
            sizes = np.array([len(ws) for ws in lists])
            starts = np.cumsum(sizes) - sizes
            full = np.flatnonzero(sizes)
            if len(full):
                sums = np.add.reduceat(self._sums[index], starts[full], axis=0)
                grams = np.add.reduceat(self._count[index], starts[full])
                out[at + full] = sums / np.sqrt(np.maximum(grams, 1))[:, None]
        return out

    def fit(self, texts: list[str], y: np.ndarray, epochs: int = 4, rate: float = 0.5) -> None:
        """Logistic regression of each bit by AdaGrad; texts' scores are sums of their words' scores."""
        bags, rng, target = _Bags(texts), np.random.default_rng(7), self.code[y]
        g2 = np.full_like(self.w, 1e-3)
        self.known[np.unique(y)] = True
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), 128):
                rows = order[i : i + 128]
                counts, n, ids, starts = bags.batch(rows)
                scale = 1 / np.sqrt(np.maximum(counts @ n.astype(np.float32), 1))
                m = (counts @ np.add.reduceat(self.w[ids], starts, axis=0)) * scale[:, None]
                grad = -target[rows] / (1 + np.exp(np.clip(target[rows] * m, -30, 30))) * scale[:, None]
                by = np.argsort(ids, kind="stable")
                ends = np.flatnonzero(np.diff(ids[by], prepend=np.uint16(ids[by][0] ^ 1)))
                step = np.add.reduceat(np.repeat(counts.T @ grad.astype(np.float32), n, axis=0)[by], ends, axis=0) / len(rows)
                uniq = ids[by][ends]
                g2[uniq] += step**2
                self.w[uniq] -= (rate * step / np.sqrt(g2[uniq])).astype(np.float32)
        self.forget()
        right = (np.sign(self.margins(texts)) == target).mean(0)
        self.trust = np.clip(np.log(np.clip(right, 0.5001, 0.9999) / (1 - np.clip(right, 0.5001, 0.9999))), 0.05, None).astype(np.float32)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers and confidences; classes without labelled rows are left out."""
        m = np.clip(margins[:, None, :] * self.code[None], -30, 30)
        loss = (np.log1p(np.exp(-m)) * self.trust).sum(2) / self.trust.sum() * self.code.shape[1]
        loss = np.where(self.known | ~self.known.any(), loss, np.inf)
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        return loss.argmin(1), (p.max(1) / p.sum(1)).astype(float)


def labelled_sample(rows: DataFrame, text: str, label: str, per: int = SAMPLE_PER_LANGUAGE) -> pd.DataFrame:
    """About ``per`` rows of each language named alone by its label, chosen by content hash, in an order that
    doesn't depend on how files are partitioned; two bounded actions."""
    one = label_languages(F.col(label))
    lab = rows.select(F.col(text).alias("t"), F.get(one, F.lit(0)).alias("l"), F.xxhash64(F.col(text)).alias("h"), F.size(one).alias("n"))
    lab = lab.where((F.col("n") == 1) & (F.col("l") != "mul") & F.col("t").isNotNull())
    counts = {r["l"]: r["n"] for r in lab.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return pd.DataFrame({"t": [], "l": []})
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per / n))])
    taken = lab.where(F.pmod(F.col("h"), F.lit(1_000_003)) < F.lit(1_000_003) * F.element_at(share, F.col("l")))
    # copies of one text share a hash: they are taken once a label, so the sample stays near its bound
    found = taken.select("t", "l", "h").distinct().orderBy("h", "l", "t").limit(2 * per * len(LANGUAGES)).toPandas()
    return found[["t", "l"]]


def _training_blocks(text: str) -> list[str]:
    """All evidence of a text, a block at a time, blocks longer than ``TRAIN_CHARS`` in parts."""
    skip, out = furniture(text), []
    for b in blocks(text):
        e = evidence("\n".join(ln for ln in b.split("\n") if ln.strip() not in skip))
        at = 0
        while len(e) - at > TRAIN_CHARS:
            cut = e.find(" ", at + TRAIN_CHARS)
            if cut < 0:
                break
            out.append(e[at:cut])
            at = cut + 1
        out.append(e[at:])
    return [e for e in out if len(e) >= MIN_LETTERS]


def train(samples: list[pd.DataFrame]) -> Ecoc:
    """Trains on the blocks of labelled texts, twice: the second time without blocks the first contradicts.

    Without any labelled row the model knows no language and names none.
    """
    texts, y = [], []
    for s in samples:
        for t, lab in zip(s["t"], s["l"]):
            for e in _training_blocks(t):
                texts.append(e)
                y.append(LANGUAGES.index(lab))
    y = np.array(y, int)
    model = Ecoc(LANGUAGES)
    if len(texts):
        model.fit(texts, y, epochs=2)
        got, sure = model.decode(model.margins(texts))
        keep = np.flatnonzero(got == y)
        model = Ecoc(LANGUAGES)
        model.fit([texts[i] for i in keep], y[keep])
    return model


def detect_blocks(texts: list[str], model: Ecoc) -> list[list[tuple[int, str | None, float, int]]]:
    """For each text its blocks' (number, language or None, confidence, letters that count)."""
    flat, where = [], []
    for i, t in enumerate(texts):
        skip = furniture(t)
        for k, b in enumerate(blocks(t), 1):
            e = evidence("\n".join(ln for ln in b.split("\n") if ln.strip() not in skip))
            heading = "\n" not in b and len(b) <= 80 and b[-1] not in ".।?!"  # a lone line that ends no sentence
            own = 0 if heading else len(e.replace(" ", ""))
            flat.append(e or evidence(b))
            where.append((i, k, own))
    got, sure = model.decode(model.margins(flat)) if flat else ([], [])
    out: list[list] = [[] for _ in texts]
    for (i, k, own), e, g, s in zip(where, flat, got, sure):
        out[i].append((k, model.classes[g] if e and model.known.any() else None, float(s) if e else 0.0, own))
    return out


def detect(rows: DataFrame, key: str, text: str, label: str, model: Ecoc) -> DataFrame:
    """Languages of texts and of their blocks: ``key, segment_no, language, confidence, ambiguous, languages, said``.

    Segment 0 is the whole text, ``mul`` if blocks of several languages are in it; a block too short or too
    ambiguous to tell takes the text's main language.  ``languages`` are all of the text, ``said`` those its
    label names.  Null, blank and letterless texts give no row, nor do letterless blocks.  Repeated rows give
    rows each; other columns are ignored; an empty table gives an empty one.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits floats, whatever the data
    names = ["k", "segment_no", "language", "confidence", "ambiguous", "languages", "said"]

    def run(batches):
        m = shared.value
        for b in batches:
            out = []
            for k, said, parts in zip(b["k"], b["said"], detect_blocks(list(b["t"]), m)):
                told = [p for p in parts if p[1]]
                if not told:
                    continue
                weight: dict[str, float] = {}
                for _, lang, sure, n in told:
                    weight[lang] = weight.get(lang, 0) + (n or 0.5) * sure
                main = max(sorted(weight), key=weight.get)
                langs = sorted({lang for _, lang, sure, n in told if lang == main or (n >= MIN_LETTERS and sure >= SURE)})
                total = sum(n or 1 for _, _, _, n in told)
                whole = sum(sure * (n or 1) for _, _, sure, n in told) / total
                out.append((k, 0, main if len(langs) == 1 else "mul", whole, whole < SURE, langs, said))
                out += [(k, no, lang if lang in langs and (n or lang == main) else main, sure, sure < SURE, langs, said) for no, lang, sure, n in told]
            yield pd.DataFrame(out, columns=names)

    given = rows.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), label_languages(F.col(label)).alias("said"))
    return given.mapInPandas(run, "k long, segment_no int, language string, confidence double, ambiguous boolean, languages array<string>, said array<string>").withColumnRenamed("k", key)


def relabelled(found: DataFrame, key: str) -> DataFrame:
    """Texts whose label is missing or wrong (segment 0), and every block of a text in several languages."""
    right = F.array_contains("said", "mul") & (F.size("languages") > 1) | (F.col("said") == F.col("languages"))
    return found.where(F.when(F.col("segment_no") == 0, ~right).otherwise(F.size("languages") > 1)).select(key, "segment_no", "language").distinct()
