"""Defective answers of prompt-answer pairs, each with the first defect that holds.

``empty``, ``refusal``, ``copy``, ``wrong_language``, ``truncated``, in that order.

Refusals are found by what sets them apart from real answers: the same opening
recurs across prompts that have nothing in common.  Openings are clustered by
MinHash with verification; a cluster whose prompts share no sentence template and
that speaks of declining is a refusal.  Copies are told by the longest common
subsequence with the prompt, languages by the error-correcting output codes, and
truncation by whether the last sentence stands complete anywhere in the corpus.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .language import Ecoc, common_subsequence, evidence
from .leakage import words
from .visual import look

DEFECTS = ["empty", "refusal", "copy", "wrong_language", "truncated"]
#: Most words of an opening (its first sentence), shingle length, and least similarity of one cluster.
OPENING, SHINGLE, SIMILAR = 12, 5, 0.8
BANDS, ROWS = 8, 4
#: A cluster's prompts are unrelated if no sentence template is shared by this part of them; fewer distinct prompts
#: than ``RECURS`` prove nothing, then only openings that decline in the first person count.
RELATED, RECURS = 0.6, 4
#: A copy holds this part of the prompt's words in order, and the prompt makes up this part of it.
COPY_OF_PROMPT, COPY_OF_ANSWER = 0.8, 0.75
#: Letters below which an answer's language is not judged.
MIN_LETTERS = 12

# Texts that stand for nothing, and words of declining (strong: in the first person or by apology).
_BLANK = {"", "null", "none", "n a", "na", "nil", "nan", "undefined", "tbd"}
_STRONG = re.compile(
    r"\b(?:i(?: am|'m|’m| m)?(?: \w+){0,2} (?:cannot|can't|can’t|can not|unable|not able|won't|won’t|decline|not allowed|refuse)|i (?:cannot|can't|can’t|won't|won’t|must decline|do not have enough|don't have enough)|i'd rather not|i would rather not"
    r"|sorry|apolog\w+|regret\w*|unfortunately|as an? (?:ai|assistant|language model))\b|(?:क्षमा करें|माफ़ कीजिए|माफ़ करें|मुझे खेद|खेद है|असमर्थ|मेरे लिए संभव नहीं|मैं .{0,40}नहीं कर|सहायता नहीं कर|மன்னிக்கவும்|क्षमस्व|माफ करा)",
    re.I,
)
_WEAK = re.compile(
    r"\b(?:cannot be (?:processed|provided|answered|completed|fulfilled|simplified|rewritten)|can't|cannot|unable|not able|won't|declin\w+|outside what|beyond my|not permitted|usage (?:guidelines|policy)|no \w+ can be offered|please provide|consult a|ask a lawyer|speak to an?|against (?:the|my) (?:guidelines|policy))\b"
    r"|(?:नहीं कर सक|नहीं कर पा|संभव नहीं|असमर्थ|कृपया किसी वकील|सलाह देने|अनुमति नहीं|இயலாது|முடியாது|शक्य नाही)",
    re.I,
)
_SENTENCE = re.compile(r"(?<=[.।!?])[\"'”’)\]]*\s+")
_NUMBER = re.compile(r"[\d०-९௦-௯][\d०-९௦-௯.,:/-]*")
_LATIN_NAME = re.compile(r"(?<=\s)[A-ZÀ-ÖØ-Þ][\w'’-]*")
_LETTER = re.compile(r"[^\W\d_]")
_DROPPED = re.compile(r"[\W_]*$")


def blank(text: str | None) -> bool:
    """Whether there is nothing to read in a text: no letters or digits, or a word that stands for nothing."""
    return text is None or " ".join(words(text)) in _BLANK


def masked(sentence: str) -> str:
    """A sentence as a template: numbers and capitalised names inside it masked, case and final punctuation dropped."""
    s = _LATIN_NAME.sub("N", " ".join(look(sentence).split()))
    return _DROPPED.sub("", _NUMBER.sub("9", s).casefold())


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(" ".join(text.split())) if s]


def copies(prompt: list[str], answer: list[str]) -> bool:
    """Whether the answer repeats the prompt but for a lead-in or a word or two."""
    if not prompt or not answer or len(answer) < COPY_OF_PROMPT * len(prompt) or len(prompt) < COPY_OF_ANSWER * len(answer):
        return False
    same = common_subsequence(prompt, answer)
    return same >= COPY_OF_PROMPT * len(prompt) and same >= COPY_OF_ANSWER * len(answer)


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _templates(text: str) -> list[int]:
    """Two MinHash values of each sentence of a prompt: equal for sentences of one template, mostly."""
    out = []
    for s in sentences(text):
        w = masked(s).split()
        grams = [_hash(" ".join(w[i : i + 4])) for i in range(max(1, len(w) - 3))]
        out += [min(grams), max(grams)]
    return sorted(set(out))


FACTS = (
    "key long, field string, expected string, is_empty boolean, is_copy boolean, language string, letters int, opening string, opening_id long, strong boolean, weak boolean, "
    "ended boolean, last_id long, whole_ids array<long>, prompt_id long, templates array<long>"
)


def _facts(rows: DataFrame, key: str, prompt: str, answers: dict[str, str], model: Ecoc) -> DataFrame:
    """A row per answer with all that is told from the pair alone; no text but the masked opening is kept."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        codes = shared.value
        for b in batches:
            out, texts = [], []
            for r in b.itertuples(index=False):
                p = r[1] or ""
                pw, pid, temp = words(p), _hash(" ".join(words(p))), _templates(p)
                for (field, lang), t in zip(answers.items(), r[2:]):
                    if blank(t):
                        out.append([r[0], field, lang, True, False, None, 0, None, 0, False, False, True, 0, [], pid, []])  # no nulls among the numbers: they would be read as floats
                        texts.append("")
                        continue
                    aw, parts = words(t), sentences(t)
                    opening = " ".join(masked(parts[0]).split()[:OPENING])
                    seen = _DROPPED_BLANKS.sub("", t)
                    ended = seen[-1:] in ".।!?॥" and not seen.endswith(("..", " ."))
                    whole = [_hash(x) for s in (parts if ended else parts[:-1]) if _LETTER.search(x := masked(s))]
                    e = evidence(t)
                    out.append([
                        r[0], field, lang, False, copies(pw, aw), None, len(e.replace(" ", "")), opening, _hash(opening), bool(_STRONG.search(t[:400])), bool(_WEAK.search(t[:400])),
                        ended, _hash(last) if _LETTER.search(last := masked(parts[-1])) else 0, whole, pid, temp,
                    ])
                    texts.append(e)
            got, _ = codes.decode(codes.margins(texts)) if texts else ([], [])
            for o, g, e in zip(out, got, texts):
                o[5] = codes.classes[g] if e and codes.known.any() else None
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FACTS.split(", ")])

    return rows.select(F.col(key).cast("long").alias("_k"), F.col(prompt), *answers).mapInPandas(run, FACTS)


_DROPPED_BLANKS = re.compile(r"[\s\"'”’)\]​‌‍⁠﻿]+$")


def opening_clusters(openings: DataFrame) -> DataFrame:
    """``opening_id, cluster``: openings joined by verified MinHash similarity of ``SIMILAR`` on five-word shingles.

    ``openings`` holds distinct ones, so copies never meet.  Shorter openings than a shingle are one shingle.
    """
    spark = openings.sparkSession

    def sign(batches):
        rng = np.random.default_rng(5)
        a, c = rng.integers(1, 1 << 61, BANDS * ROWS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 61, BANDS * ROWS, dtype=np.uint64)
        for b in batches:
            out = []
            for i, t in zip(b["opening_id"], b["opening"]):
                w = t.split()
                s = sorted({_hash(" ".join(w[j : j + SHINGLE])) for j in range(max(1, len(w) - SHINGLE + 1))})
                h = ((np.array(s, np.int64).astype(np.uint64)[:, None] * a + c) >> np.uint64(17)).min(0).reshape(BANDS, ROWS)
                out += [(i, s, n, _hash(band.tobytes().hex())) for n, band in enumerate(h)]
            yield pd.DataFrame(out, columns=["opening_id", "shingles", "band", "bucket"])

    signed = materialize(openings.select("opening_id", "opening").mapInPandas(sign, "opening_id long, shingles array<long>, band int, bucket long"), "openings")
    x, y = signed.alias("x"), signed.alias("y")
    both = F.size(F.array_intersect("x.shingles", "y.shingles"))
    links = (
        x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.opening_id") < F.col("y.opening_id")))
        .where(both >= SIMILAR * (F.size("x.shingles") + F.size("y.shingles") - both))
        .select(F.col("x.opening_id").alias("a"), F.col("y.opening_id").alias("b"))
        .distinct()
    )
    label = components(links)
    return openings.select("opening_id").join(label.withColumnRenamed("node", "opening_id"), "opening_id", "left").select("opening_id", F.coalesce("label", "opening_id").alias("cluster"))


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the least node of each connected component of links ``a, b``, by min-label propagation with
    pointer jumping; each round is a table in the shared folder, until none changes."""
    edges = materialize(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))), "edges")
    label = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = edges.join(label, edges["b"] == label["node"]).groupBy("a").agg(F.min("label").alias("m"))
        step = label.join(near, label["node"] == near["a"], "left").select("node", F.least("label", F.coalesce("m", "label")).alias("label"), F.col("label").alias("old"))
        up = step.select(F.col("node").alias("n2"), F.col("label").alias("up"))
        new = materialize(step.join(up, step["label"] == up["n2"], "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "old"), "labels")
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        label = new.select("node", "label")


def _declining(facts: DataFrame) -> DataFrame:
    """``opening_id`` of the openings that refuse."""
    told = facts.where("not is_empty")
    per = told.groupBy("opening_id").agg(F.min("opening").alias("opening"), F.max("strong").alias("strong"), F.max("weak").alias("weak"))
    clusters = opening_clusters(per.select("opening_id", "opening"))
    member = materialize(per.select("opening_id", "strong", "weak").join(clusters, "opening_id"), "clusters")
    # distinct prompts of each cluster, and the largest share of them that has one sentence template in common
    prompts = told.select("opening_id", "prompt_id", "templates").join(member.select("opening_id", "cluster"), "opening_id").groupBy("cluster", "prompt_id").agg(F.first("templates").alias("templates"))
    prompts = materialize(prompts, "prompts")
    sizes = prompts.groupBy("cluster").agg(F.count("*").alias("n"))
    shares = prompts.select("cluster", F.explode("templates").alias("t")).groupBy("cluster", "t").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max("k").alias("k"))
    cues = member.groupBy("cluster").agg(F.max("strong").alias("strong"), F.max("weak").alias("weak"))
    judged = cues.join(sizes, "cluster").join(shares, "cluster", "left")
    related = F.coalesce(F.col("k"), F.lit(0)) / F.col("n") >= RELATED
    refuses = F.when(F.col("n") >= RECURS, ~related & (F.col("strong") | F.col("weak"))).otherwise(F.col("strong"))
    return member.join(judged.where(refuses).select("cluster"), "cluster", "left_semi").select("opening_id")


def defects(rows: DataFrame, key: str, prompt: str, answers: dict[str, str], model: Ecoc) -> DataFrame:
    """``key, field, defect``: a row per answer; ``defect`` is null where there is none.

    ``answers`` names the answer columns and the language each is to be in.  Null, blank and letterless answers
    are ``empty``; with a null or empty prompt nothing can be a copy; repeated rows get a row each, and count
    once as prompts; other columns are ignored; an empty table gives an empty one.  Writes tables of facts
    (without texts) to the shared folder.
    """
    facts = materialize(_facts(rows, key, prompt, answers, model), "pairs")
    refusing = _declining(facts).withColumn("refuses", F.lit(True))
    # sentences that stand complete somewhere, of those that some answer breaks off with
    open_ends = facts.where("not ended").select(F.col("last_id").alias("s")).distinct()
    whole = facts.select(F.explode("whole_ids").alias("s")).join(F.broadcast(open_ends) if _small(open_ends) else open_ends, "s", "left_semi").distinct().withColumn("whole", F.lit(True))
    j = facts.join(refusing, "opening_id", "left").join(whole, facts["last_id"] == whole["s"], "left")
    wrong = (F.col("letters") >= MIN_LETTERS) & (F.col("language") != F.col("expected"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    case: Column = F.when(F.col("is_empty"), "empty").when(yes("refuses"), "refusal").when(F.col("is_copy"), "copy").when(wrong, "wrong_language").when(~F.col("ended") & ~yes("whole"), "truncated")
    return j.select(F.col("key").alias(key), "field", case.alias("defect"))


#: Open endings are broadcast up to this many (8 bytes each), else joined by a shuffle.
SMALL = 1_000_000


def _small(df: DataFrame) -> bool:
    return df.limit(SMALL + 1).count() <= SMALL
