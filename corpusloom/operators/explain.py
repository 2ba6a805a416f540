"""Explanations and small judgements: laws in plain words, contexts of citations, ensembles of domain scores, display levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .legal import stripped

# What a law is about, by the first words found in its name.
ABOUT = [
    ("transfer of property", "This law governs how property (including rental agreements) can be transferred, leased, or sold."), ("contract", "This law defines what makes a valid contract and the rights/obligations of parties."),
    ("rent", "This law protects tenants and landlords, regulating rent amounts and eviction procedures."), ("registration", "This law requires certain documents to be officially registered to be legally valid."),
    ("stamp", "This law requires payment of stamp duty on legal documents for them to be valid in court."), ("arbitration", "This law provides for dispute resolution through arbitration instead of courts."),
    ("consumer", "This law protects consumers against unfair trade practices and defective goods/services."), ("evidence", "This law defines what evidence is admissible in court proceedings."),
    ("limitation", "This law sets time limits within which legal cases must be filed."), ("constitution", "This refers to the Constitution of India, the supreme law of the land."),
    ("penal code", "This is the main criminal code of India defining offenses and penalties."), ("civil procedure", "This law governs the procedure for civil court cases."),
]
ADVICE = "Consult a legal professional for detailed interpretation."
#: Weights of keywords, prototypes and a zero-shot model in an ensemble, with and without the last; least probability.
WEIGHTS, WEIGHTS_WITH_MODEL, LEAST = (0.35, 0.65, 0.0), (0.30, 0.50, 0.20), 0.55
SHARPNESS = 5.0


def law_explanation(law: Column, section: Column, article: Column, year: Column) -> Column:
    """A plain explanation of a citation: what the law is about, its section, article and year, and advice."""
    low, out = F.lower(law), F.concat(F.lit("This is a legal reference to "), law, F.lit("."))
    for words, told in reversed(ABOUT):
        found = F.contains(low, F.lit(words))
        out = F.when(found | (F.coalesce(article, F.lit("")) != "") if words == "constitution" else found, told).otherwise(out)
    put = lambda c, pre, post: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(pre), c, F.lit(post)))
    return F.concat_ws(
        " ", out, put(section, "Section ", " contains specific provisions relevant to this context."), put(article, "Article ", " of the Constitution is referenced here."), put(year, "This law was enacted in ", "."), F.lit(ADVICE)
    )


def context(text: Column, found: Column, around: int = 100) -> Column:
    """The first place of ``found`` in a text with up to ``around`` characters on either side, stripped; null where it isn't there."""
    at = F.locate(found, text) if isinstance(found, str) else F.position(found, text)
    start = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, stripped(F.substring(text, start, at + F.length(found) + around - start)))


def density(score: Column, words: Column) -> Column:
    """A weighted keyword sum over the root of the number of words."""
    return score / F.sqrt(F.greatest(words, F.lit(1)).cast("double"))


def ensemble(keyword: tuple[Column, Column], cosine: tuple[Column, Column], model: tuple[Column, Column] | None = None) -> Column:
    """Struct of ``domain, confidence, legal, medical``: a weighted mean of keyword shares, sharpened prototype
    similarities and, if given, a model's probabilities; ``unknown`` below ``LEAST``."""
    w = WEIGHTS_WITH_MODEL if model else WEIGHTS
    total = keyword[0] + keyword[1] + 0.001
    exp = [F.exp(SHARPNESS * c) for c in cosine]
    p = [w[0] * k / total + w[1] * e / (exp[0] + exp[1]) for k, e in zip(keyword, exp)]
    if model:
        p = [a + w[2] * m for a, m in zip(p, model)]
    legal, medical = p[0] / (p[0] + p[1]), p[1] / (p[0] + p[1])
    best = F.greatest(legal, medical)
    name = F.when(best < LEAST, "unknown").when(legal > medical, "legal").otherwise("medical")
    return F.struct(name.alias("domain"), F.when(best < LEAST, 1 - best).otherwise(best).alias("confidence"), legal.alias("legal"), medical.alias("medical"))


def shown_level(level: Column) -> Column:
    """How a level is shown: by the first of critical, high, medium and low that its text contains, else ``none``."""
    low, out = F.lower(level), F.lit("none")
    for k in ("low", "medium", "high", "critical"):
        out = F.when(F.contains(low, F.lit(k)), k).otherwise(out)
    return out


def wrong_domain(errors: Column, other: str) -> Column:
    """Whether any of a result's errors speaks of the other domain."""
    return F.coalesce(F.contains(F.lower(F.array_join(errors, " ")), F.lit(other)), F.lit(False))


def summary_line(level: Column, score: Column) -> Column:
    """``Risk: high (75%)``."""
    return F.concat(F.lit("Risk: "), level, F.lit(" ("), F.floor(score * 100 + 0.5).cast("long").cast("string"), F.lit("%)"))


def short_sentences(text: Column) -> Column:
    """Sentences cut after ``.!?``; titles and ``No.`` lose their full stop first."""
    t = F.regexp_replace(F.regexp_replace(text, r"\b(Rs|Mr|Mrs|Dr|No)\.", "$1"), r"w\.e\.f\.?", "from")
    return F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+"), stripped), lambda s: s != "")
