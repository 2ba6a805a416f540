"""Dictionaries: nearest words, masking of what must be kept, term look-up in tiers, ordered rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Rules, cleaned

# What must be kept through correction (pattern, kind), in order.
KEPT = [
    (r"(?:\+91[\s.-]?)?[6-9]\d{4}[\s.-]?\d{5}", "PHONE"), (r"\b\d{3}[\s.-]?\d{3}[\s.-]?\d{4}\b", "PHONE"), (r"\b0\d{2,4}[\s.-]?\d{6,8}\b", "PHONE"), (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "EMAIL"),
    (r"https?://[^\s<>\"{}|\\^`\[\]]+", "URL"), (r"www\.[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}[^\s]*", "URL"), (r"(?:Section|Article|Clause)\s+\d+[A-Za-z]?(?:\s*\([a-z0-9]+\))?", "LEGAL_REF"), (r"Rule\s+\d+[A-Za-z]?", "LEGAL_REF"),
    (r"Schedule\s+[IVX]+|Schedule\s+\d+", "LEGAL_REF"), (r"\b[A-Z]{2,5}[-/]\d{2,}[-/]?\d*[-/]?\d*\b", "DOC_NUMBER"), (r"\b\d{6}\b", "PINCODE"), (r"\b[A-Z]{5}\d{4}[A-Z]\b", "PAN"),
    (r"\b\d{4}\s?\d{4}\s?\d{4}\b", "AADHAAR"), (r"\b\d{8,18}\b", "ACCOUNT"), (r"\b[A-Z]{4}0[A-Z0-9]{6}\b", "IFSC"),
]


def kept_spans(text: Column) -> Column:
    """Distinct spans to be kept, as ``array<struct<kind, span>>`` in the order of their patterns."""
    per = [_spans(text, p, k) for p, k in KEPT]
    return F.concat(*per)


def _spans(text: Column, pattern: str, kind: str) -> Column:
    return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("span")))


def _marked(spans: Column) -> Column:
    """The spans with their placeholders; a span that is part of an earlier one stands for itself there."""
    return F.transform(spans, lambda s, i: F.struct(s["span"].alias("span"), F.concat(F.lit("__PRESERVED_"), s["kind"], F.lit("_"), i.cast("string"), F.lit("__")).alias("mark")))


def masked(text: Column, spans: Column) -> Column:
    """The text with each kept span replaced by its placeholder."""
    return F.aggregate(_marked(spans), text, lambda t, s: F.replace(t, s["span"], s["mark"]))


def restored(text: Column, spans: Column) -> Column:
    """The inverse of ``masked``: placeholders, last first, replaced by their spans."""
    return F.aggregate(F.reverse(_marked(spans)), text, lambda t, s: F.replace(t, s["mark"], s["span"]))


def corrected(text: Column, rules: Rules) -> Column:
    """Rules applied in order to a text whose kept spans are masked meanwhile; null stays null."""
    spans = kept_spans(text)
    return restored(cleaned(masked(text, spans), rules), spans)


def nearest_words(words: DataFrame, word: str, dictionary: DataFrame, most: int = 2) -> DataFrame:
    """``word, term, distance``: the dictionary term within ``most`` edits: nearest, then most frequent, then first.

    Distinct words meet terms on their deletion neighbourhood: two strings within one edit share a form with at most
    one letter left out each, and within two edits one with at most two; so no pair is compared that can't be near.
    Words without a near term give no row.
    """
    def forms(c: str) -> Column:
        x = F.col(c)
        spots = F.sequence(F.lit(1), F.length(x))
        cut = lambda s, at: F.concat(F.substring(s, F.lit(1), at - 1), F.substring(s, at + 1, F.length(s)))
        single = F.transform(spots, lambda i: cut(x, i))
        every = F.array_union(F.array(x), single)
        if most > 1:
            every = F.array_union(every, F.flatten(F.transform(single, lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: cut(s, i))).otherwise(F.array(F.lit(""))))))
        return F.array_distinct(every)

    w = words.select(F.col(word).alias("_w")).where("_w is not null and _w <> ''").distinct().select("_w", F.explode(forms("_w")).alias("_f"))
    d = dictionary.select(F.col("term").alias("_t"), "n").where("_t is not null and _t <> ''").select("_t", "n", F.explode(forms("_t")).alias("_f"))
    near = w.join(d, "_f").select("_w", "_t", "n").distinct().withColumn("distance", F.levenshtein("_w", "_t", most)).where(F.col("distance").between(0, most))
    best = near.withColumn("_r", F.row_number().over(Window.partitionBy("_w").orderBy("distance", F.desc("n"), "_t"))).where("_r = 1")
    return best.select(F.col("_w").alias(word), F.col("_t").alias("term"), "distance")


def looked_up(terms: DataFrame, term: str, dictionary: DataFrame) -> DataFrame:
    """``term, key, tier`` for every distinct term: an equal key, else an equal alias, else the first key in order that
    contains it or is in it; null where nothing fits.  ``dictionary`` has ``key, aliases, ord``."""
    t = terms.select(F.lower(F.trim(term)).alias("_q")).where("_q is not null and _q <> ''").distinct()
    d = dictionary.select(F.lower("key").alias("_k"), "key", "ord", F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a)).alias("_a"))
    exact = t.join(d, F.col("_q") == F.col("_k")).groupBy("_q").agg(F.min_by("key", "ord").alias("_1"))
    alias = t.join(d.select("key", "ord", F.explode("_a").alias("_x")), F.col("_q") == F.col("_x")).groupBy("_q").agg(F.min_by("key", "ord").alias("_2"))
    rest = t.join(exact, "_q", "left_anti").join(alias, "_q", "left_anti")
    part = rest.join(d, F.contains("_q", "_k") | F.contains("_k", "_q")).groupBy("_q").agg(F.min_by("key", "ord").alias("_3"))
    j = t.join(exact, "_q", "left").join(alias, "_q", "left").join(part, "_q", "left")
    return j.select(F.col("_q").alias(term), F.coalesce("_1", "_2", "_3").alias("key"), F.when(F.col("_1").isNotNull(), "exact").when(F.col("_2").isNotNull(), "alias").when(F.col("_3").isNotNull(), "partial").otherwise("none").alias("tier"))
