"""Clean-up of text as chains of built-in expressions, and the same chains as SQL.

A chain is a list of (pattern, replacement) applied in order with every match
replaced.  Patterns keep to what Java and RE2 share, so that ``as_sql`` gives the
text of an equivalent SQL expression for a second engine.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Rules = list[tuple[str, str]]

# The clean-up steps, in the order in which they must be applied.
WHITESPACE: Rules = [(r"[ \t\x{a0}\x{200b}]+", " "), (r"\n\s*\n\s*\n+", "\n\n"), (r"(?m)[ \t]+$", ""), (r"(?m)^[ \t]+", ""), (r"^\s+|\s+$", "")]
PAGE_ARTIFACTS: Rules = [(r"\n\s*\d+\s*\n", "\n"), (r"(?i)Page\s+\d+(\s+of\s+\d+)?", ""), (r"(?m)^[-_=]{3,}$", ""), (r"(?i)\(continued\)", ""), (r"(?i)continued from page \d+", "")]
PUNCTUATION: Rules = [
    ("—", "-"), ("–", "-"), ("…", "..."), ("°", "degree"), (r"([.!?,;:])([A-Z])", r"$1 $2"), (r"\.{2,}", "..."), (r"\?{2,}", "?"), (r"!{2,}", "!"), (r"\s+([.!?,;:])", r"$1"), (r",([^\s\d])", r", $1"),
]
LEGAL_TERMS: Rules = [(rf"(?i)\b{w.lower()}\b", w) for w in ("Landlord", "Tenant", "Lessor", "Lessee", "Agreement", "Contract", "Party", "Parties")]
EXTRACTED: Rules = [(r"\n\s*\d+\s*\n", "\n"), (r"(?i)Page\s+\d+\s+of\s+\d+", ""), (r"\n\s*\n\s*\n+", "\n\n"), (r" +", " "), (r"(?m)^[-_=]+$", ""), (r"^\s+|\s+$", "")]
EXTRACTED_SCAN: Rules = [
    (r" +", " "), (r"\n\s*\n\s*\n+", "\n\n"), (r"[|]{2,}", ""), (r"_{3,}", ""), (r"={3,}", ""), (r"\n\s*\d+\s*\n", "\n"), (r"(?i)Page\s+\d+", ""), (r"\n\s*[^\w\s]\s*\n", "\n"), (r"^\s+|\s+$", ""),
]
SCAN: Rules = [
    (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]", ""), (r" +", " "), (r"\n\s*\n\s*\n+", "\n\n"), (r"(\d)[lI](\d)", r"${1}1$2"), (r"Rs\s*\.?\s*", "Rs. "), (r"(\d),(\d{3})", r"$1$2"), (r"^\s+|\s+$", ""),
]
SPELLING_BEFORE: Rules = [(r" +", " "), (r"\n\s*\n\s*\n+", "\n\n"), (r"^\s+|\s+$", "")]
SPELLING_AFTER: Rules = [(r"\s+([.!?,;:])", r"$1"), (r"([.!?,;:])([A-Za-z])", r"$1 $2"), (r"^\s+|\s+$", "")]
SPACING: Rules = [(r"(\w)\s+([.,;:!?])", r"$1$2"), (r"([.,;:!?])\s{2,}", r"$1 "), (r"\(\s+", "("), (r"\s+\)", ")"), (r"\s{3,}", "  "), (r"(\n\s*){3,}", "\n\n")]
FINAL: Rules = [(r" +", " "), (r"\s+([.!?,;:])", r"$1"), (r"([.!?,;:])([A-Za-z])", r"$1 $2"), ("[“”\"]", '"'), ("[‘’']", "'"), (r"(?m)[ \t]+$", ""), (r"(?m)^[ \t]+", ""), (r"^\s+|\s+$", "")]
STANDARD: Rules = [*PUNCTUATION, *WHITESPACE, *PAGE_ARTIFACTS, *LEGAL_TERMS, (r"^\s+|\s+$", "")]
MINIMAL: Rules = [*WHITESPACE, *PAGE_ARTIFACTS, (r"^\s+|\s+$", "")]
CHAINS: dict[str, Rules] = {
    "whitespace": WHITESPACE, "page_artifacts": PAGE_ARTIFACTS, "punctuation": PUNCTUATION, "legal_terms": LEGAL_TERMS, "extracted": EXTRACTED, "extracted_scan": EXTRACTED_SCAN, "scan": SCAN,
    "spelling_before": SPELLING_BEFORE, "spelling_after": SPELLING_AFTER, "spacing": SPACING, "final": FINAL, "standard": STANDARD, "minimal": MINIMAL,
}
GARBAGE = [r"[^\w\s,.;:!?()'\"-]{3,}", r"(?i)[bcdfghjklmnpqrstvwxz]{6,}", r"(?i)(?:\d[a-z]\d[a-z]){2,}", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"]


def cleaned(text: Column, rules: Rules) -> Column:
    """A chain applied to a column; null stays null."""
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def as_sql(expr: str, rules: Rules) -> str:
    """The SQL expression of a chain, for an engine with RE2 patterns."""
    for pattern, to in rules:
        to = re.sub(r"\$\{(\d)\}|\$(\d)", lambda m: "\\" + (m[1] or m[2]), to)
        expr = f"regexp_replace({expr}, {quoted(pattern)}, {quoted(to)}, 'g')"
    return expr


def without_garbage(text: Column) -> Column:
    """Matches of the garbage patterns without digits and under 20 characters, each replaced everywhere by a blank."""
    for p in GARBAGE:
        found = F.filter(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m: (F.length(m) < 20) & ~m.rlike(r"\d"))
        text = F.aggregate(found, text, lambda t, m: F.replace(t, m, F.lit(" ")))
    return text


def _ascii(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def ascii_only(text: Column) -> Column:
    """Compatibility decomposition without what is not ASCII (an Arrow function: there is no built-in one)."""
    return F.pandas_udf(_ascii, T.StringType())(text)


def sentences(text: Column) -> Column:
    """Sentences: cut after ``.!?`` and white space before a capital; stripped, empty ones dropped."""
    parts = F.split(text, r"(?<=[.!?])\s+(?=[A-Z])")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def word_count(text: Column) -> Column:
    """Runs of anything but white space; null gives null, blank text 0."""
    return F.regexp_count(text, F.lit(r"\S+"))


def script_language(text: Column) -> Column:
    """``hindi`` beyond 0.3 Devanagari characters to word characters, ``hindi-english`` beyond 0.1, ``unknown`` without any."""
    total = F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]")).cast("double")
    share = F.regexp_count(text, F.lit(r"[\x{0900}-\x{097F}]")) / F.nullif(total, F.lit(0.0))
    return F.when(text.isNull(), None).when(total == 0, "unknown").when(share > 0.3, "hindi").when(share > 0.1, "hindi-english").otherwise("english")


def line_is_clean(line: Column) -> Column:
    """Whether a line needs no correction: mostly no letters, short, or without signs of misreading."""
    n, low = F.length(line), F.lower(line)
    letters = F.regexp_count(line, F.lit(r"\p{L}"))
    odd = F.regexp_count(line, F.lit(r"""[^\p{L}\p{N} .,;:'"\-()]"""))
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    bad = low.rlike("xz|qx|zx|jq|vx") | (odd > n * 0.15) | padded.rlike(" [qxz] ")
    return (n == 0) | (letters < n * 0.3) | (n < 10) | ~bad


def correction_stats(before: Column, after: Column) -> Column:
    """Words and characters before and after, and the reduction in per cent (one decimal)."""
    n = F.length(before)
    return F.struct(
        word_count(before).alias("words_before"), word_count(after).alias("words_after"), n.alias("chars_before"), F.length(after).alias("chars_after"),
        F.when(n > 0, F.round((1 - F.length(after) / n) * 100, 1)).otherwise(0.0).alias("reduction"),
    )
