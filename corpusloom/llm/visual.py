"""One consistent form for texts that look the same but are stored with different characters.

The form is made of compatibility normalisation (composed), look-alike letters,
mapped white space, removal of default-ignorable characters and full case
folding, applied once per distinct value of a batch.  Without the case folding
it is the *look* of a text: two texts look the same if their looks are equal.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

# Letters drawn like Latin ones (Greek, Cyrillic, Armenian, others), and hyphens drawn alike.
LOOK_ALIKE = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԁ": "D", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y", "ѵ": "v", "ԍ": "g",
    "Օ": "O", "Ս": "U", "Լ": "L", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "ա": "w", "ı": "i", "ɡ": "g", "ɑ": "a", "ɩ": "i",
    "‐": "-", "‑": "-", "‒": "-", "−": "-", "﹣": "-", "⁃": "-",
}
# The default-ignorable characters.
IGNORABLE = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
_IGNORE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in IGNORABLE) + "]")
_ASCII_SPACE = str.maketrans("\t\x0b\x0c", "   ")
_BREAK = re.compile("\r\n|[\r\x85  ]")


@lru_cache(maxsize=1)
def _table() -> dict[str, str]:
    spaces = {chr(c): " " for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Zs" and c != 32}
    return spaces | dict.fromkeys("\t\x0b\x0c", " ") | LOOK_ALIKE


def _mapped(text: str) -> str:
    """White space and look-alike letters mapped; only characters that occur are touched."""
    table = _table()
    for c in table.keys() & set(text):
        text = text.replace(c, table[c])
    return text


def look(text: str) -> str:
    """The text as it looks: equal for texts that can't be told apart by eye (full and normal width alike)."""
    t = _BREAK.sub("\n", text)
    if t.isascii():
        return t.translate(_ASCII_SPACE)
    t = _IGNORE.sub("", t)
    if not unicodedata.is_normalized("NFKC", t):
        t = _IGNORE.sub("", unicodedata.normalize("NFKC", t))
    return unicodedata.normalize("NFC", _mapped(t))


def _folded(t: str) -> str:
    """A look in consistent form."""
    if t.isascii():
        return t.lower()
    c = t.casefold()
    return c if c == t else unicodedata.normalize("NFC", _mapped(unicodedata.normalize("NFKC", c)))


def canonical(text: str) -> str:
    """The consistent form: the look, case-folded in full and composed again."""
    return _folded(look(text))


def _digest(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _three(text: str) -> tuple[bytes, bytes, bytes]:
    """Digests of a text as stored, of its look and of its form; equal strings are digested once."""
    seen = look(text)
    form = _folded(seen)
    a = _digest(text)
    b = a if seen == text else _digest(seen)
    return a, b, b if form == seen else _digest(form)


def _per_distinct(texts: pd.Series, f) -> pd.Series:
    codes, distinct = pd.factorize(texts)
    done = pd.Series([f(t) for t in distinct] + [None], dtype=object)
    return done.iloc[codes].reset_index(drop=True)


@F.pandas_udf(T.StringType())
def canonical_text(texts: pd.Series) -> pd.Series:
    """``canonical`` of a column, once per distinct value; null stays null."""
    return _per_distinct(texts, canonical)


@F.pandas_udf(T.StructType([T.StructField(n, T.BinaryType()) for n in ("stored", "look", "form")]))
def _digests(texts: pd.Series) -> pd.DataFrame:
    rows = _per_distinct(texts, lambda t: _three(t))
    return pd.DataFrame([r if isinstance(r, tuple) else (None, None, None) for r in rows], columns=["stored", "look", "form"])


def appearances(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, stored, look, form``: 128-bit digests of each text as stored, as it looks and in consistent form.

    Texts themselves never leave their partition.  Null texts give no row; empty ones, and texts of nothing but
    ignorable characters, look like one another; other columns are ignored; an empty table gives an empty one.
    """
    d = rows.where(F.col(text).isNotNull()).select(F.col(key).alias(key), _digests(F.col(text)).alias("_d"))
    return d.select(key, "_d.stored", "_d.look", "_d.form")


def look_classes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, class_id, n_docs, n_stored``: the class of equal-looking texts of each row and its size.

    Counts are taken per stored form first, so a text that fills a third of the table is one row by then.
    """
    a = materialize(appearances(rows, key, text), "looks")
    per = a.groupBy("form", "look", "stored").agg(F.count("*").alias("n"), F.min(key).alias("first"))
    sums = per.groupBy("form", "look").agg(F.sum("n").alias("n_docs"), F.count("*").cast("int").alias("n_stored"), F.min("first").alias("class_id"))
    return a.join(sums, ["form", "look"]).select(key, "class_id", "n_docs", "n_stored")


#: Salts over which the members of one stored form are spread.
SALTS = 32


def look_alike_pairs(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs ``key_a < key_b`` of rows whose texts look the same but aren't stored alike.

    Classes are found by the consistent form, then told apart by look.  Only pairs of *stored forms* are made
    within a class, and each is then joined with the forms' members, spread over ``SALTS``, so exact copies meet
    nobody but the members of another form (those pairs are the result).  Writes one table of digests to the
    shared folder.
    """
    a = materialize(appearances(rows, key, text), "looks")
    forms = a.groupBy("form", "look", "stored").agg(F.count("*").alias("n"))
    mixed = forms.groupBy("form", "look").agg(F.count("*").alias("k")).where("k > 1").select("form", "look")
    some = forms.join(mixed, ["form", "look"])
    left, right = some.select("form", "look", F.col("stored").alias("s1")), some.select("form", "look", F.col("stored").alias("s2"))
    pairs = left.join(right, ["form", "look"]).where(F.col("s1") < F.col("s2")).select("s1", "s2")
    salt = F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")
    members = a.join(some.select("stored").distinct(), "stored", "left_semi").select("stored", F.col(key).alias("_k"), salt.alias("_salt"))
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    one = pairs.withColumn("_salt", every).join(members.select(F.col("stored").alias("s1"), F.col("_k").alias("_x"), "_salt"), ["s1", "_salt"]).select("s2", "_x")
    both = one.withColumn("_salt", every).join(members.select(F.col("stored").alias("s2"), F.col("_k").alias("_y"), "_salt"), ["s2", "_salt"])
    return both.select(F.least("_x", "_y").alias(f"{key}_a"), F.greatest("_x", "_y").alias(f"{key}_b"))
