"""Queries of the llm operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, table
from . import language, leakage, mixing, pairs, pii, scans, splitting, visual

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _language_model(spark: SparkSession, d: str) -> language.Ecoc:
    return language.train([
        language.labelled_sample(table(spark, d, "ocr_results"), "text", "language"),
        language.labelled_sample(table(spark, d, "documents"), "text", "lang"),
    ])


def _languages(spark: SparkSession, d: str) -> DataFrame:
    return language.detect(table(spark, d, "ocr_results"), "ocr_id", "text", "language", _language_model(spark, d))


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Scanned texts with a missing or wrong language label, and all blocks of texts in several languages."""
    return language.relabelled(_languages(spark, d), "ocr_id")


@query
def p1_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every text and block."""
    return _languages(spark, d).select("ocr_id", "segment_no", "language", F.round("confidence", 4).alias("confidence"), "ambiguous")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    clauses = table(spark, d, "clauses").select(F.lit("clauses").alias("origin"), F.col("clause_id").alias("item_id"), F.col("content").alias("text"))
    results = table(spark, d, "clause_results").select(F.lit("clause_results").alias("origin"), F.col("result_id").alias("item_id"), F.col("original").alias("text"))
    return splitting.split_texts(clauses.unionByName(results), ["origin", "item_id"], "text")


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that had to be cut into pieces."""
    return _pieces(spark, d).select("origin", "item_id").distinct()


ORACLE["p3_found"] = """
SELECT 'clauses' AS origin, clause_id AS item_id FROM clauses WHERE length(content) > 1200
UNION SELECT 'clause_results', result_id FROM clause_results WHERE length(original) > 1200
"""


@query
def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all texts over the limit, in order, with their offsets."""
    return _pieces(spark, d)


@query
def p3_files(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of giant files, read by byte ranges: all oversized texts, written a few files to the shared folder."""
    c = table(spark, d, "clauses").select(F.col("clause_id").alias("id"), F.col("content").alias("text"))
    r = table(spark, d, "clause_results").select(F.col("result_id").alias("id"), F.col("original").alias("text"))
    path = f"{shared_dir(spark)}/giants-{uuid.uuid4().hex}"
    c.unionByName(r).where(F.length("text") > splitting.LIMIT).select("text").repartition(4, F.xxhash64("text")).sortWithinPartitions("text").write.text(path)
    part = F.regexp_extract("path", r"part-(\d+)", 1).cast("int")
    return splitting.split_files(spark, path).select(part.alias("file_no"), "piece_no", "start", "end", "natural", "piece")


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents whose texts look the same but are stored with different characters."""
    return visual.look_alike_pairs(table(spark, d, "documents"), "doc_id", "text").distinct()


_FROM = "".join(visual.LOOK_ALIKE) + "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u00a0\u2007\u2009\u202f"
_TO = "".join(visual.LOOK_ALIKE.values()) + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "    "
ORACLE["p10_found"] = f"""
WITH f AS (SELECT doc_id, text, nfc_normalize(replace(replace(translate(regexp_replace(text, '[\u00ad\u200b-\u200f\u2060-\u206f\ufeff]', '', 'g'),
  '{_FROM.replace("'", "''")}', '{_TO.replace("'", "''")}'), 'ﬁ', 'fi'), 'ﬂ', 'fl')) AS seen FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.seen = b.seen AND a.doc_id < b.doc_id AND a.text <> b.text
"""


@query
def p10_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text in its consistent form."""
    return table(spark, d, "documents").select("doc_id", visual.canonical_text("text").alias("canonical"))


@query
def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of equal-looking texts of every document, with its size."""
    return visual.look_classes(table(spark, d, "documents"), "doc_id", "text")


PERSONAL = [("medical_reports", "row_id", "patient_name"), ("ocr_results", "ocr_id", "text"), ("clause_results", "result_id", "original")]


def _personal(spark: SparkSession, d: str) -> DataFrame:
    parts = [pii.find(table(spark, d, t), k, c, field=c == "patient_name").select(F.lit(t).alias("origin"), F.col(k).alias("row_id"), "mentions", "redacted") for t, k, c in PERSONAL]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct mention of personal data in the three text columns."""
    m = _personal(spark, d).select("origin", "row_id", F.explode("mentions").alias("m"))
    return m.select("origin", "row_id", "m.kind", "m.mention").distinct()


@query
def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts with each mention replaced by a placeholder of its type."""
    return _personal(spark, d).select("origin", "row_id", "redacted", F.size("mentions").alias("n_mentions"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with 13 or more consecutive words of an evaluation item, or all of a shorter one."""
    return _leaks(spark, d).where("kind = 'verbatim'").select("doc_id", "item_id").distinct()


@query
def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """All leaks with their evidence, paraphrases included."""
    return _leaks(spark, d)


ANSWERS = {"simplified": "en", "colloquial": "en", "hindi_formal": "hi"}


def _defects(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "clause_results"), "result_id", "original", ANSWERS, _language_model(spark, d))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective answers with the first defect that holds."""
    return _defects(spark, d).where("defect is not null").distinct()


@query
def p5_summary(spark: SparkSession, d: str) -> DataFrame:
    """Answers per field and defect ("none" where there is none)."""
    return _defects(spark, d).groupBy("field", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("n_answers"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_targets"))


@query
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixed set: which tokens of which document stand at each position of each shard."""
    return _mix(spark, d)[0]


@query
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source, and how often its documents were used at most."""
    return _mix(spark, d)[1]


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Broken words, misread words, running headers and page numbers of the scanned texts."""
    return scans.find(table(spark, d, "ocr_results"), "ocr_id", "text").select("ocr_id", "kind", "item").distinct()


@query
def p7_text(spark: SparkSession, d: str) -> DataFrame:
    """The scanned texts repaired into continuous paragraphs."""
    return scans.paragraphs(table(spark, d, "ocr_results"), "ocr_id", "text")
