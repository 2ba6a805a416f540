"""Medical text: risk, abnormality against ranges by sex, patient details, tables in text, advice; simple checks of rewritten text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .legal import has_any, risk_score, stripped

# Words of danger, and values with their usual bounds.
DANGER = "life-threatening|emergency|urgent|immediate|critical|crisis|transfusion|severe".split("|")
VALUES = [
    (r"(?:hemoglobin|hb|hgb)\s*[:\-]?\s*(\d+\.?\d*)", 12.0, 17.0, "Hemoglobin"), (r"creatinine\s*[:\-]?\s*(\d+\.?\d*)", 0.7, 1.3, "Creatinine"),
    (r"(?:fasting|glucose|blood sugar)\s*[:\-]?\s*(\d+\.?\d*)", 70.0, 100.0, "Blood Sugar"), (r"(\d+)\s*/\s*\d+\s*(?:mmhg|mm hg)?", 90.0, 140.0, "Blood Pressure"),
]
FAILURES = ["i cannot", "i can't", "i'm unable", "as an ai", "i don't have", "please provide", "could you"]
NAME_PATTERNS = [r"(?i)(?:patient|name|pt)[\s:]+([A-Za-z\s\.]+?)(?:\s*,|\s*age|\s*\n|$)", r"(?i)(?:mr|mrs|ms|dr)\.?\s+([A-Za-z\s\.]+)"]
AGE_PATTERNS = [r"(?i)age[\s:]+(\d+)", r"(?i)(\d+)\s*(?:years?|yrs?)"]
GENDER_PATTERN = r"(?i)\b(male|female|m|f)\b"
DATE_PATTERNS = [r"(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})", r"(?i)(\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{2,4})"]


def medical_risk(text: Column) -> Column:
    """Struct of ``level, score``: a dangerous word, a late stage or a value far out of its bounds is critical; one well out is high."""
    low = F.lower(text)
    critical, high = F.when(has_any(low, DANGER), 1).otherwise(0), F.lit(0)
    for p, a, b, _ in VALUES:
        v = F.regexp_extract(low, p, 1).try_cast("double")
        off = F.when(v < a, (a - v) / a).when(v > b, (v - b) / b).otherwise(0.0)
        critical, high = critical + F.when(off > 0.5, 1).otherwise(0), high + F.when((off > 0.2) & (off <= 0.5), 1).otherwise(0)
    critical = critical + F.when(low.rlike(r"stage\s*[34]"), 1).otherwise(0)
    level = F.when(critical >= 1, "critical").when(high >= 1, "high").otherwise("low")
    return F.struct(level.alias("level"), risk_score(level).alias("score"))


def sex(c: Column) -> Column:
    """``male``, ``female`` or ``general``."""
    x = F.lower(F.trim(c))
    return F.when(x.isin("male", "m"), "male").when(x.isin("female", "f"), "female").otherwise("general")


def abnormality(value: Column, low: Column, high: Column, critical_low: Column, critical_high: Column) -> Column:
    """Struct of ``level, deviation`` (per cent beyond the bound); ``unknown`` without a value or a range."""
    off = F.when(value < low, (low - value) / low * 100).when(value > high, (value - high) / high * 100).otherwise(0.0)
    level = (
        F.when(value.isNull() | low.isNull() | high.isNull(), "unknown").when((value < critical_low) | (value > critical_high), "critical").when(value.between(low, high), "normal")
        .when(off > 50, "high").when(off > 25, "moderate").otherwise("mild")
    )
    return F.struct(level.alias("level"), F.when(level == "unknown", 0.0).otherwise(F.round(off, 6)).alias("deviation"))


def assess(results: DataFrame, ranges: DataFrame, test: str, value: str, gender: str) -> DataFrame:
    """``results`` with ``level, deviation``: the range of a test and sex, else the general one.

    ``ranges`` has ``test, sex, low, high, critical_low, critical_high``; both lookups are equi-joins whose small
    side Spark broadcasts below its own threshold.
    """
    r = ranges.select(F.col("test").alias("_t"), F.col("sex").alias("_s"), F.struct("low", "high", "critical_low", "critical_high").alias("_r"))
    own = results.withColumn("_sex", sex(F.col(gender))).join(r.withColumnRenamed("_r", "_own"), (F.col(test) == F.col("_t")) & (F.col("_sex") == F.col("_s")), "left").drop("_t", "_s")
    both = own.join(r.where("_s = 'general'").withColumnRenamed("_r", "_general"), F.col(test) == F.col("_t"), "left").drop("_t", "_s")
    x = F.coalesce("_own", "_general")
    return both.withColumn("_a", abnormality(F.col(value), x["low"], x["high"], x["critical_low"], x["critical_high"])).select(*results.columns, "_a.level", "_a.deviation")


def first_group(text: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that is found, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def patient_details(text: Column) -> Column:
    """Struct of ``name`` (at most 50 characters), ``age``, ``gender``, ``date`` as they stand first in a text."""
    g = F.lower(F.regexp_extract(text, GENDER_PATTERN, 1))
    return F.struct(
        F.substring(stripped(first_group(text, NAME_PATTERNS)), 1, 50).alias("name"), first_group(text, AGE_PATTERNS).alias("age"), F.when(g.isin("m", "male"), "male").when(g != "", "female").alias("gender"),
        first_group(text, DATE_PATTERNS).alias("date"),
    )


def looks_tabular(text: Column) -> Column:
    """Whether a text is a table: three lines or more that aren't blank, over 30 % of them (of the first 200) with a number."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))
    numeric = F.size(F.filter(F.slice(lines, 1, 200), lambda x: x.rlike(r"\d")))
    return (F.size(lines) >= 3) & (numeric / F.size(lines) > 0.3)


def rewrite_is_valid(original: Column, output: Column) -> Column:
    """Whether a rewritten text is usable: of sensible length, no echo of the prompt or the original, no phrase of refusal."""
    low = F.lower(output)
    return F.coalesce(
        (F.length(output) >= 15) & (F.length(output) <= F.length(original) * 2.5) & ~low.rlike("^(simplify|legal text)") & (stripped(low) != stripped(F.lower(original))) & ~has_any(low, FAILURES), F.lit(False)
    )


def fallback_reason(confidence: Column, language: Column, words: Column, text: Column, least: float) -> Column:
    """Why a scan should be read by another engine, ``none`` if it needn't."""
    return (
        F.when(confidence < least, "low_confidence").when(language.isin("hindi", "hindi-english"), "multilingual").when((words < 5) & (F.length(stripped(text)) > 50), "sparse_extraction").otherwise("none")
    )


def best_of(a: Column, b: Column, confidence: str = "confidence") -> Column:
    """The reading (struct) with the higher confidence; the first on a tie."""
    return F.when(F.coalesce(b[confidence], F.lit(-1.0)) > F.coalesce(a[confidence], F.lit(-1.0)), b).otherwise(a)


def advice(results: DataFrame, key: str, test: str, flag: str, order: str, most: int = 5) -> DataFrame:
    """``key, messages``: the number of abnormal results, then advice on known ones in order, at most ``most`` in all."""
    low, f = F.lower(F.col(test)), F.lower(F.col(flag))
    note = F.when(F.contains(low, F.lit("hemoglobin")) & (f == "low"), "Low hemoglobin: ask about anemia").when(F.contains(low, F.lit("glucose")) & (f == "high"), "High blood sugar: watch the diet").when(F.contains(low, F.lit("creatinine")) & (f == "high"), "High creatinine: ask about the kidneys")
    n = results.groupBy(key).agg(F.count_if(f.isin("low", "high")).alias("n"))
    w = Window.partitionBy(key).orderBy(order)
    notes = results.select(key, F.col(order), note.alias("m")).where("m is not null").withColumn("r", F.row_number().over(w)).where(F.col("r") < most)
    kept = notes.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "m"))), lambda x: x["m"]).alias("ms"))
    head = F.array(F.format_string("%d abnormal results", F.col("n")))
    return n.join(kept, key, "left").select(key, F.when(F.col("n") == 0, F.lit("All results within normal ranges")).otherwise(F.array_join(F.concat(head, F.coalesce("ms", F.array().cast("array<string>"))), "; ")).alias("messages"))
