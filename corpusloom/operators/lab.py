"""Laboratory reports: lines into results, ranges, flags, explanations and per-report counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .legal import stripped

# Critical thresholds, flag marks, lines that hold no result, number and unit patterns.
CRITICAL = {
    "Hemoglobin": (7.0, 20.0), "Fasting Blood Sugar": (50.0, 400.0), "Serum Creatinine": (None, 10.0), "Serum Potassium": (2.5, 6.5), "Serum Sodium": (120.0, 160.0),
    "Platelet Count": (50000.0, 1000000.0), "White Blood Cell Count": (2000.0, 30000.0), "INR": (None, 5.0), "Troponin": (None, 0.4),
}
FLAG_MARKS = [(r"\b(LOW|L)\b", "low"), (r"\b(HIGH|H)\b", "high"), (r"\b(NORMAL|N)\b", "normal"), (r"\b(CRITICAL|CRIT|PANIC)\b", "critical_high"), (r"\*+", "high"), ("↓|⬇|▼", "low"), ("↑|⬆|▲", "high")]
SKIPPED = r"^(page\s+\d+|date[:\s]|name[:\s]|age[:\s]|sex[:\s]|sample|collected|reported|doctor|ref\.\s*(?:by|doctor)|\*+$|[-=_]+$)"
NUMBER = r"[-+]?\d+\.?\d*"
UNIT = (
    r"(?i)(?:g/dl|gm/dl|gm%|g%|mg/dl|mg%|cells?/c?u?mm|/c?u?mm|mill(?:ion)?/c?u?mm|lakhs?/c?u?mm|thou(?:sand)?/c?u?mm|[km]?/[uμµ]l|fl|pg|%|[iu]u/[lm][l]?|u/l|m?[iu]u/ml|[uμµ]iu/ml|n[g]/[md]l|pg/ml|m?eq/l|mmol/l|mm/(?:1st\s*)?h(?:ou)?r|sec(?:onds?)?|ratio)"
)
RANGES = [rf"({NUMBER})\s*[-–—to]+\s*({NUMBER})", rf"([<>≤≥])\s*({NUMBER})"]


def reference_range(text: Column) -> Column:
    """Struct of ``low, high, raw``: ``a - b`` first, else a bound ``<x`` or ``>x``; nulls and empty where there is none."""
    g = lambda p, n: F.regexp_extract(text, p, n)
    two, sign = text.rlike(RANGES[0]), g(RANGES[1], 1)
    bound = g(RANGES[1], 2).try_cast("double")
    low = F.when(two, g(RANGES[0], 1).try_cast("double")).when(sign.isin(">", "≥"), bound)
    high = F.when(two, g(RANGES[0], 2).try_cast("double")).when(sign.isin("<", "≤"), bound)
    return F.struct(low.alias("low"), high.alias("high"), F.when(two, g(RANGES[0], 0)).otherwise(g(RANGES[1], 0)).alias("raw"))


def printed_flag(text: Column) -> Column:
    """The first flag mark found in a line, else ``unknown``."""
    up, out = F.upper(text), F.lit("unknown")
    for p, v in reversed(FLAG_MARKS):
        out = F.when(up.rlike(p), v).otherwise(out)
    return F.when(text.isNotNull(), out).otherwise("unknown")


def calculated_flag(value: Column, low: Column, high: Column, test: Column) -> Column:
    """Flag of a value: critical thresholds of its test first, then the reference range; ``unknown`` without either or a value."""
    lows = F.create_map(*[F.lit(x) for t, (a, _) in CRITICAL.items() if a is not None for x in (t, a)])
    highs = F.create_map(*[F.lit(x) for t, (_, b) in CRITICAL.items() if b is not None for x in (t, b)])
    return (
        F.when(value.isNull() | F.isnan(value), "unknown").when(value < F.try_element_at(lows, test), "critical_low").when(value > F.try_element_at(highs, test), "critical_high")
        .when(value < low, "low").when(value > high, "high").when(low.isNotNull() | high.isNotNull(), "normal").otherwise("unknown")
    )


def parse_lines(docs: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """``key, line_number, test_name, test_name_standardized, value, unit, ref_low, ref_high, flag, flag_source``: the results in reports' lines.

    ``names`` (``alias, standard, ord``, broadcast by Spark's own size check) gives standard names: an equal alias
    first, else the first that contains the name or is contained in it; unknown names stay as printed.  Lines
    without a number or a name, headers and lines under five characters give no row.
    """
    lines = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), "\n")).alias("p", "_l")).select(key, (F.col("p") + 1).alias("line_number"), stripped(F.col("_l")).alias("raw"))
    kept = lines.where((F.length("raw") >= 5) & ~F.lower("raw").rlike(SKIPPED) & F.col("raw").rlike(r"\d"))
    name = F.regexp_replace(stripped(F.regexp_replace(stripped(F.regexp_extract("raw", rf"^(.*?)(?=[-+]?\d)", 1)), r"[:\-_]+$", "")), r"\s+", " ")
    # a number glued to letters belongs to the name (B12)
    value = F.regexp_extract("raw", rf"(?<![A-Za-z]{{1}})({NUMBER})", 1).try_cast("double")
    rng = reference_range(F.col("raw"))
    base = kept.select(key, "line_number", "raw", name.alias("test_name"), value.alias("value"), F.regexp_extract("raw", UNIT, 0).alias("unit"), rng.alias("r"), printed_flag(F.col("raw")).alias("ocr"))
    base = base.where((F.length("test_name") >= 2) & F.col("value").isNotNull()).withColumn("_n", F.lower("test_name"))
    std = standard_names(base.select("_n").distinct(), names)
    j = base.join(std, "_n", "left").withColumn("test_name_standardized", F.coalesce("standard", "test_name"))
    calc = calculated_flag(F.col("value"), F.col("r.low"), F.col("r.high"), F.col("test_name_standardized"))
    return j.select(
        key, "line_number", "test_name", "test_name_standardized", "value", "unit", F.col("r.low").alias("ref_low"), F.col("r.high").alias("ref_high"),
        F.when(F.col("ocr") == "unknown", calc).otherwise(F.col("ocr")).alias("flag"), F.when(F.col("ocr") != "unknown", "ocr").when(calc != "unknown", "calculated").otherwise("unknown").alias("flag_source"),
    )


def standard_names(distinct: DataFrame, names: DataFrame) -> DataFrame:
    """``_n, standard`` of distinct lower-case names: equal alias, else the first alias in order that contains it or is in it."""
    a = names.select(F.lower("alias").alias("alias"), "standard", "ord")
    exact = distinct.join(a, F.col("_n") == F.col("alias")).groupBy("_n").agg(F.min_by("standard", "ord").alias("exact"))
    rest = distinct.join(exact, "_n", "left_anti")
    # the names are a dimension of distinct spellings; Spark broadcasts it only below its threshold
    near = rest.join(a, F.contains(F.col("_n"), F.col("alias")) | F.contains(F.col("alias"), F.col("_n"))).groupBy("_n").agg(F.min_by("standard", "ord").alias("near"))
    return distinct.join(exact, "_n", "left").join(near, "_n", "left").select("_n", F.coalesce("exact", "near").alias("standard"))


def names_of(lab_units: DataFrame) -> DataFrame:
    """The alias table of a table of quantities: standard names first, then their aliases."""
    w = Window.orderBy("test_name_standardized", "p")  # a dimension table
    every = lab_units.select("test_name_standardized", F.posexplode(F.concat(F.array("test_name_standardized"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("p", "alias"))
    return every.where("alias is not null").select("alias", F.col("test_name_standardized").alias("standard"), F.row_number().over(w).alias("ord"))


ABNORMAL, SEVERE = ["low", "high", "critical_low", "critical_high"], ["critical_low", "critical_high"]


def report_counts(results: DataFrame, key: str) -> DataFrame:
    """``key, total_tests, abnormal_count, critical_count`` of each report."""
    f = F.col("flag")
    return results.groupBy(key).agg(F.count("*").alias("total_tests"), F.count_if(f.isin(ABNORMAL)).alias("abnormal_count"), F.count_if(f.isin(SEVERE)).alias("critical_count"))


def explanation(test: Column, value: Column, unit: Column, flag: Column, low: Column, high: Column) -> Column:
    """One plain sentence on a result."""
    shown = F.concat_ws(" ", test, F.lit("is"), value.cast("string"), F.nullif(unit, F.lit("")))
    return F.concat(
        shown, F.when(flag == "critical_low", ", dangerously low.").when(flag == "critical_high", ", dangerously high.").when(flag == "low", ", below the usual range").when(flag == "high", ", above the usual range")
        .when(flag == "normal", ", within the usual range").otherwise("."), F.when(flag.isin("low", "high", "normal") & low.isNotNull() & high.isNotNull(), F.concat(F.lit(" ("), low.cast("string"), F.lit(" to "), high.cast("string"), F.lit(").")))
        .when(flag.isin("low", "high", "normal"), ".").otherwise(""),
    )
