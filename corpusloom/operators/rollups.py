"""Roll-ups of processed documents: risk histograms, batch summaries, recommendations, first-wins and preferred rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ["critical", "high", "medium", "low", "none"]


def risk_histogram(clauses: DataFrame, key: str, level: str) -> DataFrame:
    """``key, total, critical, high, medium, low, none``: clauses of each document by risk; null levels count in ``total`` only."""
    low = F.lower(F.col(level))
    return clauses.groupBy(key).agg(F.count("*").alias("total"), *[F.count_if(low == v).alias(v) for v in LEVELS])


def batch_summary(results: DataFrame, method: str, success: Column, words: Column, seconds: Column) -> DataFrame:
    """``method, n, succeeded, failed, words, seconds, mean_seconds`` of a batch by extraction method."""
    return results.groupBy(method).agg(
        F.count("*").alias("n"), F.count_if(success).alias("succeeded"), F.count_if(~F.coalesce(success, F.lit(False))).alias("failed"),
        F.coalesce(F.sum(words), F.lit(0)).alias("words"), F.round(F.coalesce(F.sum(seconds), F.lit(0.0)), 6).alias("seconds"), F.round(F.avg(seconds), 6).alias("mean_seconds"),
    )


def variation(rows: DataFrame, group: str, value: str) -> DataFrame:
    """``group, mean, deviation, variation, median``: population deviation over mean; null where the mean is 0."""
    x = F.col(value)
    return rows.groupBy(group).agg(F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("deviation"), F.round(F.stddev_pop(x) / F.nullif(F.avg(x), F.lit(0.0)), 6).alias("variation"), F.round(F.median(x), 6).alias("median"))


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order (make it total; ties are arbitrary)."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_by(rows: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each key with their ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def recommendations(clauses: DataFrame, key: str, text: str, level: str) -> DataFrame:
    """``key, messages``: advice on a document from what stands in any of its clauses."""
    low, risk = F.lower(F.coalesce(F.col(text), F.lit(""))), F.lower(F.col(level))
    g = clauses.groupBy(key).agg(
        F.count_if(risk.isin("high", "critical")).alias("n"), F.coalesce(F.bool_or(F.contains(low, F.lit("forfeit")) & F.contains(low, F.lit("deposit"))), F.lit(False)).alias("forfeit"),
        F.coalesce(F.bool_or(F.contains(low, F.lit("without notice"))), F.lit(False)).alias("sudden"),
    )
    found = F.filter(F.array(
        F.when(F.col("n") > 0, F.format_string("%d high-risk clauses need review", F.col("n"))), F.when(F.col("forfeit"), F.lit("The deposit may be forfeited")), F.when(F.col("sudden"), F.lit("The agreement may end without notice")),
    ), lambda x: x.isNotNull())
    return g.select(key, F.when(F.size(found) > 0, F.array_join(found, "; ")).otherwise("No special concerns").alias("messages"))


def offsets(parts: DataFrame, key: str, order: str, length: Column) -> DataFrame:
    """``parts`` with ``offset``: the sum of the lengths before each part of its document."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)))


def quota(rows: DataFrame, key: str, order: str, wanted: Column, most: int) -> DataFrame:
    """``rows`` with ``taken``: whether a wanted row is among the first ``most`` wanted ones of its key."""
    n = F.count_if(wanted).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("taken", F.coalesce(wanted, F.lit(False)) & (n <= most))


def agreement(rows: DataFrame, expected: Column, actual: Column) -> DataFrame:
    """``n, correct, accuracy`` of predictions; rows with a null on either side count as wrong."""
    ok = F.coalesce(expected == actual, F.lit(False))
    return rows.agg(F.count("*").alias("n"), F.count_if(ok).alias("correct"), F.round(F.avg(ok.cast("int")), 6).alias("accuracy"))
