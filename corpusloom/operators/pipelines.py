"""Whole documents: a legal and a medical pipeline, a domain guard, reports, and a hook for models."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from . import lab, legal, rollups


def with_model(text: Column, model: Callable[[pd.Series], pd.Series], kind: T.DataType | None = None) -> Column:
    """A column rewritten, scored or embedded by a model: any function of batches, shipped as an Arrow function.

    Simplifiers, translators, zero-shot classifiers, recognisers and embedders plug in here; the operators' own
    defaults are deterministic and need none.
    """

    def run(batch: pd.Series) -> pd.Series:
        return model(batch)

    return F.pandas_udf(run, kind or T.StringType())(text)


def right_domain(docs: DataFrame, text: str, expected: str) -> DataFrame:
    """``docs`` with ``domain, accepted``: whether the detected domain is the expected one (case apart)."""
    d = legal.domain(F.col(text))["domain"]
    return docs.withColumn("domain", d).withColumn("accepted", F.lower(F.lit(expected)) == F.col("domain"))


def legal_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, clauses, critical, high, medium, low, mean_score, overall, key_terms``: segmentation, risk and roll-up in one plan."""
    clean = docs.select(key, tx.cleaned(F.col(text), tx.MINIMAL).alias("_t"))
    c = legal.segment(clean, key, "_t").withColumn("r", legal.legal_risk(F.col("content"))).withColumn("terms", legal.key_terms(F.col("content")))
    g = c.groupBy(key).agg(
        F.count("*").alias("clauses"), *[F.count_if(F.col("r.level") == v).alias(v) for v in ("critical", "high", "medium", "low")], F.round(F.avg("r.score"), 6).alias("mean_score"),
        F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("clause_no", "terms"))), lambda x: x["terms"]))), 1, 5).alias("key_terms"),
    )
    return g.withColumn("overall", legal.document_risk({k: F.col(k) for k in ("critical", "high", "medium")}))


def medical_documents(docs: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """``key, total_tests, abnormal_count, critical_count, summary``: lines read, flagged and counted."""
    n = lab.report_counts(lab.parse_lines(docs, key, text, names), key)
    return n.withColumn("summary", F.format_string("%d tests, %d abnormal, %d critical", "total_tests", "abnormal_count", "critical_count"))


def simplification_report(results: DataFrame, key: str, risk: str, score: str) -> DataFrame:
    """``key, report``: one line per document: clauses, mean risk, and the histogram by number, then level."""
    low = F.lower(F.col(risk))
    per = results.groupBy(key, low.alias("level")).agg(F.count("*").alias("n"), F.sum(score).alias("s"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "level", "n"))), lambda x: F.concat(x["level"], F.lit(": "), x["n"].cast("string")))
    g = per.where("level is not null").groupBy(key).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), parts.alias("p"))
    return g.select(key, F.format_string("%d clauses, mean risk %.6f (%s)", F.col("n"), F.coalesce(F.col("s"), F.lit(0.0)) / F.col("n"), F.array_join("p", ", ")).alias("report"))


def histogram(rows: DataFrame, level: str) -> DataFrame:
    """``level, n`` by number, then level."""
    return rows.groupBy(level).agg(F.count("*").alias("n")).orderBy(F.desc("n"), level)


first_by, top_by = rollups.first_by, rollups.top_by
