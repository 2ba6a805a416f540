"""Queries of the general training-data operators (units, nested records)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested, units
from ..session import table

JSON_COLUMNS = ["clauses", "law_references", "lab_results"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Results whose ``value`` is not the reported number in the common unit, in steps of the quantity's grid."""
    return units.restated(units.convert_units(table(spark, d, "test_results"), table(spark, d, "lab_units")))


def p2_units(spark: SparkSession, d: str) -> DataFrame:
    """How results of each quantity were given and taken: counts per unit, place it was printed, and certainty."""
    c = units.convert_units(table(spark, d, "test_results"), table(spark, d, "lab_units"))
    return c.groupBy("quantity", "unit_given", "given_in", "unit_assigned").agg(F.count("*").alias("n_results"), F.count_if("uncertain").alias("n_uncertain"), F.avg("common_value").alias("mean_common"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Each object in a list at any depth of the JSON columns, with its path and its parent's."""
    n = nested.flatten(table(spark, d, "processing_results"), JSON_COLUMNS, "result_id")
    return n.where("kind = 'object'").select("result_id", "node_path", "parent_path").distinct()


def p6_tables(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables found in the JSON columns: schema path, rows, field names."""
    return nested.table_inventory(nested.flatten(table(spark, d, "processing_results"), JSON_COLUMNS, "result_id"))


def p6_lab_history(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of earlier values of laboratory results, linked to their result."""
    n = nested.flatten(table(spark, d, "processing_results"), JSON_COLUMNS, "result_id")
    return nested.flat_table(n, "lab_results[].history[]", ["date", "value"], "result_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_units, p6_found, p6_tables, p6_lab_history)}
ORACLE: dict[str, str] = {}
