"""Vectors: centroids, cosine similarity and best-prototype joins, with built-in array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """``label, centroid``: the mean vector of each label; null vectors and labels are left out.

    Sums are taken by position, so partitions pre-aggregate and a label of any size is no single group.
    """
    flat = rows.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(label, F.posexplode(vector).alias("p", "x"))
    mean = flat.groupBy(label, "p").agg(F.avg("x").alias("m"))
    return mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("centroid"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + F.coalesce(z, F.lit(0.0)))
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


#: Prototypes held in one row; more are refused.
MAX_PROTOTYPES = 10_000


def best_prototype(rows: DataFrame, key: str, vector: str, prototypes: DataFrame, label: str, prototype: str, least: float = 0.0) -> DataFrame:
    """``key, label, similarity``: the most similar prototype of each row (ties: the least label); null label below ``least``.

    The prototypes, checked to be at most ``MAX_PROTOTYPES``, are one broadcast array scanned inside a projection: no
    pair of rows is ever materialised.
    """
    n = prototypes.limit(MAX_PROTOTYPES + 1).count()
    if n > MAX_PROTOTYPES:
        raise ValueError(f"more than {MAX_PROTOTYPES} prototypes")
    one = prototypes.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), F.col(prototype).alias("v")))).alias("_all"))
    j = rows.where(F.col(vector).isNotNull()).join(F.broadcast(one))
    scored = F.transform("_all", lambda p: F.struct(cosine(F.col(vector), p["v"]).alias("s"), p["l"].alias("l")))
    best = F.aggregate(scored, F.struct(F.lit(-2.0).alias("s"), F.lit(None).cast(prototypes.schema[label].dataType).alias("l")), lambda a, x: F.when(x["s"] > a["s"], x).otherwise(a))
    b = j.select(key, best.alias("_b"))
    return b.select(key, F.when(F.col("_b.s") >= least, F.col("_b.l")).alias(label), F.col("_b.s").alias("similarity"))


def islands(rows: DataFrame, group: str, order: str, vector: str, least: float) -> DataFrame:
    """``rows`` with ``island``: neighbours in ``order`` within ``group`` merged while their cosine exceeds ``least``."""
    w = Window.partitionBy(group).orderBy(order)
    prev = F.lag(vector).over(w)
    starts = F.when(prev.isNull() | (cosine(prev, F.col(vector)) <= least), 1).otherwise(0)
    return rows.withColumn("_s", starts).withColumn("island", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")
