"""Session and storage helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(shared: str, app: str = "corpusloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks, with ``shared`` as the shared folder; clusters bring their own."""
    s = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", shared)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Where the setting is absent on a single machine (``local`` master, as in tests) a folder below the system's
    temporary directory is used; a cluster without the setting is refused.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return "file://" + os.path.join(tempfile.gettempdir(), f"corpusloom-{os.getuid()}")
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (an action).

    Cuts the lineage with a table that outlives any executor, unlike a local
    checkpoint or a cached block.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


def release(spark: SparkSession) -> None:
    """Deletes the tables this process wrote to the shared folder; call it when their results have been used."""
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
