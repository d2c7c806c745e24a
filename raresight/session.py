"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "raresight", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="raresight-")
        sc.setCheckpointDir(root)
    return root


_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh table location under the shared folder, kept until ``release_scratch``."""
    path = f"{checkpoint_root(spark)}/raresight/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Delete the tables this driver has made so far; how many they were.

    For the end of a job: frames that read them can't be used any more.
    """
    gone = 0
    while _made:
        gone += drop_scratch(spark, _made[-1])
    return gone


def drop_scratch(spark: SparkSession, path: str) -> bool:
    """Delete one table of ``scratch_path`` that nothing reads any more."""
    if path in _made:
        _made.remove(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True))


def truncate_lineage(df):
    """Write the rows to the shared folder and go on from the written table.

    It survives the loss of an executor, keeps columns prunable and gives the
    optimiser the true size for the joins that follow.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
