"""CSV scans and sinks, the partitioned result store, fold materialisation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.text import prefix_match

RESULT_KEY = ["cross_validator", "resampler", "model", "scorer", "tag", "run_ts", "fold"]


def string_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


def scan_csv(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """CSV with header under an explicit schema; no inference pass."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", False)
        .csv(path)
    )


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def list_paths(spark: SparkSession, root: str) -> list[str]:
    """Names directly under a folder, on whatever file system it lives."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(p))


def scan_matching_files(spark: SparkSession, root: str, name_regex: str, renames: dict[str, str] | None = None) -> DataFrame:
    """Every file or folder whose path matches, united by column name.

    Sources with the same header share one multi-path scan; all cells are
    strings, typing belongs to the cleaning rules.
    """
    paths = [p for p in list_paths(spark, root) if re.match(name_regex, p)]
    if not paths:
        raise FileNotFoundError(f"nothing under {root} matches {name_regex}")
    by_header: dict[tuple, list[str]] = {}
    for p in paths:
        header = tuple(spark.read.option("header", True).csv(p).columns)
        by_header.setdefault(header, []).append(p)
    out = None
    for header, group in by_header.items():
        part = scan_csv(spark, group, string_schema(list(header)))
        for old, new in (renames or {}).items():
            part = part.withColumnRenamed(old, new)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def save_results(df: DataFrame, path: str) -> None:
    """Idempotent partitioned sink: a re-run replaces exactly its own cells.

    The rebalance hint gathers each cell's rows for few, large files while
    adaptive execution splits a cell that is far larger than the rest.
    """
    (
        df.hint("rebalance", *RESULT_KEY)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*RESULT_KEY)
        .parquet(path)
    )


def scan_results(spark: SparkSession, path: str, **patterns: str) -> DataFrame:
    """Stored result rows with their key columns; regexes on the key prune
    folders before any file is opened."""
    inferred = spark.read.parquet(path).schema
    # a tag such as 007 stays text: only the fold is a number
    fields = [T.StructField(f.name, T.StringType() if f.name in RESULT_KEY and f.name != "fold" else f.dataType) for f in inferred]
    df = spark.read.schema(T.StructType(fields)).parquet(path)
    for name, pattern in patterns.items():
        df = df.where(prefix_match(F.col(name), pattern))
    return df


def scan_latest_results(spark: SparkSession, path: str, **patterns: str) -> DataFrame:
    """Only the newest run folder per tag.

    The runs are found by an aggregate over partition columns, which reads no
    column of a file, and the choice is a filter over them alone: old runs are
    pruned while planning.
    """
    df = scan_results(spark, path, **patterns)
    key = ["cross_validator", "resampler", "model", "scorer", "tag"]
    # one row per cell of the grid; the run name is a zero-padded date and time: text order is time order
    newest = {tuple(r[c] for c in key): r["run"] for r in df.groupBy(*key).agg(F.max("run_ts").alias("run")).collect()}
    chosen = ["|".join([*k, run]) for k, run in newest.items()]
    return df.where(F.concat_ws("|", *key, "run_ts").isin(chosen))


def with_provenance(df: DataFrame) -> DataFrame:
    """Fold number out of the file path, -1 where the path has none."""
    found = F.regexp_extract(F.col("_metadata.file_path"), r"fold=(\d+)", 1)
    return df.withColumn("source_fold", F.when(found == "", F.lit(-1)).otherwise(found.try_cast("int")))


def materialize_folds(df: DataFrame, path: str, cv: str, n_folds: int) -> None:
    """Persist both sides of every fold: cv / fold / side folders.

    Each row is test in its own fold and train in the others; one pass.
    """
    tagged = (
        df.withColumnRenamed("fold", "__own")
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
        .withColumn("side", F.when(F.col("fold") == F.col("__own"), F.lit("test")).otherwise(F.lit("train")))
        .withColumn("cv", F.lit(cv))
        .drop("__own")
    )
    (
        tagged.hint("rebalance", "cv", "fold", "side")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("cv", "fold", "side")
        .parquet(path)
    )


def append_extra_train(train: DataFrame, extra: DataFrame, fold: int) -> DataFrame:
    return train.unionByName(extra.where(F.col("fold") == fold), allowMissingColumns=True)
