"""Run records, feature sets and result rows kept as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path, truncate_lineage


def latest_records(df: DataFrame, key: list[str], created: str, tie: str) -> DataFrame:
    """Newest row per key by (created, tie).

    An aggregate rather than a window: combines before the shuffle, so a key
    with very many versions is no hot partition.
    """
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(created, tie)).alias("__r"))
    return best.select(*key, "__r.*").select(*df.columns)


def metadata_filter(
    cross_validator: str | None = None,
    model: str | None = None,
    resampler: str | None = None,
    score: str | None = None,
    tag: str | None = None,
    combination_id: int | None = None,
    anchored: bool = False,
) -> Column:
    """Regex conjunction over the record key; unset parts match everything.

    ``anchored`` matches from the start of the text (directory scan), the
    default searches anywhere (table query).
    """
    cond = F.lit(True)
    parts = {
        "cross_validator": cross_validator,
        "model": model,
        "resampler": resampler,
        "scorer": score,
        "tag": tag,
    }
    for name, pattern in parts.items():
        if pattern:
            cond = cond & F.col(name).rlike(f"^(?:{pattern})" if anchored else pattern)
    if combination_id:
        cond = cond & (F.col("combination_id") == combination_id)
    return cond


def append_records(df: DataFrame, path: str) -> None:
    """Versions are only ever appended; the newest one is found on read."""
    df.write.mode("append").parquet(path)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    key = ["combination_id", "tag", "fold", "metadata"]
    return latest_records(spark.read.parquet(path), key, "created_at", "record_id")


def star_tables(records: DataFrame) -> dict[str, DataFrame]:
    """Split flat records into the five catalogue tables.

    ``combination_id`` is part of the record already; the dimension is the
    distinct key. The records are written once and all five read that table.
    """
    records = truncate_lineage(records)
    counts = ["true_positives", "false_positives", "false_negatives", "true_negatives"]
    return {
        "combination": records.select(
            F.col("combination_id").alias("id"), "model", "resampler", "cross_validator", "scorer"
        ).distinct(),
        "record": records.select(
            F.col("record_id").alias("id"), "combination_id", "tag", "fold", "metadata", "created_at", "version"
        ),
        "analysis": records.select("record_id", *counts),
        "record_data": records.select("record_id", F.format_string("results_%d", "record_id").alias("result_file")),
        "model_data": records.select("record_id", F.format_string("model_%d", "record_id").alias("model_file")),
    }


def star_join(tables: dict[str, DataFrame], condition: Column | None = None) -> DataFrame:
    """record x combination x analysis x model_data x record_data, newest only.

    The filter and the newest-version aggregate run before the wide joins;
    strategy is left to the optimiser, which broadcasts the sides it has
    measured as small.
    """
    rec = latest_records(
        tables["record"].withColumnRenamed("id", "record_id"),
        ["combination_id", "tag", "fold", "metadata"],
        "created_at",
        "record_id",
    )
    combo = tables["combination"].withColumnRenamed("id", "combination_id")
    out = rec.join(combo, "combination_id")
    if condition is not None:
        out = out.where(condition)
    return (
        out.join(tables["analysis"], "record_id").join(tables["model_data"], "record_id").join(tables["record_data"], "record_id")
    )


COMBINATION = ("model", "resampler", "scorer", "cross_validator")
STAR = ("combination", "record", "record_data", "model_data", "analysis")


def _hash_id(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def combination_id(model: str, resampler: str, scorer: str, cross_validator: str) -> int:
    """The id that ``write_run`` gives a combination: a hash of its natural key, the same on every cluster and in every run."""
    from pyspark.sql import SparkSession

    one = SparkSession.active().range(1).select(_hash_id(*[F.lit(x) for x in (model, resampler, scorer, cross_validator)]))
    return one.first()[0]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def write_run(cells: DataFrame, root: str, run: str, created_at: Column, metadata: str = "{}") -> bool:
    """Record one grid run, (combination key, tag, fold, counts, result_file, model_file) a cell; False if it is there already.

    Ids are hashes of the natural keys: a combination is inserted if it is absent,
    and a job that died is repeated over its own folders. A run counts for readers
    once its commit marker stands, which is written last.
    """
    spark = cells.sparkSession
    if _exists(spark, f"{root}/commits/run={run}/_SUCCESS"):
        return False
    keyed = cells.withColumn("combination_id", _hash_id(*COMBINATION)).withColumn("metadata", F.lit(metadata))
    keyed = keyed.withColumns({"record_id": _hash_id(F.lit(run), F.col("combination_id"), F.col("tag"), F.col("fold"), F.col("metadata")), "created_at": created_at})
    keyed = truncate_lineage(keyed)
    counts = ["true_positives", "false_positives", "false_negatives", "true_negatives"]
    combos = keyed.select(F.col("combination_id").alias("id"), *COMBINATION).distinct()
    if _exists(spark, f"{root}/combination"):
        combos = combos.join(read_catalog(spark, root)["combination"], list(COMBINATION), "left_anti").select("id", *COMBINATION)
    tables = {
        "combination": combos,
        "record": keyed.select(F.col("record_id").alias("id"), "combination_id", "tag", "fold", "metadata", "created_at"),
        "record_data": keyed.select("record_id", "result_file"),
        "model_data": keyed.select("record_id", "model_file"),
        "analysis": keyed.select("record_id", *counts),
    }
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{root}/{name}/run={run}")
    keyed.agg(F.count(F.lit(1)).alias("records")).write.mode("overwrite").parquet(f"{root}/commits/run={run}")
    return True


def read_catalog(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The five tables of the committed runs; the newest record of a key is found by ``star_join``."""
    done = spark.read.parquet(f"{root}/commits").select("run").distinct() if _exists(spark, f"{root}/commits") else None
    out = {}
    for name in STAR:
        table = spark.read.parquet(f"{root}/{name}")
        table = table.limit(0) if done is None else table.join(F.broadcast(done), "run", "left_semi")
        out[name] = table.drop("run")
    # two runs side by side may both have found a combination absent
    out["combination"] = out["combination"].distinct()
    return out


def upsert_feature_sets(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """Last write per combination wins."""
    both = existing.unionByName(updates)
    return both.groupBy("combination_id").agg(
        F.max_by("feature_set", "created_at").alias("feature_set"), F.max("created_at").alias("created_at")
    )


def load_feature_set(feature_sets: DataFrame, combination_id: int) -> list[str]:
    """Feature names of one combination, empty when none is stored."""
    row = feature_sets.where(F.col("combination_id") == combination_id).select("feature_set").head(1)
    return list(_feature_names(row[0][0])) if row else []


def _feature_names(text) -> list[str]:
    import json

    return json.loads(text) if isinstance(text, str) else list(text)


def select_features(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """Project to a stored feature set; an unknown feature is an error."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"features not in the table: {missing}")
    return df.select(*keep, *features) if features else df


def write_report(df: DataFrame, root: str, run_ts: str) -> str:
    path = f"{root}/analysis/run_ts={run_ts}"
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def round_trip(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back with the same schema."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
