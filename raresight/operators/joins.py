"""Joins named after their use; keys are explicit, positions never are."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def left_outcomes(screening: DataFrame, outcomes: DataFrame, key: str = "episode") -> DataFrame:
    """Screening rows with their outcomes; a repeated outcome repeats the row.

    No broadcast hint: the outcome table grows with the data. Adaptive
    execution picks the strategy and splits skewed keys.
    """
    return screening.join(outcomes, key, "left")


def checked_inner(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that must keep every left row; ``unmatched`` tells otherwise.

    One left join both joins and checks: the flag is raised inside the job,
    without a second scan or an anti join.
    """
    marked = right.withColumn("__hit", F.lit(True))
    out = left.join(marked, key, "left")
    guard = F.when(F.col("__hit"), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("no match for key "), F.col(key).cast("string"))).cast("boolean")
    )
    return out.withColumn("__hit", guard).where("__hit").drop("__hit")


def with_suffixes(df: DataFrame, suffix: str, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(c + suffix) for c in df.columns])


def left_features(predictions: DataFrame, features: DataFrame, key: str = "case_index") -> DataFrame:
    """Left join; clashing columns get _x / _y."""
    clash = (set(predictions.columns) & set(features.columns)) - {key}
    left = predictions.select(*[F.col(c).alias(c + "_x") if c in clash else F.col(c) for c in predictions.columns])
    right = features.select(*[F.col(c).alias(c + "_y") if c in clash else F.col(c) for c in features.columns])
    return left.join(right, key, "left")


def with_metadata(predictions: DataFrame, records: DataFrame) -> DataFrame:
    """Result rows with their run record; records count runs, so they are the
    small side and adaptive execution broadcasts them once measured."""
    return predictions.join(records, ["combination_id", "fold"])


def aligned_sum(predictions: DataFrame, members: list[int], value: str = "proba", key: str = "case_index") -> DataFrame:
    """Sum of several models' scores per case, added in member order."""
    rows = predictions.where(F.col("combination_id").isin(members))
    cells = rows.groupBy(key).agg(
        *[F.max(F.when(F.col("combination_id") == m, F.col(value))).alias(f"m{m}") for m in members]
    )
    total = F.lit(0.0)
    for m in members:
        total = total + F.coalesce(F.col(f"m{m}"), F.lit(0.0))
    return cells.select(key, total.alias("votes"))


def grid(spark_df: DataFrame, **axes: list[str]) -> DataFrame:
    """Experiment plan: every combination of the axis values per input row.

    Axes are lists of names, so the plan is exploded from literals and no
    join takes place.
    """
    out = spark_df
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out
