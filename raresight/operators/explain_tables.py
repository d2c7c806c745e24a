"""Tables over attributions: means, groups, ranks, tails."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ordering import exact_quantiles


def mean_importance(importances: DataFrame, folds: int) -> DataFrame:
    """Average per (combination, feature); every feature must appear in
    exactly ``folds`` folds, otherwise the job fails."""
    g = importances.groupBy("combination_id", "feature").agg(
        F.avg("importance").alias("importance"), F.count_distinct("fold").alias("__f")
    )
    guard = F.when(F.col("__f") == folds, F.col("importance")).otherwise(
        F.raise_error(F.concat(F.lit("wrong number of folds: "), F.col("__f").cast("string"))).cast("double")
    )
    return g.select("combination_id", "feature", guard.alias("importance"))


def importance_matrix(means: DataFrame, combinations: list[int]) -> DataFrame:
    """One column per combination."""
    return means.groupBy("feature").pivot("combination_id", combinations).agg(F.first("importance"))


def group_features(phi: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Merge features: attributions add up, the shown value is the position of
    the set indicator."""
    name, position = F.col("feature"), F.lit(None).cast("int")
    for new, members in groups.items():
        for i, m in enumerate(members):
            name = F.when(F.col("feature") == m, F.lit(new)).otherwise(name)
            position = F.when(F.col("feature") == m, F.lit(i)).otherwise(position)
    value = F.when(position.isNull(), F.col("value")).otherwise(F.col("value") * position)
    return phi.groupBy("case_index", "model_id", name.alias("feature")).agg(F.sum(value).alias("value"), F.sum("phi").alias("phi"))


def sum_features(phi: DataFrame, features: list[str], new: str) -> DataFrame:
    name = F.when(F.col("feature").isin(features), F.lit(new)).otherwise(F.col("feature"))
    return phi.groupBy("case_index", "model_id", name.alias("feature")).agg(F.sum("value").alias("value"), F.sum("phi").alias("phi"))


def drop_feature(phi: DataFrame, feature: str) -> DataFrame:
    return phi.where(F.col("feature") != feature)


def rank_features(phi: DataFrame, top: int = 20) -> DataFrame:
    """Mean |phi|, largest first."""
    m = phi.groupBy("model_id", "feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))
    return m.orderBy(F.col("mean_abs").desc(), "model_id", "feature").limit(top)


def impact_tail_sum(phi: DataFrame, p: float = 0.9, **options) -> DataFrame:
    """Per feature, the sum over models of |phi| strictly above its p quantile."""
    a = phi.select("model_id", "feature", F.abs("phi").alias("a"))
    cut = exact_quantiles(a, ["a"], [p], by=["model_id", "feature"], **options).select("model_id", "feature", F.col("value").alias("cut"))
    tail = F.sum(F.when(F.col("a") > F.col("cut"), F.col("a")).otherwise(F.lit(0.0)))
    return a.join(cut, ["model_id", "feature"]).groupBy("feature").agg(tail.alias("impact"))
