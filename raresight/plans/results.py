"""Result analytics: newest records -> means -> selection -> result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def means(analysis: DataFrame, by: list[str], metrics: list[str] = ("fnr", "ppv")) -> DataFrame:
    return analysis.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def best_per_tag(analysis: DataFrame, fnr_cutoff: float = 0.0, top: int = 10) -> DataFrame:
    """Per tag, the combinations with the best mean ppv under the fnr limit."""
    w = W.partitionBy("tag").orderBy(F.col("ppv").desc(), "combination_id")
    m = means(analysis, ["tag", "combination_id"]).where(F.col("fnr") <= fnr_cutoff)
    return m.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select("tag", "combination_id", "place")


def rows_of(predictions: DataFrame, best: DataFrame) -> DataFrame:
    """All prediction rows of the selected combinations, stamped with the tag."""
    on = [c for c in ("tag", "combination_id") if c in predictions.columns]
    return predictions.join(best, on)


def top_zero_fnr(analysis: DataFrame, top: int = 10) -> DataFrame:
    m = means(analysis, ["tag", "combination_id"]).where("fnr = 0")
    return m.orderBy(F.col("ppv").desc(), "tag", "combination_id").limit(top)


def top_zero_fnr_folds(analysis: DataFrame, top: int = 10) -> DataFrame:
    """The variant that keeps zero-fnr folds first and averages what is left."""
    m = means(analysis.where("fnr = 0"), ["combination_id"], ["ppv"])
    return m.orderBy(F.col("ppv").desc(), "combination_id").limit(top)


def leaderboard(analysis: DataFrame, tag: str, top: int = 20, digits: int = 3) -> DataFrame:
    """(fnr ascending, ppv descending), rounded after the ordering."""
    m = means(analysis.where(F.col("tag") == tag), ["model", "scorer", "resampler", "combination_id"], ["fnr", "ppv", "f1"])
    head = m.orderBy("fnr", F.col("ppv").desc(), "combination_id").limit(top)
    return head.withColumns({c: F.round(c, digits) for c in ("fnr", "ppv", "f1")})
