"""ROC curves, AUC and the smoothing of ranked result series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.numeric import safe_divide
from ..session import truncate_lineage
from .ordering import exact_quantiles, running_totals


def score_counts(df: DataFrame, by: list[str], score: str = "proba", actual: str = "actual") -> DataFrame:
    """Positives and negatives per distinct score, combined before the shuffle."""
    return df.groupBy(*by, score).agg(
        F.count_if(F.col(actual) == 1).alias("pos"), F.count_if(F.col(actual) == 0).alias("neg")
    )


def roc_points(df: DataFrame, by: list[str], score: str = "proba", actual: str = "actual", drop_collinear: bool = True, **options) -> DataFrame:
    """fpr, tpr per threshold, starting with (0, 0, inf).

    The distinct scores are counted once and kept as a table; cumulative counts
    then run inside score ranges with exact offsets, so a curve with as many
    points as rows never lands in one task. With ``drop_collinear`` a point is
    dropped when the step after it adds the same counts as the step to it.
    """
    counts = truncate_lineage(score_counts(df, by, score, actual))
    cum = running_totals(counts, score, ["pos", "neg"], by, descending=True, following=drop_collinear, **options)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    if drop_collinear:
        first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
        same = (F.col("next_pos") == F.col("pos")) & (F.col("next_neg") == F.col("neg")) & ~first
        cum = cum.where(F.coalesce(~same, F.lit(True)))
    body = cum.join(totals, by).select(
        *by,
        safe_divide(F.col("cum_neg"), F.col("all_neg")).alias("fpr"),
        safe_divide(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
        F.col(score).alias("threshold"),
    )
    start = totals.select(*by, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(math.inf).alias("threshold"))
    return body.unionByName(start)


def roc_at_threshold(points: DataFrame, by: list[str], at: float = 0.5) -> DataFrame:
    """fpr of the point whose threshold is nearest; the higher one on ties."""
    near = points.where(F.col("threshold") < math.inf)
    return near.groupBy(*by).agg(
        F.min_by(F.struct("fpr", "tpr", "threshold"), F.struct(F.abs(F.col("threshold") - at), -F.col("threshold"))).alias("s")
    ).select(*by, "s.*")


def auc(df: DataFrame, by: list[str], score: str = "proba", actual: str = "actual", **options) -> DataFrame:
    """Area under the curve as a rank sum: ties count half."""
    counts = truncate_lineage(score_counts(df, by, score, actual))
    cum = running_totals(counts, score, ["neg"], by, descending=False, **options)
    below = F.col("cum_neg") - F.col("neg")
    g = cum.groupBy(*by).agg(
        F.sum(F.col("pos") * (below + F.col("neg") * 0.5)).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n")
    )
    return g.select(*by, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("wins") / (F.col("p") * F.col("n")).cast("double")).alias("auc"))


# ---- series over ranked combinations ------------------------------------
# These run on one row per combination of the experiment grid (hundreds), an
# aggregate of the runs, so an ordered window over the whole series is bounded
# by the grid and not by the data.


def rank_series(means: DataFrame, value: str = "fnr", key: str = "combination_id") -> DataFrame:
    return means.withColumn("rank", (F.row_number().over(W.orderBy(value, key)) - 1).cast("int"))


def last_zero_rank(ranked: DataFrame, value: str = "fnr") -> DataFrame:
    return ranked.agg(F.max(F.when(F.col(value) == 0, F.col("rank"))).cast("double").alias("last_zero"))


def centered(width: int):
    """Frame of a centred window of even or odd width."""
    before = width // 2
    return W.orderBy("rank").rowsBetween(-before, width - before - 1)


def rolling(ranked: DataFrame, value: str, width: int, name: str, quantile: float | None = None) -> DataFrame:
    """Centred rolling mean (or quantile), null unless the window is full."""
    w = centered(width)
    full = F.count(value).over(w) == width
    stat = F.avg(value).over(w) if quantile is None else F.percentile(value, quantile).over(w)
    return ranked.withColumn(name, F.when(full, stat))


def smooth_band(ranked: DataFrame, value: str = "ppv", width: int = 20) -> DataFrame:
    """Rolling 0.10 / 0.90 quantiles, each smoothed by half the window."""
    out = ranked
    for name, q in (("lower", 0.10), ("upper", 0.90)):
        out = rolling(out, value, width, f"__{name}", q)
        out = rolling(out, f"__{name}", width // 2, name).drop(f"__{name}")
    return out


def lowess(ranked: DataFrame, value: str, frac: float = 0.1, iterations: int = 3) -> DataFrame:
    """Local linear regression at every rank with tricube and bisquare weights.

    x is the rank itself, so the k nearest points are a row frame: no
    neighbour search is needed and each pass is one join of n x k rows.
    """
    n = ranked.count()
    k = int(frac * n + 1e-10)
    base = ranked.select("rank", F.col(value).cast("double").alias("y"))
    if k < 2:
        return base.withColumn("smooth", F.col("y"))
    base = truncate_lineage(base)
    left = F.least(F.greatest(F.col("rank") - F.lit((k - 1) - (k - 1) // 2), F.lit(0)), F.lit(n - k))
    spans = base.select(F.col("rank").alias("at"), left.alias("left"))
    near = spans.select("at", "left", F.explode(F.sequence(F.col("left"), F.col("left") + k - 1)).alias("rank"))
    h = F.greatest(F.col("at") - F.col("left"), F.col("left") + (k - 1) - F.col("at")).cast("double")
    dist = F.abs(F.col("rank") - F.col("at")) / h
    near = near.withColumn("tri", F.when(dist < 1, F.pow(1 - F.pow(dist, 3), 3)).otherwise(F.lit(0.0)))
    fitted = base.withColumn("robust", F.lit(1.0))
    for i in range(iterations + 1):
        pts = near.join(fitted.select("rank", "y", "robust"), "rank").withColumn("w", F.col("tri") * F.col("robust"))
        x, y, w = F.col("rank") - F.col("at"), F.col("y"), F.col("w")
        sums = pts.groupBy("at").agg(
            F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy")
        )
        det = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
        fit = F.when(F.abs(det) > 1e-12, (F.col("sxx") * F.col("sy") - F.col("sx") * F.col("sxy")) / det).when(
            F.col("sw") > 0, F.col("sy") / F.col("sw")
        )
        smooth = base.join(sums.select(F.col("at").alias("rank"), fit.alias("smooth")), "rank")
        smooth = smooth.withColumn("smooth", F.coalesce("smooth", "y"))
        if i == iterations:
            return smooth
        # a few hundred rows; without this each pass would repeat all earlier ones
        resid = truncate_lineage(smooth.withColumn("res", F.abs(F.col("y") - F.col("smooth"))))
        scale = resid.agg(F.percentile("res", 0.5)).scalar() * F.lit(6.0)
        u = F.col("res") / scale
        fitted = resid.withColumn(
            "robust", F.when(scale > 0, F.when(u < 1, F.pow(1 - u * u, 2)).otherwise(F.lit(0.0))).otherwise(F.lit(1.0))
        ).select("rank", "y", "robust")


def percentile_cut(df: DataFrame, by: list[str], score: str, p: float, floor: float = 0.5, **options) -> DataFrame:
    """Rows strictly above max(percentile p of their group, floor)."""
    df = truncate_lineage(df)  # counted, cut and filtered: read three times
    if not by:  # one scalar
        top = exact_quantiles(df, [score], [p], **options).first()
        value = top["value"] if top is not None else None
        limit = floor if value is None else max(value, floor)
        return df.where(F.col(score) > limit).withColumn("cut", F.lit(limit))
    cut = exact_quantiles(df, [score], [p], by=by, **options).select(*by, F.greatest(F.col("value"), F.lit(floor)).alias("__cut"))
    return df.join(cut, by).where(F.col(score) > F.col("__cut")).withColumnRenamed("__cut", "cut")


def normalise_by_max(df: DataFrame, by: str = "combination_id", score: str = "proba", name: str = "proba_norm") -> DataFrame:
    """Score over the group's largest score; an aggregate joined back, because
    a window would put a whole combination into one task."""
    top = df.groupBy(by).agg(F.max(score).alias("__top"))
    return df.join(top, by).withColumn(name, F.when(F.col("__top") != 0, F.col(score) / F.col("__top"))).drop("__top")
