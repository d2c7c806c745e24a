"""Resampling of training rows.

Frames hold ``case_index``, ``label`` (0/1) and ``features`` (array<double>).
``ratio`` is the wanted minority / majority share afterwards. All draws are
counter-based, so a retried task repeats its numbers. New rows carry the
negative key -(i + 1) and in ``source`` the row they come from.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import normal, uniform
from ..session import truncate_lineage
from .neighbors import knn_join
from .ordering import keep_smallest, running_totals, with_rank

# the block functions travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COLUMNS = ["case_index", "label", "features", "source"]


@dataclass(frozen=True)
class Classes:
    minority: int
    n_min: int
    n_maj: int


def classes(df: DataFrame) -> Classes:
    """Two counts on the driver; the smaller label wins a tie."""
    rows = sorted((r["n"], r["label"]) for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect())
    if len(rows) != 2:
        raise ValueError("resampling needs exactly two classes")
    return Classes(rows[0][1], rows[0][0], rows[1][0])


def _originals(df: DataFrame) -> DataFrame:
    return df.select("case_index", "label", "features", F.col("case_index").alias("source"))


def none(df: DataFrame, **_) -> DataFrame:
    return _originals(df)


def _ranked(minority: DataFrame) -> DataFrame:
    return with_rank(minority.select("case_index", "features"), "case_index", name="rank")


def _draws(df: DataFrame, need: int) -> DataFrame:
    return df.sparkSession.range(need).withColumnRenamed("id", "i")


def _pick(tag: str, seed: int, n: int) -> Column:
    return F.floor(uniform(tag, seed, F.col("i")) * n).cast("bigint")


def random_over(df: DataFrame, ratio: float, seed: int = 0, **_) -> DataFrame:
    c = classes(df)
    need = max(0, int(ratio * c.n_maj) - c.n_min)
    if not need:
        return _originals(df)
    ranked = _ranked(df.where(F.col("label") == c.minority))
    new = (
        _draws(df, need)
        .withColumn("rank", _pick("over", seed, c.n_min))
        .join(ranked, "rank")
        .select((-F.col("i") - 1).alias("case_index"), F.lit(c.minority).alias("label"), "features", F.col("case_index").alias("source"))
    )
    return _originals(df).unionByName(new)


def random_under(df: DataFrame, ratio: float = 1.0, seed: int = 0, keep: int | None = None, **options) -> DataFrame:
    """Minority plus exactly floor(minority / ratio) majority rows, or
    ``keep`` of them; chosen by smallest hash, found without a sort."""
    c = classes(df)
    k = min(c.n_maj, int(c.n_min / ratio) if keep is None else keep)
    majority = df.where(F.col("label") != c.minority).withColumn("__u", uniform("under", seed, F.col("case_index")))
    kept = majority if k >= c.n_maj else keep_smallest(majority, "__u", k, "case_index", **options)
    return _originals(df.where(F.col("label") == c.minority)).unionByName(_originals(kept.drop("__u")))


def undersample_n(df: DataFrame, n: int = 100, seed: int = 0, **options) -> DataFrame:
    return random_under(df, seed=seed, keep=n, **options)


def _interpolate(seeds: DataFrame, neighbors: DataFrame, pool: DataFrame, seed: int, label: int) -> DataFrame:
    """seeds(i, a, j): a point on the segment from a to its j-th neighbour."""
    a = pool.select(F.col("case_index").alias("a"), F.col("features").alias("fa"))
    b = pool.select(F.col("case_index").alias("b"), F.col("features").alias("fb"))
    nb = neighbors.select(F.col("query").alias("a"), F.col("neighbor").alias("b"), F.col("rank").cast("bigint").alias("j"))
    gap = uniform("gap", seed, F.col("i"))
    made = seeds.join(nb, ["a", "j"]).join(a, "a").join(b, "b").withColumn("__gap", gap)
    new = F.zip_with("fa", "fb", lambda x, y: x + F.col("__gap") * (y - x))
    return made.select((-F.col("i") - 1).alias("case_index"), F.lit(label).alias("label"), new.alias("features"), F.col("a").alias("source"))


def smote(df: DataFrame, ratio: float, seed: int = 0, k: int = 5, **knn) -> DataFrame:
    c = classes(df)
    need = max(0, int(ratio * c.n_maj) - c.n_min)
    k = min(k, c.n_min - 1)
    if not need or k < 1:
        return _originals(df)
    minority = df.where(F.col("label") == c.minority)
    neighbors = truncate_lineage(knn_join(minority, minority, k, **knn))
    seeds = (
        _draws(df, need)
        .withColumn("rank", _pick("seed", seed, c.n_min))
        .withColumn("j", _pick("nb", seed, k) + 1)
        .join(_ranked(minority).select("rank", F.col("case_index").alias("a")), "rank")
        .select("i", "a", "j")
    )
    return _originals(df).unionByName(_interpolate(seeds, neighbors, minority, seed, c.minority))


def majority_share(df: DataFrame, minority_label: int, k: int, **knn) -> DataFrame:
    """Per minority row, how many of its k nearest rows are of the other class."""
    minority = df.where(F.col("label") == minority_label)
    near = knn_join(minority, df, k, **knn)
    labels = df.select(F.col("case_index").alias("neighbor"), "label")
    return truncate_lineage(
        near.join(labels, "neighbor")
        .groupBy(F.col("query").alias("case_index"))
        .agg(F.count_if(F.col("label") != minority_label).alias("n_other"), F.count(F.lit(1)).alias("n_near"))
    )


def adasyn(df: DataFrame, ratio: float, seed: int = 0, k: int = 5, **knn) -> DataFrame:
    """New rows per minority row in proportion to the majority around it."""
    c = classes(df)
    need = max(0, int(ratio * c.n_maj) - c.n_min)
    kk = min(k, c.n_min - 1)
    if not need or kk < 1:
        return _originals(df)
    share = majority_share(df, c.minority, k, **knn)
    total = share.agg(F.sum("n_other")).first()[0]
    if not total:
        raise ValueError("no minority row has a majority neighbour")
    weight = (F.col("n_other") / F.lit(float(k))) / F.lit(total / float(k))
    per_row = share.withColumn("g", F.rint(weight * F.lit(float(need))).cast("int")).where("g > 0")
    minority = df.where(F.col("label") == c.minority)
    neighbors = truncate_lineage(knn_join(minority, minority, kk, **knn))
    a, d = F.col("case_index").alias("a"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("d")
    # the draws before a row number its own, so new keys are unique and dense
    numbered = running_totals(per_row.select("case_index", "g"), "case_index", ["g"], descending=False).select((F.col("cum_g") - F.col("g")).alias("r"), a, d)
    seeds = numbered.select((F.col("r") + F.col("d")).alias("i"), "a").withColumn("j", _pick("nb", seed, kk) + 1)
    return _originals(df).unionByName(_interpolate(seeds, neighbors, minority, seed, c.minority))


def borderline_smote(df: DataFrame, ratio: float, seed: int = 0, k: int = 5, m: int = 10, **knn) -> DataFrame:
    """SMOTE seeded only by rows whose m neighbours are at least half, but not
    all, of the majority."""
    c = classes(df)
    need = max(0, int(ratio * c.n_maj) - c.n_min)
    k = min(k, c.n_min - 1)
    if not need or k < 1:
        return _originals(df)
    share = majority_share(df, c.minority, m, **knn)
    danger = share.where((F.col("n_other") * 2 >= m) & (F.col("n_other") < m)).select("case_index")
    n_danger = danger.count()
    if not n_danger:
        return _originals(df)
    minority = df.where(F.col("label") == c.minority)
    at_risk = minority.join(danger, "case_index", "left_semi")
    neighbors = truncate_lineage(knn_join(at_risk, minority, k, **knn))
    seeds = (
        _draws(df, need)
        .withColumn("rank", _pick("seed", seed, n_danger))
        .withColumn("j", _pick("nb", seed, k) + 1)
        .join(_ranked(at_risk).select("rank", F.col("case_index").alias("a")), "rank")
        .select("i", "a", "j")
    )
    return _originals(df).unionByName(_interpolate(seeds, neighbors, minority, seed, c.minority))


def near_miss(df: DataFrame, ratio: float, k: int = 3, seed: int = 0, **knn) -> DataFrame:
    """Majority rows with the smallest mean distance to their k nearest
    minority rows."""
    c = classes(df)
    keep = min(c.n_maj, int(c.n_min / ratio))
    minority, majority = df.where(F.col("label") == c.minority), df.where(F.col("label") != c.minority)
    mean = knn_join(majority, minority, k, **knn).groupBy(F.col("query").alias("case_index")).agg(F.avg("dist").alias("mean_dist"))
    chosen = keep_smallest(truncate_lineage(mean), "mean_dist", keep, "case_index")
    return _originals(minority).unionByName(_originals(majority.join(chosen, "case_index", "left_semi")))


def tomek_majority(df: DataFrame, **knn) -> DataFrame:
    """Majority members of mutual nearest pairs of opposite classes.

    Such a pair has a minority member, so only minority rows and the majority
    rows nearest to them are searched: two passes, never all pairs.
    """
    c = classes(df)
    minority = df.where(F.col("label") == c.minority)
    labels = df.select(F.col("case_index").alias("neighbor"), "label")
    forward = truncate_lineage(
        knn_join(minority, df, 1, **knn).join(labels, "neighbor").where(F.col("label") != c.minority).select("query", "neighbor")
    )
    hits = df.join(forward.select(F.col("neighbor").alias("case_index")).distinct(), "case_index", "left_semi")
    back = knn_join(hits, df, 1, **knn).select(F.col("query").alias("neighbor"), F.col("neighbor").alias("query"))
    return forward.join(back, ["query", "neighbor"]).select(F.col("neighbor").alias("case_index")).distinct()


def tomek(df: DataFrame, ratio: float | None = None, seed: int = 0, **knn) -> DataFrame:
    return _originals(df.join(tomek_majority(df, **knn), "case_index", "left_anti"))


def gaussian(
    df: DataFrame,
    feature_ratio: float = 0.25,
    noise_level: float = 0.01,
    new_points_ratio: float = 2.0,
    replacement: bool = True,
    seed: int = 0,
    ratio: float | None = None,
    **_,
) -> DataFrame:
    """Noisy copies of minority rows: a random share of the features of each
    copy gets N(0, population std * noise_level) added."""
    if not 0 < feature_ratio <= 1 or noise_level < 0 or new_points_ratio < 0:
        raise ValueError("feature_ratio in (0, 1], noise_level and new_points_ratio not negative")
    c = classes(df)
    need = math.ceil(c.n_min * new_points_ratio)
    if not need:
        return _originals(df)
    minority = df.where(F.col("label") == c.minority)
    d = minority.agg(F.max(F.size("features"))).first()[0]
    stats = minority.agg(*[F.stddev_pop(F.col("features")[j]).alias(f"s{j}") for j in range(d)]).first()
    share = int(feature_ratio * d)
    draws = (
        _draws(df, need)
        .withColumn("rank", _pick("src", seed, c.n_min))
        .join(_ranked(minority), "rank")
        .withColumn("__order", F.array_sort(F.array(*[F.struct(uniform("col", seed, F.col("i"), j).alias("u"), F.lit(j).alias("j")) for j in range(d)])))
        .withColumn("__chosen", F.transform(F.slice("__order", 1, share), lambda s: s["j"]) if share else F.array().cast("array<int>"))
    )
    cells = [
        F.col("features")[j]
        + F.when(
            F.array_contains("__chosen", j), normal(seed, F.col("i"), j) * F.lit(float(stats[j] or 0.0) * noise_level)
        ).otherwise(F.lit(0.0))
        for j in range(d)
    ]
    new = draws.select(
        (-F.col("i") - 1).alias("case_index"), F.lit(c.minority).alias("label"), F.array(*cells).alias("features"), F.col("case_index").alias("source")
    )
    kept = df if replacement else df.where(F.col("label") != c.minority)
    return _originals(kept).unionByName(new)


def centroids(df: DataFrame, k: int, seed: int = 0, max_iter: int = 20, bisecting: bool = False) -> DataFrame:
    """k-means centres of all rows, one algorithm for every k.

    ``bisecting`` asks for bisecting k-means, whose cost grows with log k instead
    of k and whose centres differ. Spark ML holds the k centres of either on the
    driver while it fits.
    """
    vec = df.select(array_to_vector("features").alias("v"))
    algo = BisectingKMeans if bisecting else KMeans
    model = algo(k=k, seed=seed, maxIter=max_iter, featuresCol="v").fit(vec)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(model.clusterCenters())]
    return df.sparkSession.createDataFrame(rows, "i bigint, features array<double>")


def _shares(k: int, cells: list[tuple[int, int, int]]) -> dict[int, int]:
    """(cell, rows, distinct vectors) -> centres per cell: by rows, at least one, no more than distinct vectors, ``k`` in all."""
    share = {c: 1 for c, _, _ in cells}
    room = {c: d - 1 for c, _, d in cells}
    left = min(k, sum(d for _, _, d in cells)) - len(cells)
    while left > 0:
        open_ = [(c, n) for c, n, _ in cells if room[c]]
        total = sum(n for _, n in open_)
        wish = {c: min(room[c], left * n // total) for c, n in open_}
        if not any(wish.values()):
            wish = {c: 1 for c, _ in sorted(open_, key=lambda x: (-x[1], x[0]))[:left]}
        for c, n in wish.items():
            share[c], room[c], left = share[c] + n, room[c] - n, left - n
    return share


#: Distances worked out at once.
DISTANCES = 1 << 22


def _rows_of(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["features"].to_numpy()).astype(np.float64)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Place of the nearest centre of each row, the first of equally near ones."""
    size = (centres * centres).sum(1)[None, :]
    parts = math.ceil(len(x) * len(centres) / DISTANCES)
    return np.concatenate([(size - 2 * part @ centres.T).argmin(1) for part in np.array_split(x, max(1, parts))])


def _added(rows: pd.DataFrame, centres: np.ndarray) -> pd.DataFrame:
    """(i, s, n): the weighted sum and count of the rows nearest to each centre that has any."""
    x, w = _rows_of(rows), rows["w"].to_numpy()
    near = _nearest(x, centres)
    total = np.zeros_like(centres)
    np.add.at(total, near, x * w[:, None])
    n = np.bincount(near, weights=w, minlength=len(centres))
    met = np.flatnonzero(n)
    return pd.DataFrame({"i": met, "s": list(total[met]), "n": n[met].astype("int64")})


def _mean(d: int) -> list[Column]:
    return [F.array(*[F.sum(F.col("s")[j]) / F.sum("n") for j in range(d)]).alias("mean")]


def centroids_by_cell(df: DataFrame, k: int, seed: int = 0, cells: int = 1024, rounds: int = 10, block_rows: int = 20_000) -> DataFrame:
    """(i, features, n): ``k`` centres for any ``k``, and how many rows each stands for.

    Two levels of ``rounds`` Lloyd steps, each from the rows of smallest hash: the
    first cuts the rows into ``cells`` coarse cells (no more than the root of
    ``k``), in the second each cell has its share of the centres by its rows.
    Copies of a vector are one weighted row. The centres are a table and a row is
    compared with those of its cell alone, so the driver holds the coarse cells
    only and the work grows with k / cells; the centres differ from those of one
    k-means over all rows. With fewer distinct vectors than ``k`` each is a
    centre. Null vectors are left out.
    """
    spark = df.sparkSession
    points = truncate_lineage(df.where("features is not null").groupBy("features").agg(F.count(F.lit(1)).alias("w")))
    n, d = points.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    if not n:
        return spark.createDataFrame([], "i bigint, features array<double>, n bigint")
    draw = F.xxhash64("features", F.lit(seed))
    picked = points.orderBy(draw, "features").limit(max(1, min(cells, math.isqrt(k)))).collect()
    rough = np.array([r["features"] for r in picked], np.float64)

    def each(work, schema: str) -> DataFrame:
        shared = spark.sparkContext.broadcast(rough)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield work(pdf, shared.value)

        return points.mapInPandas(run, schema)

    for _ in range(rounds):
        added = each(_added, "i bigint, s array<double>, n bigint")
        for r in added.groupBy("i").agg(*_mean(d)).collect():
            rough[r["i"]] = r["mean"]
    placed = truncate_lineage(each(lambda pdf, c: pdf.assign(cell=_nearest(_rows_of(pdf), c).astype("int32")), "features array<double>, w bigint, cell int"))
    sizes = sorted(tuple(r) for r in placed.groupBy("cell").agg(F.sum("w"), F.count(F.lit(1))).collect())
    share = _shares(max(k, len(sizes)), sizes)
    # at most ``cells`` entries
    starts = dict(zip(share, np.cumsum([0, *share.values()]).tolist()))
    plan = spark.createDataFrame([(c, share[c], starts[c], max(1, math.ceil(d / block_rows))) for c, _, d in sizes], "cell int, share int, start int, blocks int")
    placed = placed.join(F.broadcast(plan), "cell")
    first = placed.withColumn("r", F.row_number().over(W.partitionBy("cell").orderBy(draw, "features"))).where("r <= share")
    centres = truncate_lineage(first.select((F.col("start") + F.col("r") - 1).cast("bigint").alias("i"), "features", "cell", "blocks", F.lit(0).cast("bigint").alias("n")))
    rows = truncate_lineage(placed.withColumn("block", F.pmod(F.xxhash64("features"), F.col("blocks")).cast("int")).select("cell", "block", "features", "w"))

    def in_cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):  # no row was dealt to this block
            return pd.DataFrame({"i": np.zeros(0, np.int64), "s": pd.Series([], dtype=object), "n": np.zeros(0, np.int64)})
        b = b.sort_values("i")
        out = _added(a, _rows_of(b))
        return out.assign(i=b["i"].to_numpy()[out["i"].to_numpy()])

    for _ in range(rounds):
        dealt = centres.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        part = rows.groupBy("cell", "block").cogroup(dealt.groupBy("cell", "block")).applyInPandas(in_cell, "i bigint, s array<double>, n bigint")
        mean = part.groupBy("i").agg(*_mean(d), F.sum("n").alias("met"))
        # a centre that no row is nearest to stays where it is
        moved = centres.join(mean, "i", "left").select("i", F.coalesce("mean", "features").alias("features"), "cell", "blocks", F.coalesce("met", F.lit(0)).cast("bigint").alias("n"))
        centres = truncate_lineage(moved)
    return centres.select("i", "features", "n")


def cluster_centroids(
    df: DataFrame, ratio: float, k: int | str = "target", seed: int = 0, bisecting: bool = False, by_cell: bool = False, **_
) -> DataFrame:
    """Majority replaced by centroids, minority kept. ``k="target"`` takes
    the wanted majority count, a number takes that many; ``by_cell`` finds them
    in two levels, for counts that one k-means can't hold."""
    c = classes(df)
    count = min(c.n_maj, max(1, int(c.n_min / ratio))) if k == "target" else int(k)
    majority = df.where(F.col("label") != c.minority)
    found = centroids_by_cell(majority, count, seed) if by_cell else centroids(majority, count, seed, bisecting=bisecting)
    made = found.select(
        (-F.col("i") - 1).alias("case_index"), F.lit(1 - c.minority).alias("label"), "features", F.lit(None).cast("bigint").alias("source")
    )
    return _originals(df.where(F.col("label") == c.minority)).unionByName(made)


def prototypes(df: DataFrame, predicted: str, ratio: float = 0.001, k: int | None = None, seed: int = 0, fold: str = "fold") -> DataFrame:
    """Centroids of the rows a first layer calls negative, one set per fold.

    A driver loop over the folds; each fit is a distributed k-means.
    """
    rejected = truncate_lineage(df.where(F.col(predicted) == 0).select("case_index", "features", fold))
    sizes = {r[fold]: r["n"] for r in rejected.groupBy(fold).agg(F.count(F.lit(1)).alias("n")).collect()}
    out = None
    for f, n in sorted(sizes.items()):
        made = centroids(rejected.where(F.col(fold) == f), min(k or max(1, int(1 / ratio)), n), seed).select(
            (-F.col("i") - 1).alias("case_index"), F.lit(0).alias("label"), "features", F.lit(f).alias(fold)
        )
        out = made if out is None else out.unionByName(made)
    return out


# Name -> function, with the noise variant under its stored name.
RESAMPLERS = {
    "none": none,
    "SMOTE": smote,
    "ADASYN": adasyn,
    "BorderlineSMOTE": borderline_smote,
    "RandomOverSampler": random_over,
    "RandomUnderSampler": random_under,
    "NearMiss": near_miss,
    "TomekLinks": tomek,
    "Gaussian_FR025_NL001_NPR2": gaussian,
    "ClusterCentroids": cluster_centroids,
}
DEFAULT_RATIO = 0.02


def resample(df: DataFrame, name: str, ratio: float = DEFAULT_RATIO, seed: int = 0) -> DataFrame:
    return RESAMPLERS[name](df, ratio=ratio, seed=seed)
