"""Shapley values over whole coalitions, or by paired permutations, and importances over folds."""

from __future__ import annotations

from math import factorial

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import uniform
from ..session import truncate_lineage
from .models import feature_importances, ml_frame, scored
from .ordering import bounded_broadcast, with_rank

#: Up to so many features every coalition is scored, 2^d of them.
MOST_EXACT = 12
#: Background rows that are averaged over at most.
MOST_BACKGROUND = 1_000


def background_sample(rows: DataFrame, n: int = 100, seed: int = 0) -> DataFrame:
    """The ``n`` rows of smallest seeded hash: what a feature that is left out is averaged over."""
    return rows.orderBy(uniform("background", seed, F.col("case_index")), "case_index").limit(n)


def _weights(d: int) -> list[list[float]]:
    """For each feature what the value of each coalition (by mask) counts."""
    share = [factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)]
    return [[share[m.bit_count() - 1] if m >> j & 1 else -share[m.bit_count()] for m in range(1 << d)] for j in range(d)]


def shapley_values(model, rows: DataFrame, background: DataFrame, names: list[str], model_id: int = 1) -> DataFrame:
    """(case_index, model_id, feature, value, phi, base), exact.

    A coalition's value is the mean score over the background rows with the
    coalition's features taken from the case. Cases that agree on them share it,
    so each (mask, values) is scored once; the full coalition needs no background
    and the empty one no case. Per case ``phi`` adds up to its score minus ``base``,
    the background's mean score. The background, ``MOST_BACKGROUND`` rows at most,
    goes along as a literal.
    """
    d = len(names)
    if d > MOST_EXACT:
        raise ValueError(f"{d} features have 2^{d} coalitions; sampled_shapley takes more than {MOST_EXACT}")
    drawn = background.select("case_index", "features").limit(MOST_BACKGROUND + 1).collect()
    if not drawn or len(drawn) > MOST_BACKGROUND:
        raise ValueError(f"{len(drawn)} background rows; 1 to {MOST_BACKGROUND} are averaged over")
    base = scored(model, ml_frame(background.select("case_index", "features")), ["case_index"]).agg(F.avg("proba")).first()[0]
    full = (1 << d) - 1
    has = lambda j: F.col("mask").bitwiseAND(F.lit(1 << j)) != 0
    cases = truncate_lineage(rows.select("case_index", "features"))
    known = F.array(*[F.when(has(j), F.element_at("features", j + 1)) for j in range(d)])
    asked = cases.withColumn("mask", F.explode(F.sequence(F.lit(1), F.lit(full)))).select("case_index", "mask", known.alias("known"))
    asked = truncate_lineage(asked)
    others = F.array(*[F.array(*[F.lit(float(x)) for x in r["features"]]) for r in drawn])
    cell = asked.select("mask", "known").distinct()
    cell = cell.withColumn("bg", F.explode(F.when(F.col("mask") == full, F.slice(others, 1, 1)).otherwise(others)))
    mixed = F.array(*[F.coalesce(F.element_at("known", j + 1), F.element_at("bg", j + 1)) for j in range(d)])
    values = scored(model, cell.withColumn("features", array_to_vector(mixed)), ["mask", "known"]).groupBy("mask", "known").agg(F.avg("proba").alias("v"))
    joined = asked.alias("a").join(values.alias("v"), (F.col("a.mask") == F.col("v.mask")) & F.col("a.known").eqNullSafe(F.col("v.known")))
    lists = joined.groupBy("case_index").agg(F.array_sort(F.collect_list(F.struct("a.mask", "v.v"))).alias("v"))
    every = F.concat(F.array(F.lit(base)), F.transform("v", lambda x: x["v"]))

    def dot(weights: list[float]) -> Column:
        return F.aggregate(F.zip_with(every, F.array(*[F.lit(w) for w in weights]), lambda x, w: x * w), F.lit(0.0), lambda t, x: t + x)

    phi = F.array(*[F.struct(F.lit(n).alias("feature"), F.element_at("features", j + 1).alias("value"), dot(w).alias("phi")) for j, (n, w) in enumerate(zip(names, _weights(d)))])
    out = cases.join(lists, "case_index").select("case_index", F.explode(phi).alias("s"))
    return out.select("case_index", F.lit(model_id).alias("model_id"), "s.feature", "s.value", "s.phi", F.lit(base).alias("base"))


def sampled_shapley(model, rows: DataFrame, background: DataFrame, names: list[str], permutations: int = 4, seed: int = 0, model_id: int = 1) -> DataFrame:
    """(case_index, model_id, feature, value, phi) from drawn orders, for many features.

    For each (row, permutation) a background row is drawn and features switch
    from background to row one by one in the permuted order; permutations come in
    pairs, an order and its reverse with the same background row. All d + 1 masked
    vectors of all rows are scored in one pass; each score counts for the
    feature just switched on and against the next one, so no ordering or self
    join follows. Per case the values add up to the mean of
    f(row) - f(background row) exactly.
    """
    d = len(names)
    n_bg = background.count()
    if not n_bg:
        raise ValueError("no background rows")
    bg = with_rank(background.select("case_index", F.col("features").alias("bg")), "case_index", name="__pick").select("__pick", "bg")
    pair = F.floor(F.col("perm") / 2)
    turn = F.when(F.col("perm") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    order = F.transform(
        F.array_sort(F.array(*[F.struct((turn * uniform("perm", seed, F.col("case_index"), pair, j)).alias("u"), F.lit(j).alias("j")) for j in range(d)])),
        lambda s: s["j"],
    )
    drawn = (
        rows.select("case_index", "features")
        .withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
        .withColumn("__pick", F.floor(uniform("bg", seed, F.col("case_index"), pair) * n_bg).cast("bigint"))
        .withColumns({"order": order, "own": F.col("features")})
        .join(bounded_broadcast(bg, n_bg), "__pick")
    )
    step = drawn.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    masked = F.transform(
        F.sequence(F.lit(0), F.lit(d - 1)),
        lambda j: F.when(
            F.array_position(F.col("order"), j) <= F.col("step"), F.element_at("features", j + 1)
        ).otherwise(F.element_at("bg", j + 1)),
    )
    ready = step.withColumn("features", array_to_vector(masked))
    out = scored(model, ready, ["case_index", "order", "step", "own"])
    gain = F.struct(F.element_at("order", F.greatest(F.col("step"), F.lit(1))).alias("j"), F.when(F.col("step") > 0, F.col("proba")).otherwise(F.lit(0.0)).alias("v"))
    loss = F.struct(
        F.element_at("order", F.least(F.col("step") + 1, F.lit(d))).alias("j"), F.when(F.col("step") < d, -F.col("proba")).otherwise(F.lit(0.0)).alias("v")
    )
    phi = (
        out.select("case_index", "own", F.explode(F.array(gain, loss)).alias("g"))
        .groupBy("case_index", "g.j")
        .agg((F.sum("g.v") / F.lit(float(permutations))).alias("phi"), F.first(F.element_at("own", F.col("g.j") + 1)).alias("value"))
    )
    feature = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("j") + 1)
    return phi.select(
        "case_index", F.lit(model_id).alias("model_id"), feature.alias("feature"), "value", "phi"
    )


def importance_rows(spark, fitted: dict[tuple[int, int], object], names: list[str]) -> DataFrame:
    """Long importances of fitted models keyed by (combination, fold); models
    without importances are skipped."""
    rows = []
    for (combination, fold), model in fitted.items():
        imp = feature_importances(model, names)
        if imp is not None:
            rows += [(combination, fold, n, v) for n, v in imp.items()]
    return spark.createDataFrame(rows, "combination_id int, fold int, feature string, importance double")


def case_explanations(phi: DataFrame, screening: DataFrame, cases: DataFrame) -> DataFrame:
    """Attributions of chosen cases with episode, fold and label."""
    chosen = phi.join(cases.select("case_index"), "case_index", "left_semi")
    return chosen.join(screening.select("case_index", "episode", "fold", "label"), "case_index")
