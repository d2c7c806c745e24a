"""Learners as Spark ML estimators, with one scoring contract.

Frames hold ``case_index``, ``label`` (0/1) and ``features`` (vector). A fitted
model's ``transform`` adds ``prediction``; ``scored`` turns that into
``predicted`` and ``proba`` (0 where a learner has no probabilities).

Trees and forests are regression trees on the 0/1 label: the split criterion,
variance, is half the Gini impurity, and a leaf keeps its share of positives.
A native classification tree merges sibling leaves of the same class, which on
a rare label leaves one node. ``entropy`` has no such twin: those trees are
classifiers and score by class.

Against the usual single-machine learners: tree depth stops at 30, trees have
no minimum split size, boosting has no L1/L2 terms or step bound, the linear
SVC uses the hinge loss with a sigmoid fitted on its margin, and the
perceptron is trained by L-BFGS.
"""

from __future__ import annotations

import math
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasSeed
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import uniform
from ..session import truncate_lineage
from .clean import threshold_screen

ML_COLUMNS = ("rawPrediction", "probability", "prediction")


def ml_frame(df: DataFrame) -> DataFrame:
    """array<double> features to the vector type, at the ML boundary only."""
    return df.withColumn("features", array_to_vector("features"))


def scored(model: Model, df: DataFrame, keep: list[str] = ("case_index", "label")) -> DataFrame:
    """keep..., predicted, proba."""
    out = model.transform(df)
    if "proba" in out.columns:
        proba = F.col("proba")
    elif "probability" in out.columns:
        proba = vector_to_array("probability")[1]
    else:
        proba = F.lit(0.0)
    return out.select(*keep, F.col("prediction").cast("int").alias("predicted"), proba.cast("double").alias("proba"))


def proba_fallback(proba: Column | None, predicted: Column) -> Column:
    """[1 - p, p] from the class where no probability exists."""
    p = predicted.cast("double")
    return p if proba is None else F.coalesce(proba, p)


def balanced_weights(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """n / (2 n_class): two counts, then a projection with literals."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    weight = F.lit(1.0)
    for cls, c in counts.items():
        weight = F.when(F.col(label) == cls, F.lit(n / (2.0 * c))).otherwise(weight)
    return df.withColumn(name, weight)


class ThresholdScreen(Model):
    """The incumbent rule: one analyte at or above a cutoff; no probability."""

    def __init__(self, index: int = 0, cutoff: float = 14.0):
        super().__init__()
        self.index, self.cutoff = index, cutoff

    def _transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array("features")[self.index]
        return df.withColumn("prediction", threshold_screen(x, self.cutoff).cast("double"))


#: A line of a tree's description: depth by its indent, then a test or a leaf.
_LINE = re.compile(r"^( *)(?:If \(feature (\d+) <= (\S+)\)|(Else) .*|Predict: (\S+))$")


@dataclass
class PackedTrees:
    """The nodes of many trees in flat arrays, scored side by side.

    A node goes ``left`` where its feature is at most its threshold; leaves have
    feature -1. ``roots`` has the first node of each tree, ``importances`` the mean
    of the trees' feature importances. However many trees there are, a plan holds
    one vectorised step, and its memory is bounded by ``CELLS``.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    importances: np.ndarray

    @classmethod
    def of(cls, models: list) -> PackedTrees:
        """Pack fitted trees, or forests of one tree, with continuous features."""
        feature, threshold, left, right, value, roots = [], [], [], [], [], []
        for model in models:
            roots.append(len(feature))
            open_: list[tuple[int, int]] = []  # (depth, node) whose right side is still to come
            above: list[tuple[int, int]] = []
            for line in model.toDebugString.splitlines():
                found = _LINE.match(line)
                if not found or "Tree" in line:
                    continue
                depth, node = len(found[1]), len(feature)
                if found[4]:
                    while above and above[-1][0] > depth:
                        above.pop()
                    open_.append(above.pop())
                    continue
                feature.append(int(found[2]) if found[2] else -1)
                threshold.append(float(found[3]) if found[3] else 0.0)
                value.append(float(found[5]) if found[5] else 0.0)
                left.append(node)
                right.append(node)
                if open_ and open_[-1][0] < depth:
                    right[open_.pop()[1]] = node
                elif above:
                    left[above[-1][1]] = node
                if found[2]:
                    above.append((depth, node))
        importances = np.mean([m.featureImportances.toArray() for m in models], axis=0)
        return cls(np.array(feature, np.int32), np.array(threshold), np.array(left, np.int32), np.array(right, np.int32), np.array(value), np.array(roots, np.int32), importances)

    #: Rows times trees that are held at once.
    CELLS = 1 << 20

    def values(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the value of each row's leaf."""
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        while True:
            f = self.feature[node]
            if (f < 0).all():
                return self.value[node]
            goes_left = x[row, np.maximum(f, 0)] <= self.threshold[node]
            node = np.where(f < 0, node, np.where(goes_left, self.left[node], self.right[node]))

    def combined(self, df: DataFrame, combine, name: str) -> DataFrame:
        """``df`` with ``combine`` of its rows' leaf values, one number a row."""
        step = max(1, self.CELLS // max(1, len(self.roots)))
        shared = df.sparkSession.sparkContext.broadcast(self)

        def score(features: pd.Series) -> pd.Series:
            x = np.stack(features.to_numpy()) if len(features) else np.zeros((0, 1))
            parts = [combine(shared.value.values(x[lo : lo + step])) for lo in range(0, len(x), step)]
            return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

        return df.withColumn(name, F.pandas_udf(score, "double")(vector_to_array("features")))


class _ClassRows(Params):
    """Shared parts of the composed learners."""

    rounds = Param(Params._dummy(), "rounds", "number of member models", TypeConverters.toInt)
    learningRate = Param(Params._dummy(), "learningRate", "shrinks each member's vote", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a member tree", TypeConverters.toInt)
    impurity = Param(Params._dummy(), "impurity", "split criterion", TypeConverters.toString)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "smallest leaf", TypeConverters.toInt)
    bootstrap = Param(Params._dummy(), "bootstrap", "draw rows with replacement", TypeConverters.toBoolean)
    balanced = Param(Params._dummy(), "balanced", "class weights inside a member", TypeConverters.toBoolean)
    variant = Param(Params._dummy(), "variant", "SAMME or SAMME.R", TypeConverters.toString)
    parallelism = Param(Params._dummy(), "parallelism", "members fitted at a time", TypeConverters.toInt)

    def _members(self, df: DataFrame, fits: list) -> list:
        with ThreadPoolExecutor(max_workers=max(1, self.getOrDefault(self.parallelism))) as pool:
            return list(pool.map(inheritable_thread_target(df.sparkSession)(lambda f: f()), fits))


def _class_counts(df: DataFrame) -> tuple[int, int]:
    r = df.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    return r["p"], r["n"]


def balanced_draw(df: DataFrame, counts: tuple[int, int], *salt) -> DataFrame:
    """All rows of the smaller class and a hash sample of the other of the
    same expected size; a plain filter, so a draw costs no shuffle."""
    pos, neg = counts
    if not pos or not neg:
        return df
    minority, share = (1, pos / neg) if pos <= neg else (0, neg / pos)
    return df.where((F.col("label") == minority) | (uniform("bag", *salt, F.col("case_index")) < share))


def bootstrap_weight(*salt) -> Column:
    """Poisson(1) copies of a row: the distributed form of a bootstrap."""
    u = uniform("boot", *salt, F.col("case_index"))
    total, term, out = 0.0, math.exp(-1.0), None
    for k in range(8):
        total += term / math.factorial(k)
        cond = u < total
        out = F.when(cond, F.lit(float(k))) if out is None else out.when(cond, F.lit(float(k)))
    return out.otherwise(F.lit(8.0))


class AveragedModel(Model):
    """Mean score of the member trees; positive above one half."""

    def __init__(self, trees: PackedTrees):
        super().__init__()
        self.trees = trees

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.trees.combined(df, lambda values: np.clip(values, 0.0, 1.0).mean(axis=1), "proba")
        return out.withColumn("prediction", (F.col("proba") > 0.5).cast("double"))


def tree_learner(impurity: str = "gini", **params):
    """A forest whose trees keep the share of positives of their leaves, see the module's text."""
    if impurity == "gini":
        return RandomForestRegressor(**params)
    return RandomForestClassifier(impurity=impurity, **params)


class BalancedBagging(Estimator, HasSeed, _ClassRows):
    """Trees on balanced draws; ``maxDepth`` 30 unless given."""

    strategy = "all"

    @keyword_only
    def __init__(self, *, rounds=10, maxDepth=10, impurity="gini", minInstancesPerNode=1, bootstrap=True, balanced=False, parallelism=4, seed=0):
        super().__init__()
        self._setDefault(rounds=10, maxDepth=10, impurity="gini", minInstancesPerNode=1, bootstrap=True, balanced=False, parallelism=4)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> AveragedModel:
        counts, seed = _class_counts(df), self.getSeed()

        def member(i: int):
            def fit():
                bag = balanced_draw(df, counts, seed, i)
                bag = bag.withColumn("weight", bootstrap_weight(seed, i) if self.getOrDefault(self.bootstrap) else F.lit(1.0))
                bag = bag.where("weight > 0")
                if self.getOrDefault(self.balanced):
                    bag = balanced_weights(bag, name="__cw").withColumn("weight", F.col("weight") * F.col("__cw"))
                tree = tree_learner(
                    self.getOrDefault(self.impurity),
                    numTrees=1,
                    bootstrap=False,
                    featureSubsetStrategy=self.strategy,
                    maxDepth=self.getOrDefault(self.maxDepth),
                    minInstancesPerNode=self.getOrDefault(self.minInstancesPerNode),
                    weightCol="weight",
                    seed=seed + i,
                )
                return tree.fit(bag)

            return fit

        return AveragedModel(PackedTrees.of(self._members(df, [member(i) for i in range(self.getOrDefault(self.rounds))])))


class BalancedRandomForest(BalancedBagging):
    """As above with a random subset of the features at each split."""

    strategy = "sqrt"


class BoostedModel(Model):
    """Weighted vote (SAMME) or summed log odds (SAMME.R) of the member trees."""

    def __init__(self, trees: PackedTrees, alphas: list[float], variant: str):
        super().__init__()
        self.trees, self.alphas, self.variant = trees, list(alphas), variant

    def _transform(self, df: DataFrame) -> DataFrame:
        share, variant = np.array(self.alphas) / (sum(self.alphas) or 1.0), self.variant

        def margin(values: np.ndarray) -> np.ndarray:
            if variant == "SAMME":
                return np.where(values > 0.5, 1.0, -1.0) @ share
            p = np.clip(values, 1e-10, 1.0 - 1e-10)
            return (np.log(p) - np.log1p(-p)) @ share

        out = self.trees.combined(df, margin, "__d")
        proba = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("__d")))
        return out.withColumns({"proba": proba, "prediction": (F.col("__d") > 0).cast("double")}).drop("__d")


def member_vote(variant: str) -> Column:
    """A regression tree's vote: its class as a sign, or the log odds of its leaf."""
    if variant == "SAMME":
        return F.when(F.col("prediction") > 0.5, F.lit(1.0)).otherwise(F.lit(-1.0))
    p = F.greatest(F.least(F.col("prediction"), F.lit(1.0 - 1e-10)), F.lit(1e-10))
    return F.log(p) - F.log(F.lit(1.0) - p)


class AdaBoost(Estimator, HasSeed, _ClassRows):
    """Boosted trees of depth one. Rounds depend on each other, so the driver
    loops; row weights are a column and their lineage is cut every few rounds."""

    CUT_EVERY = 5
    under_sample = False

    @keyword_only
    def __init__(self, *, rounds=50, learningRate=1.0, maxDepth=1, variant="SAMME.R", seed=0):
        super().__init__()
        self._setDefault(rounds=50, learningRate=1.0, maxDepth=1, variant="SAMME.R")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> BoostedModel:
        rate, seed, variant = self.getOrDefault(self.learningRate), self.getSeed(), self.getOrDefault(self.variant)
        base = ["case_index", "label", "features"]
        counts = _class_counts(df)
        work = truncate_lineage(df.select(*base).withColumn("weight", F.lit(1.0 / max(1, sum(counts)))))
        members, alphas = [], []
        for i in range(self.getOrDefault(self.rounds)):
            rows = balanced_draw(work, counts, seed, i) if self.under_sample else work
            tree = DecisionTreeRegressor(maxDepth=self.getOrDefault(self.maxDepth), weightCol="weight", seed=seed + i).fit(rows)
            out = tree.transform(work).withColumns(
                {"__wrong": ((F.col("prediction") > 0.5).cast("int") != F.col("label")).cast("int"), "__vote": member_vote(variant)}
            )
            w = F.col("weight")
            factor_r = F.exp(F.lit(-0.5 * rate) * F.when(F.col("label") == 1, F.col("__vote")).otherwise(-F.col("__vote")))
            stats = out.agg(
                F.sum(w).alias("w"), F.sum(w * F.col("__wrong")).alias("e"), F.sum(w * factor_r).alias("r"), F.sum("__wrong").alias("n")
            ).first()
            error = stats["e"] / stats["w"]
            if not stats["n"]:
                members, alphas = members + [tree], alphas + [1.0]
                break
            if variant == "SAMME" and error >= 0.5:
                break
            alpha = rate * math.log((1.0 - error) / max(error, 1e-12)) if variant == "SAMME" else 1.0
            members, alphas = members + [tree], alphas + [alpha]
            if variant == "SAMME":
                grown = stats["w"] + stats["e"] * (math.exp(alpha) - 1.0)
                new = w * F.when(F.col("__wrong") == 1, F.lit(math.exp(alpha))).otherwise(F.lit(1.0)) / F.lit(grown)
            else:
                new = w * factor_r / F.lit(stats["r"])
            work = out.select(*base, new.alias("weight"))
            if (i + 1) % self.CUT_EVERY == 0:
                work = truncate_lineage(work)
        if not members:  # the first stump is no better than chance
            members, alphas = [tree], [1.0]
        return BoostedModel(PackedTrees.of(members), alphas, variant)


class RUSBoost(AdaBoost):
    """Each round fits on a fresh balanced draw and reweights all rows."""

    under_sample = True


class ForestModel(Model):
    """A fitted forest: its mean leaf share as ``proba``."""

    def __init__(self, forest):
        super().__init__()
        self.forest = forest

    @property
    def featureImportances(self):
        return self.forest.featureImportances

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.forest.transform(df)
        # a weighted mean of zeros and ones may miss them in its last digit
        p = vector_to_array("probability")[1] if "probability" in out.columns else F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))
        return out.withColumn("proba", p).drop(*ML_COLUMNS).withColumn("prediction", (F.col("proba") > 0.5).cast("double"))


class Forest(Estimator, HasSeed, _ClassRows):
    """A forest, or with one tree a decision tree that tries a feature subset at each split."""

    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "features tried at a split", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, numTrees=20, maxDepth=5, impurity="gini", minInstancesPerNode=1, bootstrap=False, featureSubsetStrategy="auto", balanced=False, seed=0):
        super().__init__()
        self._setDefault(numTrees=20, maxDepth=5, impurity="gini", minInstancesPerNode=1, bootstrap=False, featureSubsetStrategy="auto", balanced=False)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ForestModel:
        strategy = self.getOrDefault(self.featureSubsetStrategy)
        trees = self.getOrDefault(self.numTrees)
        params = {p: self.getOrDefault(p) for p in ("numTrees", "maxDepth", "minInstancesPerNode", "bootstrap")}
        # the regressor's own default of a third is not the classifier's root
        strategy = ("all" if trees == 1 else "sqrt") if strategy == "auto" else strategy
        learner = tree_learner(self.getOrDefault(self.impurity), seed=self.getSeed(), featureSubsetStrategy=strategy, **params)
        if self.getOrDefault(self.balanced):
            df, learner = balanced_weights(df), learner.setWeightCol("weight")
        return ForestModel(learner.fit(df))


class ScaledSVC(Estimator, _ClassRows):
    """Standardised features, then a linear SVC; ``C`` as in the usual
    formulation, so the penalty is 1 / (C n)."""

    C = Param(Params._dummy(), "C", "inverse penalty", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, C=1.0, balanced=False, maxIter=50):
        super().__init__()
        self._setDefault(C=1.0, balanced=False)
        self.maxIter = maxIter
        kw = {k: v for k, v in self._input_kwargs.items() if k != "maxIter"}
        self._set(**kw)

    def _fit(self, df: DataFrame):
        n = max(1, df.count())
        weighted = self.getOrDefault(self.balanced)
        rows = balanced_weights(df) if weighted else df
        scaler = StandardScaler(inputCol="features", outputCol="__scaled", withMean=True, withStd=True)
        svc = LinearSVC(featuresCol="__scaled", regParam=1.0 / (self.getOrDefault(self.C) * n), maxIter=self.maxIter)
        if weighted:
            svc = svc.setWeightCol("weight")
        fitted = Pipeline(stages=[scaler, svc]).fit(rows)
        margins = fitted.transform(df).select(F.col("label").cast("double").alias("label"), array_to_vector(F.array(vector_to_array("rawPrediction")[1])).alias("features"))
        sigmoid = LogisticRegression(maxIter=50).fit(truncate_lineage(margins))
        return MarginModel(fitted, float(sigmoid.coefficients[0]), float(sigmoid.intercept))


class MarginModel(Model):
    """A linear classifier with a sigmoid on its margin; the class stays the margin's sign."""

    def __init__(self, fitted, slope: float, intercept: float):
        super().__init__()
        self.fitted, self.slope, self.intercept = fitted, slope, intercept

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.fitted.transform(df)
        margin = vector_to_array("rawPrediction")[1]
        proba = F.lit(1.0) / (F.lit(1.0) + F.exp(-(margin * F.lit(self.slope) + F.lit(self.intercept))))
        return out.withColumn("proba", proba).drop("rawPrediction", "__scaled")


class ScaledPerceptron(Estimator):
    """d -> 30 -> 2 perceptron on standardised features."""

    def __init__(self, hidden: int = 30, maxIter: int = 30, seed: int = 0):
        super().__init__()
        self.hidden, self.maxIter, self.seed = hidden, maxIter, seed

    def _fit(self, df: DataFrame):
        d = len(df.select("features").head()[0])
        scaler = StandardScaler(inputCol="features", outputCol="__scaled", withMean=True, withStd=True)
        mlp = MultilayerPerceptronClassifier(
            featuresCol="__scaled", layers=[d, self.hidden, 2], maxIter=self.maxIter, seed=self.seed
        )
        return Pipeline(stages=[scaler, mlp]).fit(df)


# Ranges of the tuned settings. ("int", low, high),
# ("log", low, high) and ("one", choices).
TREE_SPACE = {
    "impurity": ("one", ["gini", "entropy"]),
    "maxDepth": ("int", 3, 30),
    "minInstancesPerNode": ("int", 1, 10),
}
FOREST_SPACE = {**TREE_SPACE, "bootstrap": ("one", [True, False]), "featureSubsetStrategy": ("one", ["sqrt", "log2"]), "numTrees": ("int", 50, 500)}
BOOST_SPACE = {"learningRate": ("log", 0.1, 1.0), "rounds": ("int", 10, 500)}
SPACES = {
    "DecisionTree": TREE_SPACE,
    "DecisionTree(balanced)": TREE_SPACE,
    "RandomForest": FOREST_SPACE,
    "RandomForest(balanced)": FOREST_SPACE,
    "BalancedBagging": {"bootstrap": ("one", [True, False]), "rounds": ("int", 5, 50)},
    "BalancedRandomForest": {**TREE_SPACE, "rounds": ("int", 50, 500)},
    "BalancedRandomForest(balanced)": {**TREE_SPACE, "rounds": ("int", 50, 500)},
    "GradientBoosting": {
        "maxDepth": ("int", 1, 10),
        "minInfoGain": ("log", 1e-4, 1e-1),
        "subsamplingRate": ("log", 0.5, 1.0),
        "minInstancesPerNode": ("int", 1, 10),
        "stepSize": ("log", 0.1, 1.0),
    },
    "RUSBoost": BOOST_SPACE,
    "AdaBoost": BOOST_SPACE,
    "LinearSVC": {"C": ("log", 0.1, 100.0)},
    "LinearSVC(balanced)": {"C": ("log", 0.1, 100.0)},
}


def make_model(name: str, seed: int = 0, **params):
    """Unfitted learner by its stored name; the incumbent rule needs no fit and is a model at once."""
    plain = name.removesuffix("(balanced)")
    balanced = name != plain
    if plain == "DecisionTree":
        return Forest(seed=seed, balanced=balanced, **{"numTrees": 1, "featureSubsetStrategy": "sqrt", **params})
    if plain == "RandomForest":
        return Forest(seed=seed, balanced=balanced, **params)
    if plain == "BalancedBagging":
        return BalancedBagging(seed=seed, **params)
    if plain == "BalancedRandomForest":
        return BalancedRandomForest(seed=seed, balanced=balanced, **params)
    if plain == "GradientBoosting":
        return GBTClassifier(seed=seed, **params)
    if plain == "RUSBoost":
        return RUSBoost(seed=seed, **params)
    if plain == "AdaBoost":
        return AdaBoost(seed=seed, **params)
    if plain == "LinearSVC":
        return ScaledSVC(balanced=balanced, **params)
    if plain == "Perceptron":
        return ScaledPerceptron(seed=seed, **params)
    if plain == "ThresholdScreen":
        return ThresholdScreen(**params)
    raise KeyError(name)


def feature_importances(model, names: list[str]) -> dict[str, float] | None:
    """Importances by feature, averaged over member trees; None without them."""
    if hasattr(model, "featureImportances"):
        v = model.featureImportances.toArray()
        return {n: float(v[i]) if i < len(v) else 0.0 for i, n in enumerate(names)}
    if isinstance(model, (AveragedModel, BoostedModel)):
        v = model.trees.importances
        return {n: float(v[i]) if i < len(v) else 0.0 for i, n in enumerate(names)}
    return None
