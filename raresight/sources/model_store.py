"""Fitted models per (combination, tag, fold) under one root folder."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Model, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.models import AveragedModel, BoostedModel, ForestModel, MarginModel, PackedTrees, ThresholdScreen

META = "kind string, numbers array<double>, variant string"
NODES = "tree int, node int, feature int, threshold double, left int, right int, value double"


def _fold_path(root: str, key: dict, fold: int) -> str:
    inner = "/".join(f"{k}={v}" for k, v in key.items())
    return f"{root}/{inner}/fold={fold}"


def fold_path(root: str, parts: tuple[str, ...], fold: str = "fold") -> Column:
    """Where ``save_model`` puts the models of rows whose key is in the columns ``parts``."""
    return F.concat(F.lit(root), *[F.concat(F.lit(f"/{c}="), F.col(c)) for c in parts], F.lit("/fold="), F.col(fold).cast("string"))


def node_rows(trees: PackedTrees) -> list[tuple]:
    """A row per node; numbers of nodes count inside their tree."""
    tree = np.searchsorted(trees.roots, np.arange(len(trees.feature)), side="right") - 1
    first = trees.roots[tree]
    columns = (tree, np.arange(len(first)) - first, trees.feature, trees.threshold, trees.left - first, trees.right - first, trees.value)
    return list(zip(*(c.tolist() for c in columns)))


def packed(rows: list, importances: list[float]) -> PackedTrees:
    rows = sorted(rows, key=lambda r: (r["tree"], r["node"]))
    tree = np.array([r["tree"] for r in rows])
    roots = np.flatnonzero(np.diff(tree, prepend=-1))
    first = roots[tree] if len(rows) else tree
    column = lambda name, kind: np.array([r[name] for r in rows], kind)
    left, right = ((column(c, np.int64) + first).astype(np.int32) for c in ("left", "right"))
    return PackedTrees(column("feature", np.int32), column("threshold", float), left, right, column("value", float), roots.astype(np.int32), np.array(importances))


def save_model(spark: SparkSession, model: Model, root: str, key: dict, fold: int) -> str:
    """Native models as their own folders, packed trees as a table of nodes."""
    path = _fold_path(root, key, fold)
    native, kind, numbers, variant = None, "native", [], ""
    if isinstance(model, ThresholdScreen):
        kind, numbers = "threshold", [float(model.index), model.cutoff]
    elif isinstance(model, (AveragedModel, BoostedModel)):
        kind, numbers = "averaged", []
        if isinstance(model, BoostedModel):
            kind, numbers, variant = "boosted", model.alphas, model.variant
        spark.createDataFrame(node_rows(model.trees), NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(model.trees.importances.tolist(),)], "importances array<double>").write.mode("overwrite").parquet(f"{path}/importances")
    elif isinstance(model, MarginModel):
        native, kind, numbers = model.fitted, "margin", [model.slope, model.intercept]
    elif isinstance(model, ForestModel):
        native, kind = model.forest, "forest"
    else:
        native = model
    if native is not None:
        wrapped = native if isinstance(native, PipelineModel) else PipelineModel(stages=[native])
        wrapped.write().overwrite().save(f"{path}/native")
    # the table is written last: a folder without it is an unfinished save
    spark.createDataFrame([(kind, numbers, variant)], META).coalesce(1).write.mode("overwrite").parquet(f"{path}/kind")
    return path


def load_model(spark: SparkSession, root: str, key: dict, fold: int) -> Model:
    path = _fold_path(root, key, fold)
    kind, numbers, variant = spark.read.schema(META).parquet(f"{path}/kind").first()
    if kind == "threshold":
        return ThresholdScreen(int(numbers[0]), numbers[1])
    if kind in ("averaged", "boosted"):
        importances = spark.read.parquet(f"{path}/importances").first()[0]
        trees = packed(spark.read.schema(NODES).parquet(f"{path}/nodes").collect(), importances)
        return AveragedModel(trees) if kind == "averaged" else BoostedModel(trees, numbers, variant)
    whole = PipelineModel.load(f"{path}/native")
    native = whole.stages[0] if len(whole.stages) == 1 else whole
    if kind == "margin":
        return MarginModel(whole, *numbers)
    return ForestModel(native) if kind == "forest" else native


class StoredModels:
    """Pre-fitted model per fold; exactly one model for each fold."""

    def __init__(self, spark: SparkSession, root: str, key: dict, folds: list[int]):
        if len(set(folds)) != len(folds):
            raise ValueError("more than one model for a fold")
        self.models = {f: load_model(spark, root, key, f) for f in folds}

    def score(self, df: DataFrame, fold: str = "fold", keep: list[str] = ("case_index", "label")) -> DataFrame:
        """Every row by the model of its own fold."""
        from ..operators.models import scored

        out = None
        for f, m in self.models.items():
            part = scored(m, df.where(F.col(fold) == f), [*keep, fold])
            out = part if out is None else out.unionByName(part)
        return out
