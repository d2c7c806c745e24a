"""Experiment grid, training per fold, layered filters and tuning."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, functions as F

from ..functions.metrics import classification_metrics, confusion_aggregates, scorers
from ..operators import folds as fold_ops
from ..operators.curves import percentile_cut
from ..operators.features import feature_chain
from ..operators.models import SPACES, make_model, ml_frame, scored
from ..operators.resample import resample
from ..session import truncate_lineage
from ..sources import catalog
from ..sources.model_store import StoredModels, fold_path, save_model
from ..sources.tables import append_extra_train, save_results


class RateEvaluator(Evaluator):
    """A named scorer from one aggregate over (label, prediction)."""

    def __init__(self, name: str = "accuracy"):
        super().__init__()
        self.name = name

    def _evaluate(self, df: DataFrame) -> float:
        counts = df.agg(*confusion_aggregates(F.col("label"), F.col("prediction")))
        return float(counts.select(scorers()[self.name].alias("s")).first()[0] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


def sample_settings(space: dict, draws: int, seed: int, bounds: dict | None = None) -> list[dict]:
    """Settings drawn from a search space; ``bounds`` narrows integer ranges."""
    rng = random.Random(seed)
    out = []
    for _ in range(draws):
        one = {}
        for name, spec in space.items():
            if spec[0] == "one":
                one[name] = rng.choice(spec[1])
            elif spec[0] == "int":
                lo, hi = (bounds or {}).get(name, spec[1:])
                one[name] = rng.randint(lo, hi)
            else:
                lo, hi = spec[1:]
                one[name] = lo * (hi / lo) ** rng.random()
        out.append(one)
    return out


def tune(train: DataFrame, model: str, scorer: str, draws: int = 10, inner_folds: int = 5, seed: int = 0, parallelism: int = 5, bounds: dict | None = None):
    """Best of ``draws`` settings by stratified inner validation, refitted.

    Returns (fitted model, settings, score).
    """
    settings = sample_settings(SPACES[model], draws, seed, bounds)
    if not settings[0]:
        raise ValueError(f"{model} has no search space")
    learner = make_model(model, seed)
    maps = [{learner.getParam(k): v for k, v in s.items()} for s in settings]
    inner = truncate_lineage(fold_ops.stratified(train, k=inner_folds, seed=seed + 1, name="inner"))
    cv = CrossValidator(
        estimator=learner,
        estimatorParamMaps=maps,
        evaluator=RateEvaluator(scorer),
        numFolds=inner_folds,
        foldCol="inner",
        parallelism=parallelism,
    )
    fitted = cv.fit(inner)
    best = max(range(len(maps)), key=lambda i: fitted.avgMetrics[i])
    return fitted.bestModel, settings[best], fitted.avgMetrics[best]


def layer_hard(rows: DataFrame, layer: DataFrame) -> DataFrame:
    """Rows the previous layer calls positive, both sides of a fold."""
    return rows.join(layer.where("predicted = 1").select("case_index", "fold"), ["case_index", "fold"], "left_semi")


def layer_percentile(rows: DataFrame, layer: DataFrame, p: float, by: list[str]) -> DataFrame:
    """Rows whose previous-layer score is strictly above
    max(percentile p, 0.5), the percentile taken per ``by`` (fold and side)."""
    joined = rows.join(layer.select("case_index", *[c for c in by if c in layer.columns], "proba"), ["case_index", *[c for c in by if c in layer.columns]])
    return percentile_cut(joined, by, "proba", p, 0.5)


def layer_scores(layer, rows: DataFrame, fold: int) -> DataFrame:
    """case_index, predicted, proba of a previous layer for one fold.

    ``layer`` is a set of stored models, whose model of this fold scores both
    sides, or a frame of predictions (with ``fold`` for the model's fold).
    """
    if isinstance(layer, StoredModels):
        return scored(layer.models[fold], ml_frame(rows), ["case_index"])
    own = layer.where(F.col("fold") == fold) if "fold" in layer.columns else layer
    return own.select("case_index", *[c for c in ("predicted", "proba") if c in own.columns])


def apply_layers(train: DataFrame, test: DataFrame, layers: list, fold: int, passthrough: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Shrink both sides by every layer in order: to the rows called positive,
    or with ``passthrough`` to the scores strictly above
    max(percentile, 0.5), each side with its own percentile."""
    for layer in layers:
        sides = []
        for rows in (train, test):
            s = layer_scores(layer, rows, fold)
            if passthrough is None:
                rows = rows.join(s.where("predicted = 1").select("case_index"), "case_index", "left_semi")
            else:
                joined = rows.join(s.select("case_index", F.col("proba").alias("__layer")), "case_index")
                rows = percentile_cut(joined, [], "__layer", passthrough, 0.5).select(*rows.columns)
            sides.append(truncate_lineage(rows))
        train, test = sides
    return train, test


def prepare_train(
    train: DataFrame, fold: int, resampler: str, ratio: float, seed: int, extra: DataFrame | None = None, skip_resample: bool = False
) -> DataFrame:
    """Extra rows, then resampling, then the vector frame; written once."""
    rows = train.select("case_index", "label", "features")
    if extra is not None:
        rows = append_extra_train(rows, extra, fold).select("case_index", "label", "features")
    if not skip_resample:
        rows = resample(rows, resampler, ratio, seed).select("case_index", "label", "features")
    return ml_frame(truncate_lineage(rows))


def train_eval_fold(
    df: DataFrame,
    fold: int,
    model: str,
    resampler: str = "none",
    ratio: float = 0.02,
    params: dict | None = None,
    layers: list = (),
    passthrough: float | None = None,
    extra: DataFrame | None = None,
    seed: int = 0,
    search: dict | None = None,
    skip_resample: bool = False,
):
    """Split -> layers -> extra rows -> resample train -> fit -> score the
    untouched test side. Returns (predictions, fitted model)."""
    train, test = apply_layers(*fold_ops.split(df, fold), list(layers), fold, passthrough)
    train = prepare_train(train, fold, resampler, ratio, seed, extra, skip_resample)
    if search is not None:
        fitted, _, _ = tune(train, model, seed=seed, **search)
    else:
        fitted = make_model(model, seed, **(params or {})).fit(train)
    preds = scored(fitted, ml_frame(test)).select(
        "case_index", F.lit(fold).alias("fold"), F.col("label").alias("actual"), "predicted", "proba"
    )
    return preds, fitted


@dataclass
class FeatureOptions:
    """How a grid makes a cell's vectors from named columns.

    ``stored`` has a feature set per combination (``catalog.upsert_feature_sets``);
    a combination without one takes all ``columns``. Primary weights, ratios and
    powers follow in that order. Primary weights come from all rows unless
    ``fit_on`` names the rows.
    """

    columns: list[str]
    stored: DataFrame | None = None
    primary: bool = False
    ratios: bool = False
    powers: bool = False
    fit_on: DataFrame | None = None


def feature_vectors(df: DataFrame, options: FeatureOptions, combination: int | None = None) -> tuple[DataFrame, list[str]]:
    """(case_index, label, other columns but the features, features) and the names of the vector's places.

    A stored feature that the table has not is an error.
    """
    stored = catalog.load_feature_set(options.stored, combination) if options.stored is not None and combination is not None else []
    rest = [c for c in df.columns if c not in options.columns and c not in ("case_index", "label")]
    made = feature_chain(df, options.columns, "label", "case_index", stored or None, options.primary, options.ratios, options.powers, options.fit_on)
    names = [c for c in made.columns if c not in ("case_index", "label")]
    vectors = made.select("case_index", "label", F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("features"))
    return (vectors.join(df.select("case_index", *rest), "case_index") if rest else vectors), names


def member(spec, name: str, seed: int):
    """A grid's member: a learner to fit, or a fitted model or stored models that are taken as they are."""
    return spec if isinstance(spec, (Model, StoredModels)) else make_model(name, seed, **spec)


def is_fixed(one) -> bool:
    return isinstance(one, (Model, StoredModels))


def run_grid(
    df: DataFrame,
    models: dict[str, dict | Model | StoredModels],
    resamplers: dict[str, float],
    scorer_names: list[str],
    tag: str,
    run_ts: str,
    results_path: str,
    models_path: str,
    cross_validators: dict[str, str | None] | None = None,
    folds: list[int] | None = None,
    layers: list = (),
    passthrough: float | None = None,
    extra: DataFrame | None = None,
    parallelism: int = 2,
    seed: int = 0,
    search: dict | None = None,
    features: FeatureOptions | None = None,
    catalog_path: str | None = None,
    metadata: str = "{}",
) -> DataFrame:
    """Every (cross validator, resampler, fold, model, scorer) cell; results
    land in the partitioned store, models in the model store. Returns the
    metrics.

    ``models`` maps a stored name to settings, or to a fitted model or stored
    models of all folds, whose fit and resampling are skipped.
    ``cross_validators`` maps a name to its fold column (None: train and test
    are all rows). ``features`` makes the vectors of each combination from named
    columns; without it ``df`` has them. The rows of a (feature set, fold) and
    their resampled form are prepared when their cells begin and shared by them.
    Cells are independent jobs submitted from a few driver threads; Spark
    schedules their tasks. With ``catalog_path`` the run is recorded there, once.
    """
    spark = df.sparkSession
    # combinations by their vectors: most grids have one set for all
    groups: dict[tuple, list[tuple[str, str]]] = {}
    validators = cross_validators or {"StratifiedKFold_5": "fold"}
    for cv in validators:
        for name in models:
            for scorer in scorer_names:
                chosen: tuple = ()
                if features is not None and features.stored is not None:
                    chosen = tuple(catalog.load_feature_set(features.stored, catalog.combination_id(name, "none", scorer, cv)))
                groups.setdefault((cv, chosen), []).append((name, scorer))
    for (cv, chosen), members in groups.items():
        rows = df
        if features is not None:
            one = FeatureOptions(list(chosen) or features.columns, None, features.primary, features.ratios, features.powers, features.fit_on)
            kept = [c for c in df.columns if c not in features.columns]
            rows = truncate_lineage(feature_vectors(df.select(*kept, *one.columns), one)[0])
        _run_cells(spark, rows, cv, validators[cv], members, models, resamplers, tag, run_ts, results_path, models_path, folds, layers, passthrough, extra, parallelism, seed, search)
    stored = spark.read.parquet(results_path).where((F.col("tag") == tag) & (F.col("run_ts") == run_ts))
    metrics = classification_metrics(stored, ["cross_validator", "resampler", "model", "scorer", "tag", "run_ts", "fold"])
    if catalog_path is not None:
        metrics = truncate_lineage(metrics)
        parts = ("cross_validator", "resampler", "model", "scorer", "tag")
        folder = F.concat(*[F.concat(F.lit(f"/{c}="), F.col(c)) for c in parts], F.lit("/run_ts="), F.col("run_ts"), F.lit("/fold="), F.col("fold").cast("string"))
        files = {"result_file": F.concat(F.lit(results_path), folder), "model_file": fold_path(models_path, ("cross_validator", "resampler", "model", "tag", "scorer"))}
        catalog.write_run(metrics.withColumns(files), catalog_path, f"{tag}-{run_ts}", F.to_timestamp_ntz(F.lit(run_ts), F.lit("yyyy-MM-dd_HH-mm-ss")), metadata)
    return metrics


def _run_cells(spark, rows, cv, column, members, models, resamplers, tag, run_ts, results_path, models_path, folds, layers, passthrough, extra, parallelism, seed, search) -> None:
    """The cells of combinations that share their vectors."""
    rows = rows if column is None else rows.withColumn("fold", F.col(column))
    if column is None:
        ids = [0]
    else:  # one row per fold
        ids = folds if folds is not None else sorted(r[0] for r in rows.select("fold").distinct().collect())
    names = list(dict.fromkeys(name for name, _ in members))

    def run(cell) -> None:
        resampler, fold, train, test, name = cell
        scorers_of = [s for n, s in members if n == name]
        key = {"cross_validator": cv, "resampler": resampler, "model": name, "tag": tag}
        one = member(models[name], name, seed)
        # without a search the scorer is only recorded: one fit serves all
        for group in [[s] for s in scorers_of] if search is not None and not is_fixed(one) else [scorers_of]:
            if isinstance(one, StoredModels):
                fitted = one.models[fold]
            elif is_fixed(one):
                fitted = one
            elif search is not None:
                fitted, _, _ = tune(train, name, group[0], seed=seed, **search)
            else:
                fitted = one.fit(train)
            preds = scored(fitted, test).select(
                "case_index",
                F.col("label").alias("actual"),
                "predicted",
                "proba",
                *[F.lit(v).alias(k) for k, v in key.items()],
                F.lit(run_ts).alias("run_ts"),
                F.lit(fold).alias("fold"),
                F.explode(F.array(*[F.lit(s) for s in group])).alias("scorer"),
            )
            save_results(preds, results_path)
            for scorer in group:
                save_model(spark, fitted, models_path, {**key, "scorer": scorer}, fold)

    learners = [n for n in names if not is_fixed(member(models[n], n, seed))]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        # a fold's sides are made as its cells begin, not before the first fit of the grid
        for fold in ids:
            sides = (rows, rows) if column is None else fold_ops.split(rows, fold)
            train, test = apply_layers(*sides, list(layers), fold, passthrough)
            test = ml_frame(test)
            cells = []
            for resampler, ratio in resamplers.items():
                ready = prepare_train(train, fold, resampler, ratio, seed, extra) if learners else None
                cells += [(resampler, fold, ready, test, name) for name in names]
            list(pool.map(inheritable_thread_target(spark)(run), cells))
