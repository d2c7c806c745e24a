"""Queries over models, training runs, tuning and attributions.

Labels come from event type and value; the type itself is not a feature, so
the learners have a real task.
"""

from pyspark.sql import functions as F

from raresight.functions.metrics import classification_metrics, confusion_counts
from raresight.operators import curves, explain, explain_tables, models, resample
from raresight.operators.sweep import CUTOFFS, threshold_counts
from raresight.plans import experiment, results
from raresight.session import scratch_path, truncate_lineage
from raresight.sources import catalog, model_store

from .aggregates import PHI, phi_table
from .fixtures import COUNTS_SQL, FEATURES, FLOOR, S, SP, SPMA, analysis, predictions, records, screening, u_parts, with_ctes


def rows(spark, sf):
    return screening(spark, sf).select("case_index", "label", "fold", F.array(*FEATURES).alias("features"))


FOLDS = range(5)


_FLOORS: dict = {}


def floor(spark, sf):
    """Half of what the best single feature gains over chance, as an area under the curve."""
    if (spark, sf) not in _FLOORS:
        cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in FEATURES])
        long = screening(spark, sf).select("label", F.explode(cells).alias("c")).select("label", "c.*")
        areas = curves.auc(long, ["feature"], "x", "label").select(F.greatest("auc", 1 - F.col("auc")).alias("a"))
        _FLOORS[spark, sf] = 0.5 + (areas.agg(F.max("a")).first()[0] - 0.5) / 2
    return _FLOORS[spark, sf]


def learned(spark, sf, scores):
    """The floor, and whether scores (actual, proba) rank the cases at least so well."""
    area = curves.auc(scores.withColumn("all", F.lit(1)), ["all"]).first()["auc"]
    return F.lit(round(floor(spark, sf), 6)).alias("floor"), F.lit(area is not None and area >= floor(spark, sf)).alias("learned")


def sound(predicted="predicted", proba="proba"):
    """A class and a probability."""
    return (F.col(predicted).isin(0, 1) & F.col(proba).between(0.0, 1.0)).alias("valid")


def _model(name, **params):
    """Fit on four folds, score all cases: each has a class and a probability, and the scores rank the cases."""

    def run(spark, sf):
        data = truncate_lineage(rows(spark, sf))
        _, fitted = experiment.train_eval_fold(data, 0, name, params=params)
        scores = models.scored(fitted, models.ml_frame(data), ["case_index", "fold", "label"]).withColumnRenamed("label", "actual")
        scores = truncate_lineage(scores)
        return scores.select("case_index", "fold", "actual", sound(), *learned(spark, sf, scores))

    return run


def model_threshold(spark, sf):
    m = models.ThresholdScreen(0, 150.0)
    return models.scored(m, models.ml_frame(rows(spark, sf)))


_FOREST = dict(numTrees=50, maxDepth=4)


def model_from_storage(spark, sf):
    """Models of all folds are stored, loaded and score their own folds as before."""
    data, root = truncate_lineage(rows(spark, sf)), scratch_path(spark, "models")
    key, before = {"combination_id": 1, "tag": "original_data"}, None
    for fold in FOLDS:
        preds, fitted = experiment.train_eval_fold(data, fold, "DecisionTree", params=dict(maxDepth=4))
        model_store.save_model(spark, fitted, root, key, fold)
        before = preds if before is None else before.unionByName(preds)
    after = model_store.StoredModels(spark, root, key, list(FOLDS)).score(models.ml_frame(data))
    both = truncate_lineage(after.select("case_index", "predicted", F.col("proba").alias("loaded")).join(before.select("case_index", "actual", "proba"), "case_index"))
    valid = sound() & (F.abs(F.col("loaded") - F.col("proba")) < 1e-12)
    varied = both.agg(F.count_distinct("proba")).first()[0] > 1
    return both.select("case_index", (valid & F.lit(varied)).alias("valid"))


def model_store_q(spark, sf):
    """A boosted model survives the round trip: same scores before and after."""
    data, root = rows(spark, sf), scratch_path(spark, "models")
    preds, fitted = experiment.train_eval_fold(data, 0, "AdaBoost", params=dict(rounds=10))
    model_store.save_model(spark, fitted, root, {"combination_id": 2}, 0)
    again = models.scored(model_store.load_model(spark, root, {"combination_id": 2}, 0), models.ml_frame(data.where("fold = 0")))
    return preds.join(again.select("case_index", F.col("proba").alias("loaded")), "case_index").select(
        "case_index", (F.abs(F.col("proba") - F.col("loaded")) < 1e-12).alias("same")
    )


def class_weight_balanced(spark, sf):
    return models.balanced_weights(screening(spark, sf)).groupBy("label", "weight").agg(F.count(F.lit(1)).alias("n"))


def proba_fallback(spark, sf):
    p = predictions(spark, sf)
    missing = F.when(F.col("combination_id") % 2 == 0, F.col("proba"))
    out = p.withColumn("p1", models.proba_fallback(missing, F.col("predicted")))
    return out.select("combination_id", "case_index", (F.lit(1.0) - F.col("p1")).alias("p0"), "p1")


def _grid(spark, sf, members, options=None, tag="original_data", resamplers=None, catalog_path=None, run_ts="2024-03-02_09-30-00", **more):
    return experiment.run_grid(
        more.pop("data", None) or rows(spark, sf),
        members,
        resamplers or {"none": 0.02},
        more.pop("scorers", ["recall_score"]),
        tag,
        run_ts,
        more.pop("results_path", None) or scratch_path(spark, "grid"),
        more.pop("models_path", None) or scratch_path(spark, "gridmodels"),
        features=options,
        catalog_path=catalog_path,
        **more,
    )


def experiment_grid(spark, sf):
    """Cases and positives of every cell, counted from the stored predictions; the rule's cells in full."""
    cells = _grid(
        spark, sf,
        {"DecisionTree": dict(maxDepth=4), "LinearSVC": dict(maxIter=10), "ThresholdScreen": dict(index=0, cutoff=150.0)},
        resamplers={"none": 0.02, "RandomUnderSampler": 0.05},
        scorers=["recall_score", "fp_fn"],
    )
    positives = F.col("true_positives") + F.col("false_negatives")
    rule = F.col("model") == "ThresholdScreen"
    return cells.select(
        "cross_validator", "resampler", "model", "scorer", "tag", "fold", positives.alias("positives"),
        (positives + F.col("false_positives") + F.col("true_negatives")).alias("cases"),
        F.when(rule, F.col("false_positives")).otherwise(-1).alias("rule_fp"), F.when(rule, F.col("true_positives")).otherwise(-1).alias("rule_tp"),
    )


_RULES = {"ThresholdScreen": 150.0, "ThresholdScreen(180)": 180.0, "ThresholdScreen(120)": 120.0}


def _stored_grid(spark, sf):
    """A grid of threshold rules run twice over one catalogue; returns the catalogue's tables and the results."""
    root, results_path = scratch_path(spark, "catalogue"), scratch_path(spark, "grid")
    members = {name: models.ThresholdScreen(0, cut) for name, cut in _RULES.items()}
    for _ in range(2):
        _grid(spark, sf, members, catalog_path=root, results_path=results_path, metadata='{"layer": 0}')
    return catalog.read_catalog(spark, root), spark.read.parquet(results_path)


def grid_catalogue(spark, sf):
    """What a grid has recorded, by the star join; its repetition has added nothing."""
    tables, _ = _stored_grid(spark, sf)
    star = catalog.star_join(tables, catalog.metadata_filter(tag="^original", model="^Threshold"))
    records_of = tables["record"].groupBy("combination_id").agg(F.count(F.lit(1)).alias("records"))
    return star.join(records_of, "combination_id").select(
        "model", "resampler", "cross_validator", "scorer", "tag", "fold", "metadata", "records",
        "true_positives", "false_positives", "false_negatives", "true_negatives",
    )


def grid_vote(spark, sf):
    """Grid -> records -> star -> best without a miss -> unanimous vote on the stored rows."""
    from raresight.functions.metrics import rates
    from raresight.operators import ensemble

    tables, stored = _stored_grid(spark, sf)
    star = truncate_lineage(catalog.star_join(tables).withColumns({k: v for k, v in rates().items() if k in ("fnr", "ppv")}))
    best = results.top_zero_fnr(star, 10).join(tables["combination"].withColumnRenamed("id", "combination_id"), "combination_id")
    names = {r["combination_id"]: r["model"] for r in best.select("combination_id", "model").collect()}
    order = {c: i + 1 for i, c in enumerate(sorted(names, key=names.get))}
    number = F.create_map(*[F.lit(x) for name, c in sorted((n, order[c]) for c, n in names.items()) for x in (name, c)])
    votes = stored.withColumn("combination_id", F.element_at(number, F.col("model"))).where(F.col("combination_id").isNotNull())
    return ensemble.and_subsets(votes, list(order.values())).select("subset", "model_count", "tp", "fp", "fn")


def grid_features(spark, sf):
    """Vectors of two feature choices: a stored set with ratios, and powers of all features."""
    wide = screening(spark, sf).select("case_index", "label", "fold", *FEATURES)
    sets = spark.createDataFrame([(7, '["tsh","f_k"]', 1)], "combination_id bigint, feature_set string, created_at int")
    out = None
    for name, options, combination in (
        ("ratios", experiment.FeatureOptions(FEATURES, sets, ratios=True), 7), ("powers", experiment.FeatureOptions(FEATURES, sets, powers=True), 8),
    ):
        made, names = experiment.feature_vectors(wide, options, combination)
        cells = made.select("case_index", F.posexplode("features").alias("at", "x"))
        part = cells.select(F.lit(name).alias("choice"), "case_index", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("at") + 1).alias("feature"), "x")
        out = part if out is None else out.unionByName(part)
    return out


def grid_two_choices(spark, sf):
    """Cells of a grid whose combinations differ in their stored feature sets; the rule looks at its first feature."""
    wide = screening(spark, sf).select("case_index", "label", "fold", *FEATURES)
    combination = lambda model: catalog.combination_id(model, "none", "recall_score", "StratifiedKFold_5")
    sets = spark.createDataFrame(
        [(combination("ThresholdScreen"), '["tsh"]', 1), (combination("ThresholdScreen(hour)"), '["f_hour","tsh"]', 1)], "combination_id bigint, feature_set string, created_at int"
    )
    members = {"ThresholdScreen": models.ThresholdScreen(0, 150.0), "ThresholdScreen(hour)": models.ThresholdScreen(0, 12.0)}
    cells = _grid(spark, sf, members, experiment.FeatureOptions(FEATURES, sets), data=wide)
    return cells.select("model", "fold", "true_positives", "false_positives", "false_negatives", "true_negatives")


def train_eval_fold(spark, sf):
    """With a first layer (threshold), extra rows and resampling; the fitted model ranks the cases."""
    data = truncate_lineage(rows(spark, sf))
    layer = data.select("case_index", (F.col("features")[0] >= 20).cast("int").alias("predicted"))
    extra = data.where("label = 1").withColumn("case_index", -F.col("case_index") - 1)
    preds, fitted = experiment.train_eval_fold(data, 2, "RandomForest", "RandomUnderSampler", 0.1, _FOREST, [layer], extra=extra)
    scores = models.scored(fitted, models.ml_frame(data)).withColumnRenamed("label", "actual")
    return preds.select("case_index", "fold", "actual", sound(), *learned(spark, sf, scores))


def hyperparameter_search(spark, sf):
    """Ten settings, five inner folds; the winner's test counts and whether its settings lie in the bounds."""
    data = rows(spark, sf)
    train, test = data.where("fold <> 0"), data.where("fold = 0")
    train = models.ml_frame(truncate_lineage(train.select("case_index", "label", "features")))
    fitted, settings, score = experiment.tune(
        train, "DecisionTree(balanced)", "f10_score_pos", draws=10, inner_folds=5, parallelism=5, bounds={"maxDepth": (3, 6)}
    )
    m = models.scored(fitted, models.ml_frame(test)).select(F.col("label").alias("actual"), "predicted", F.lit(0).alias("fold"))
    mark = learned(spark, sf, models.scored(fitted, models.ml_frame(data)).withColumnRenamed("label", "actual"))
    positives = F.col("true_positives") + F.col("false_negatives")
    return classification_metrics(m, ["fold"]).select(
        positives.alias("positives"),
        (positives + F.col("false_positives") + F.col("true_negatives")).alias("cases"),
        F.lit(0 < score <= 1 and 3 <= settings["maxDepth"] <= 6).alias("valid"),
        *mark,
    )


def custom_scorers(spark, sf):
    """All named scorers of each stored combination."""
    from raresight.functions.metrics import scorers

    counts = confusion_counts(predictions(spark, sf), ["combination_id"])
    return counts.select("combination_id", *[F.round(c, 9).alias(n) for n, c in scorers().items()])


def _layer(spark, sf):
    return predictions(spark, sf).where("combination_id = 3").select("case_index", "fold", "predicted", "proba")


def layered_filter_hard(spark, sf):
    return experiment.layer_hard(screening(spark, sf).select("case_index", "fold", "tsh", "label"), _layer(spark, sf))


def layered_filter_percentile(spark, sf):
    """Both sides of fold 0, cut separately."""
    s = screening(spark, sf).select("case_index", "fold", "tsh", "label")
    s = s.withColumn("side", F.when(F.col("fold") == 0, F.lit("test")).otherwise(F.lit("train")))
    out = experiment.layer_percentile(s, _layer(spark, sf).select("case_index", "proba"), 0.95, ["side"])
    return out.select("case_index", "side", "fold", "tsh", "label", F.round("cut", 9).alias("cut"))


def layered_two_stage(spark, sf):
    """First layer per fold -> prototypes of what it discards -> second layer
    on what it passes, trained with the prototypes."""
    data = truncate_lineage(rows(spark, sf))
    root, key = scratch_path(spark, "layer"), {"combination_id": 1, "tag": "all_features"}
    for fold in FOLDS:
        _, fitted = experiment.train_eval_fold(data, fold, "DecisionTree(balanced)", params=dict(maxDepth=4))
        model_store.save_model(spark, fitted, root, key, fold)
    layer = model_store.StoredModels(spark, root, key, list(FOLDS))
    own = layer.score(models.ml_frame(data)).select("case_index", "predicted")
    protos = resample.prototypes(data.join(own, "case_index"), "predicted", k=8)
    out = None
    for fold in FOLDS:
        preds, _ = experiment.train_eval_fold(data, fold, "RandomForest", params=dict(numTrees=10, maxDepth=4), layers=[layer], extra=protos)
        out = preds if out is None else out.unionByName(preds)
    # a case reaches the second layer exactly if the first calls it positive
    both = data.select("case_index", "fold", "label").join(own.withColumnRenamed("predicted", "first"), "case_index")
    both = both.join(out.select("case_index", "predicted", "proba"), "case_index", "left")
    both = truncate_lineage(both.withColumnRenamed("label", "actual"))
    passed = F.col("predicted").isin(0, 1) & F.col("proba").between(0.0, 1.0)
    valid = F.when(F.col("first") == 1, F.coalesce(passed, F.lit(False))).otherwise(F.col("predicted").isNull())
    # the first layer passes some cases and holds some back
    kinds = both.agg(F.count_distinct("first")).first()[0]
    return both.select("case_index", "fold", "actual", (valid & F.lit(kinds == 2)).alias("valid"))


def threshold_baseline_run(spark, sf):
    from raresight.functions.metrics import with_rates

    out = with_rates(threshold_counts(screening(spark, sf), "tsh", "label", ["fold"]))
    return out.select(
        F.concat(F.lit("baseline_ge_"), F.col("cutoff").cast("string")).alias("tag"), "fold", "true_positives", "false_positives", "fnr", "ppv"
    )


def combination_analytics(spark, sf):
    cond = catalog.metadata_filter(tag="^(original_data|all_features)$")
    star = catalog.star_join(catalog.star_tables(records(spark, sf)), cond)
    from raresight.functions.metrics import rates

    best = results.best_per_tag(star.withColumns({k: v for k, v in rates().items() if k in ("fnr", "ppv")}), 0.1, 10)
    return results.rows_of(predictions(spark, sf), best).select("tag", "combination_id", "fold", "case_index", "actual", "proba")


def _all_folds(spark, sf):
    data, out = rows(spark, sf), {}
    for fold in FOLDS:
        out[(1, fold)] = experiment.train_eval_fold(data, fold, "DecisionTree", params=dict(maxDepth=4))[1]
        out[(2, fold)] = experiment.train_eval_fold(data, fold, "BalancedRandomForest", params=dict(rounds=5, maxDepth=4))[1]
        out[(3, fold)] = experiment.train_eval_fold(data, fold, "LinearSVC", params=dict(maxIter=20))[1]
    return out


def forest_importances(spark, sf):
    return explain.importance_rows(spark, _all_folds(spark, sf), FEATURES)


def feature_importance(spark, sf):
    """Columns of the matrix: importances of a combination, which add up to one."""
    means = explain_tables.mean_importance(forest_importances(spark, sf), len(FOLDS))
    matrix = explain_tables.importance_matrix(means, [1, 2])
    return matrix.agg(*[F.round(F.sum(f"`{c}`"), 6).alias(f"total_{i}") for i, c in enumerate(matrix.columns[1:], 1)], F.count(F.lit(1)).alias("features"))


def _phi(spark, sf, cases):
    """Attributions of some cases, each with its score by the model itself, and whether that model learned."""
    data = truncate_lineage(rows(spark, sf))
    _, fitted = experiment.train_eval_fold(data, 0, "RandomForest", params=_FOREST)
    chosen = data.join(cases.select("case_index"), "case_index", "left_semi")
    phi = truncate_lineage(explain.shapley_values(fitted, chosen, explain.background_sample(data.where("fold <> 0")), FEATURES))
    scores = models.scored(fitted, models.ml_frame(data)).withColumnRenamed("label", "actual")
    own = models.scored(fitted, models.ml_frame(chosen)).select("case_index", "proba")
    sums = phi.groupBy("case_index").agg(F.sum("phi").alias("total"), F.max("base").alias("base")).join(own, "case_index")
    exact = sums.select("case_index", (F.abs(F.col("total") - (F.col("proba") - F.col("base"))) < 1e-9).alias("valid"))
    return phi, exact, learned(spark, sf, scores)


def shapley_values(spark, sf):
    """A case's attributions add up to its score less the background's mean score."""
    phi, exact, mark = _phi(spark, sf, screening(spark, sf).where("fold = 0"))
    return phi.join(exact, "case_index").select("case_index", "model_id", "feature", "value", "valid", *mark)


def case_explanations(spark, sf):
    cases = screening(spark, sf).where("label = 1 and fold = 0")
    phi, exact, mark = _phi(spark, sf, cases)
    out = explain.case_explanations(phi, screening(spark, sf), cases).join(exact, "case_index")
    return out.select("case_index", "episode", "fold", "label", "feature", "value", "valid", *mark)


def shap_group_features(spark, sf):
    out = explain_tables.group_features(phi_table(spark, sf), {"pair": ["f_k", "f_hour"]})
    return out.select("case_index", "model_id", "feature", F.round("value", 6).alias("value"), F.round("phi", 6).alias("phi"))


def shap_drop_feature(spark, sf):
    return explain_tables.drop_feature(phi_table(spark, sf), "tsh")


def shap_sum_features(spark, sf):
    out = explain_tables.sum_features(phi_table(spark, sf), ["f_k", "f_hour"], "both")
    return out.select("case_index", "model_id", "feature", F.round("value", 6).alias("value"), F.round("phi", 6).alias("phi"))


def shap_rank(spark, sf):
    return explain_tables.rank_features(phi_table(spark, sf), 5).withColumn("mean_abs", F.round("mean_abs", 7))


def shap_impact(spark, sf):
    return explain_tables.impact_tail_sum(phi_table(spark, sf), 0.8).select("feature", F.round("impact", 6).alias("impact"))


SPHI = with_ctes(S, PHI)
_MARK = "(select round(floor,6) from fl) as floor, true as learned"
SOUND = with_ctes(S, FLOOR) + f"select case_index, fold, label as actual, true as valid, {_MARK} from s"
_LONG = " union all ".join(f"select {{columns}}, '{f}' as feature, {f}::double as value, true as valid, {_MARK} from s where {{where}}" for f in FEATURES)
_CUTS = "(select unnest([" + ",".join(f"{c}::double" for c in CUTOFFS) + "]) as cutoff)"
_RULES_SQL = "(values " + ",".join(f"('{m}',{c}::double)" for m, c in _RULES.items()) + ") as r(model, cut)"
_RATE = "case when {d}<>0 then {n}::double/({d}) else 0 end"


def _fb(b, tp="tp", fp="fp", fn="fn"):
    d = f"({1 + b * b}*{tp}+{b * b}*{fn}+{fp})"
    return f"(case when {d}<>0 then ({1 + b * b}*{tp})::double/{d} else 0 end)"


QUERIES = {
    "model_threshold": (model_threshold, with_ctes(S) + "select case_index, label, (tsh>=150)::int as predicted, 0.0::double as proba from s"),
    "model_decision_tree": (_model("DecisionTree(balanced)", maxDepth=4), SOUND),
    "model_random_forest": (_model("RandomForest", **_FOREST), SOUND),
    "model_balanced_bagging": (_model("BalancedBagging", rounds=10, maxDepth=4), SOUND),
    "model_balanced_rf": (_model("BalancedRandomForest(balanced)", rounds=10, maxDepth=4), SOUND),
    "model_gradient_boosting": (_model("GradientBoosting", maxIter=20, maxDepth=3), SOUND),
    "model_rusboost": (_model("RUSBoost", rounds=10, maxDepth=2), SOUND),
    "model_adaboost": (_model("AdaBoost", rounds=10, variant="SAMME"), SOUND),
    "model_linear_svc": (_model("LinearSVC(balanced)", maxIter=100), SOUND),
    "model_mlp": (_model("Perceptron", maxIter=100), SOUND),
    "model_from_storage": (model_from_storage, with_ctes(S) + "select case_index, true as valid from s"),
    "model_store": (model_store_q, with_ctes(S) + "select case_index, true as same from s where fold=0"),
    "class_weight_balanced": (
        class_weight_balanced,
        with_ctes(S) + "select label, (select count(*) from s)::double/(2.0*count(*)) as weight, count(*) as n from s group by label",
    ),
    "proba_fallback": (
        proba_fallback,
        SP
        + "select combination_id, case_index, 1.0::double-p1 as p0, p1 from (select *, case when combination_id%2=0 then proba else predicted::double end as p1 from p)",
    ),
    "experiment_grid": (
        experiment_grid,
        with_ctes(S)
        + """select 'StratifiedKFold_5' as cross_validator, resampler, model, scorer, 'original_data' as tag, fold, positives, cases,
 case when model='ThresholdScreen' then fp else -1 end as rule_fp, case when model='ThresholdScreen' then positives else -1 end as rule_tp
 from (select fold, sum(label)::bigint as positives, count(*) as cases, count(*) filter (where label=0 and tsh>=150) as fp from s group by fold)
 cross join (select unnest(['none','RandomUnderSampler']) as resampler) cross join (select unnest(['DecisionTree','LinearSVC','ThresholdScreen']) as model)
 cross join (select unnest(['recall_score','fp_fn']) as scorer)""",
    ),
    "grid_catalogue": (
        grid_catalogue,
        with_ctes(S)
        + f"""select model, 'none' as resampler, 'StratifiedKFold_5' as cross_validator, 'recall_score' as scorer, 'original_data' as tag, fold, '{{"layer": 0}}' as metadata, 5::bigint as records, {COUNTS_SQL}
 from (select model, fold, label as actual, (tsh>=cut)::int as predicted from s cross join {_RULES_SQL}) group by model, fold""",
    ),
    "grid_vote": (
        grid_vote,
        with_ctes(S)
        + """, v as (select case_index, label as actual, tsh>=120 as a, tsh>=150 as b from s), pos as (select count(*) filter (where actual=1) as n from v),
 sub as (select 1 as subset, count(*) filter (where b and actual=1) as tp, count(*) filter (where b and actual=0) as fp from v
  union all select 2, count(*) filter (where a and actual=1), count(*) filter (where a and actual=0) from v
  union all select 3, count(*) filter (where a and b and actual=1), count(*) filter (where a and b and actual=0) from v)
 select subset::int as subset, bit_count(subset)::int as model_count, tp, fp, n-tp as fn from sub cross join pos""",
    ),
    "grid_features": (
        grid_features,
        with_ctes(S)
        + """select 'ratios' as choice, case_index, feature, x from (
  select case_index, 'tsh' as feature, tsh as x from s union all select case_index, 'f_k', f_k from s
  union all select case_index, 'tsh/f_k', tsh*(case when f_k=0 then 0 else 1/f_k end) from s union all select case_index, 'f_k/tsh', f_k*(case when tsh=0 then 0 else 1/tsh end) from s)
 union all """
        + " union all ".join(f"select 'powers', case_index, '{f}', {f}*{f} from s" for f in FEATURES),
    ),
    "grid_two_choices": (
        grid_two_choices,
        with_ctes(S)
        + f"""select model, fold, {COUNTS_SQL} from (select 'ThresholdScreen' as model, fold, label as actual, (tsh>=150)::int as predicted from s
 union all select 'ThresholdScreen(hour)', fold, label, (f_hour>=12)::int from s) group by model, fold""",
    ),
    "train_eval_fold": (train_eval_fold, with_ctes(S, FLOOR) + f"select case_index, fold, label as actual, true as valid, {_MARK} from s where fold=2 and tsh>=20"),
    "hyperparameter_search": (hyperparameter_search, with_ctes(S, FLOOR) + f"select sum(label)::bigint as positives, count(*) as cases, true as valid, {_MARK} from s where fold=0"),
    "custom_scorers": (
        custom_scorers,
        SP
        + f""", c as (select combination_id, count(*) filter (where actual=1 and predicted=1) as tp, count(*) filter (where actual=0 and predicted=1) as fp,
 count(*) filter (where actual=1 and predicted=0) as fn, count(*) filter (where actual=0 and predicted=0) as tn from p group by 1)
 select combination_id, round(1.0/(greatest({_RATE.format(n='fp', d='fp+tn')},1e-8)+greatest({_RATE.format(n='fn', d='tp+fn')},1e-8)),9) as fp_fn,
 round({_RATE.format(n='tp', d='tp+fn')},9) as recall_score, round({_fb(1)},9) as f1_score_pos, round({_fb(2)},9) as f2_score_pos, round({_fb(4)},9) as f4_score_pos,
 round({_fb(10)},9) as f10_score_pos, round({_fb(1, 'tn', 'fn', 'fp')},9) as f1_score_neg, round(({_fb(1)}+{_fb(1, 'tn', 'fn', 'fp')})/2,9) as f1_score_macro,
 round({_RATE.format(n='(tp+tn)', d='tp+fp+fn+tn')},9) as accuracy from c""",
    ),
    "layered_filter_hard": (
        layered_filter_hard,
        SP + "select case_index, fold, tsh, label from s where case_index in (select case_index from p where combination_id=3 and predicted=1)",
    ),
    "layered_filter_percentile": (
        layered_filter_percentile,
        SP
        + """, j as (select case_index, case when s.fold=0 then 'test' else 'train' end as side, s.fold, tsh, label, proba from s join p using(case_index) where combination_id=3),
 c as (select side, greatest(quantile_cont(proba,0.95),0.5::double) as cut from j group by side)
 select case_index, side, fold, tsh, label, round(cut,9) as cut from j join c using(side) where proba>cut""",
    ),
    "layered_two_stage": (layered_two_stage, with_ctes(S) + "select case_index, fold, label as actual, true as valid from s"),
    "threshold_baseline_run": (
        threshold_baseline_run,
        with_ctes(S)
        + f"""select 'baseline_ge_'||cutoff::varchar as tag, fold, true_positives, false_positives,
 case when true_positives+false_negatives<>0 then false_negatives::double/(true_positives+false_negatives) else 0 end as fnr,
 case when true_positives+false_positives<>0 then true_positives::double/(true_positives+false_positives) else 0 end as ppv from (
 select fold, cutoff, {COUNTS_SQL} from (select fold, cutoff, label as actual, (tsh>=cutoff)::int as predicted from s cross join {_CUTS}) group by all)""",
    ),
    "combination_analytics": (
        combination_analytics,
        SPMA
        + """, b as (select tag, combination_id from (select tag, combination_id, avg(fnr) as fnr, avg(ppv) as ppv from a
  where regexp_matches(tag,'^(original_data|all_features)$') group by all) where fnr<=0.1
 qualify row_number() over (partition by tag order by ppv desc, combination_id)<=10)
 select tag, combination_id, fold, case_index, actual, proba from p join b using(combination_id)""",
    ),
    "feature_importance": (feature_importance, "select 1.0::double as total_1, 1.0::double as total_2, 4::bigint as features"),
    "shapley_values": (shapley_values, with_ctes(S, FLOOR) + _LONG.format(columns="case_index, 1::int as model_id", where="fold=0")),
    "case_explanations": (case_explanations, with_ctes(S, FLOOR) + _LONG.format(columns="case_index, episode, fold, label", where="fold=0 and label=1")),
    "shap_group_features": (
        shap_group_features,
        SPHI
        + """select case_index, model_id, f as feature, round(sum(v),6) as value, round(sum(phi),6) as phi from (
 select *, case when feature in ('f_k','f_hour') then 'pair' else feature end as f, case when feature='f_k' then 0 when feature='f_hour' then value else value end as v from phi) group by 1,2,3""",
    ),
    "shap_drop_feature": (shap_drop_feature, SPHI + "select * from phi where feature<>'tsh'"),
    "shap_sum_features": (
        shap_sum_features,
        SPHI
        + "select case_index, model_id, case when feature in ('f_k','f_hour') then 'both' else feature end as feature, round(sum(value),6) as value, round(sum(phi),6) as phi from phi group by 1,2,3",
    ),
    "shap_rank": (
        shap_rank,
        SPHI + "select model_id, feature, round(avg(abs(phi)),7) as mean_abs from phi group by 1,2 order by avg(abs(phi)) desc, model_id, feature limit 5",
    ),
    "shap_impact": (
        shap_impact,
        SPHI
        + """, cut as (select model_id, feature, quantile_cont(abs(phi),0.8) as cut from phi group by all)
 select feature, round(sum(abs(phi)),6) as impact from phi join cut using(model_id, feature) where abs(phi)>cut group by feature""",
    ),
}
