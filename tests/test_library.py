"""Golden vectors, invariants and edge sets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raresight.functions import numeric as num
from raresight.functions.metrics import classification_metrics
from raresight.functions.text import splitter_name
from raresight.operators import clean, curves, ensemble, features as fe, models, profile, resample as rs
from raresight.operators.explain import sampled_shapley, shapley_values
from raresight.operators.sweep import CUTOFFS, threshold_counts
from raresight.plans import experiment
from raresight.session import scratch_path
from raresight.sources import catalog, model_store, tables
from workload.fixtures import FEATURES, predictions, screening
from workload.resampling import as_rows

GOLDEN = [(1, 1, 3), (4, 5, 6), (7, 8, 9)]


def test_ratio_vector(spark):
    out = fe.create_ratios(spark.createDataFrame(GOLDEN, "a int, b int, c int"))
    assert out.columns == ["a", "a/b", "a/c", "b/a", "b", "b/c", "c/a", "c/b", "c"]
    want = [[x if i == j else x / y for i, x in enumerate(r) for j, y in enumerate(r)] for r in GOLDEN]
    assert np.allclose(out.toPandas().to_numpy(), want)
    flat = fe.ratio_array(spark.createDataFrame(GOLDEN, "a int, b int, c int"), ["a", "b", "c"]).toPandas().ratios
    assert np.allclose(np.stack(flat), want)


def test_power_vectors(spark):
    df = spark.createDataFrame(GOLDEN, "a int, b int, c int")
    for p in (2, 3):
        out = fe.create_powers(df, p, ["a", "b", "c"])
        assert [tuple(r) for r in out.collect()] == [tuple(x**p for x in r) for r in GOLDEN]
        assert set(dict(out.dtypes).values()) == {"int"}


def test_power_set_order():
    assert ["x".join(s) for s in fe.power_set(["a", "b", "c"]) if len(s) > 1] == ["cxb", "cxa", "bxa", "cxbxa"]


def test_small_facts():
    assert len(CUTOFFS) == 151 and CUTOFFS[0] == 10.0 and CUTOFFS[-1] == 25.0
    assert splitter_name("RepeatedStratifiedKFold", 5, 2) == "RepeatedStratifiedKFold_2x5" and splitter_name(None) == "none"
    assert len(clean.COLUMN_NAMES) == 60


def test_division_edges(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0), (None, 0.0)], "a double, b double")
    got = [r[0] for r in df.select(num.fdiv(F.col("a"), F.col("b"))).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == 1.5 and got[4] is None
    fin = [r[0] for r in df.select(num.finite32(num.fdiv(F.col("a"), F.col("b")))).collect()]
    assert fin == [num.FLOAT32_MAX, num.FLOAT32_MAX, 0.0, 1.5, 0.0]


def test_uniform_is_uniform(spark):
    u = spark.range(4000).select(num.uniform("t", F.col("id")).alias("u"), num.normal("t", F.col("id")).alias("z")).toPandas()
    assert u.u.between(0, 1, inclusive="left").all() and abs(u.u.mean() - 0.5) < 0.02
    assert abs(u.z.mean()) < 0.06 and abs(u.z.std() - 1) < 0.05


def test_rules_are_prefix_and_first_match(spark):
    df = spark.createDataFrame([("-12.5",), ("1e2",), ("5.",), ("abc",), ("Not Tested",), (None,), ("inf",)], "x string")
    got = [r[0] for r in df.select(clean.rule_column(F.col("x"), clean.DEFAULT_RULES)).collect()]
    assert got == [12.5, 100.0, None, None, None, None, None]
    sex = spark.createDataFrame([("Male",), ("Female",), ("F",), ("Ambiguous",), ("Unknown",)], "sex string")
    codes = [r[0] for r in sex.select(clean.rule_column(F.col("sex"), clean.RULES["sex"], "int")).collect()]
    assert codes == [1, 0, 1, 2, 3]


def test_narrowing(spark):
    df = spark.createDataFrame([(1.0, 1.5, 2.0), (2.0, 2.0, None)], "a double, b double, c double")
    assert dict(clean.narrow_integers(df).dtypes) == {"a": "bigint", "b": "double", "c": "double"}


@pytest.mark.parametrize("rows", [[], [(1, 1, 0.9)], [(0, 0, 0.1), (0, 1, 0.8)], [(1, 0, 0.2), (1, 1, 0.2)]])
def test_metric_edges(spark, rows):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "g int, case_index bigint, actual int, predicted int, proba double")
    m = classification_metrics(df, ["g"]).toPandas()
    assert len(m) == (1 if rows else 0)
    if rows:
        assert m.notna().all().all()
    assert curves.roc_points(df, ["g"]).count() >= 0
    assert curves.auc(df, ["g"]).count() == len(m)


def test_no_positive_and_all_null(spark):
    df = spark.createDataFrame([(i, float(i), 0) for i in range(9)], "case_index bigint, x double, label int")
    t = threshold_counts(df, "x", "label").toPandas()
    assert len(t) == 151 and (t.true_positives == 0).all()
    nulls = spark.createDataFrame([(None,), (None,)], "x double")
    d = profile.describe(nulls, ["x"]).toPandas()
    assert d["count"][0] == 0
    assert profile.histogram(nulls, "x", 5).count() == 0


def test_threshold_counts_equal_comparison(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.uniform(5, 30, 500), CUTOFFS, np.nextafter(CUTOFFS, 0), np.nextafter(CUTOFFS, 99)])
    y = rng.integers(0, 2, len(x))
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, label int")
    got = threshold_counts(df, "x", "label").toPandas().sort_values("cutoff")
    assert got.true_positives.tolist() == [int(((x >= c) & (y == 1)).sum()) for c in CUTOFFS]
    assert got.false_positives.tolist() == [int(((x >= c) & (y == 0)).sum()) for c in CUTOFFS]


def test_threshold_search_equals_the_stepwise_search(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g in range(60):
        v, a = rng.uniform(0.3, 1.0, 12).round(3), rng.integers(0, 2, 12)
        rows += [(g, int(b), float(s)) for s, b in zip(v, a)]
        t = 0.49
        while a.sum() and (v[a == 1] >= t + 0.01).all() and (v >= t + 0.01).any():
            t += 0.01
        want[g] = t
    df = spark.createDataFrame(rows, "g int, actual int, proba double")
    got = {r["g"]: r["threshold"] for r in ensemble.threshold_search(df, ["g"]).collect()}
    assert got == want


def test_roc_keeps_area(spark, sf):
    p = predictions(spark, sf)
    full = curves.roc_points(p, ["combination_id"], drop_collinear=False, rows_per_bucket=50).toPandas()
    thin = curves.roc_points(p, ["combination_id"], rows_per_bucket=50).toPandas()
    areas = {r["combination_id"]: r["auc"] for r in curves.auc(p, ["combination_id"], rows_per_bucket=50).collect()}
    for c, want in areas.items():
        for pts in (full, thin):
            one = pts[pts.combination_id == c].sort_values(["fpr", "tpr"])
            assert abs(np.trapezoid(one.tpr, one.fpr) - want) < 1e-9
    assert len(thin) < len(full)


@pytest.fixture(scope="module")
def train(spark, sf):
    return as_rows(screening(spark, sf)).cache()


@pytest.mark.parametrize("name", ["SMOTE", "BorderlineSMOTE", "RandomOverSampler", "RandomUnderSampler", "NearMiss"])
def test_ratio_after_resampling(train, name):
    out = rs.resample(train, name, 0.1, 4).toPandas()
    rate = (out.label == 1).sum() / (out.label == 0).sum()
    assert 0.08 <= rate <= 0.12
    assert out.case_index.is_unique


def test_smote_points_lie_on_segments(train):
    out = rs.smote(train, 0.1).toPandas()
    base = {r.case_index: np.array(r.features) for r in out[out.case_index >= 0].itertuples()}
    minority = np.stack([base[i] for i in out[(out.case_index >= 0) & (out.label == 1)].case_index])
    for r in out[out.case_index < 0].itertuples():
        a, x = base[r.source], np.array(r.features)
        ends = minority - a
        along = [np.allclose(np.cross(np.r_[e[:2], 0], np.r_[(x - a)[:2], 0]), 0, atol=1e-6) for e in ends]
        assert any(along)


def test_tomek_removes_majority_only(train):
    removed = rs.tomek_majority(train)
    assert train.join(removed, "case_index", "left_semi").where("label = 1").count() == 0
    assert rs.tomek(train).where("label = 1").count() == train.where("label = 1").count()


def test_gaussian_options(train):
    n, m = train.count(), train.where("label = 1").count()
    assert rs.gaussian(train, new_points_ratio=0.0).count() == n
    assert rs.gaussian(train, 0.5, 0.1, 1.5).count() == n + math.ceil(1.5 * m)
    replaced = rs.gaussian(train, 0.5, 0.1, 1.0, replacement=False)
    assert replaced.where("label = 1 and case_index >= 0").count() == 0
    with pytest.raises(ValueError):
        rs.gaussian(train, 0.0)
    with pytest.raises(ValueError):
        rs.classes(train.where("label = 0"))


def test_draws_do_not_depend_on_partitioning(train):
    a = rs.gaussian(train, 0.5, 0.1, 2.0, seed=9).orderBy("case_index").toPandas()
    b = rs.gaussian(train.repartition(17), 0.5, 0.1, 2.0, seed=9).orderBy("case_index").toPandas()
    assert a.source.equals(b.source)
    # the standard deviation is merged in another order: last-digit changes only
    assert np.allclose(np.stack(a.features), np.stack(b.features), rtol=1e-12)


def test_test_side_is_never_resampled(spark, sf):
    df = screening(spark, sf).select("case_index", "label", "fold", F.array(*FEATURES).alias("features"))
    preds, _ = experiment.train_eval_fold(df, 1, "DecisionTree", "RandomOverSampler", 0.2, dict(maxDepth=3))
    want = {r[0] for r in df.where("fold = 1").select("case_index").collect()}
    got = [r[0] for r in preds.select("case_index").collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("variant", ["SAMME", "SAMME.R"])
def test_boosting_learns_and_survives_the_store(spark, sf, variant):
    df = screening(spark, sf).select("case_index", "label", "fold", F.array("tsh", "f_k", F.col("err").cast("double")).alias("features"))
    data = models.ml_frame(df)
    fitted = models.AdaBoost(rounds=8, maxDepth=2, variant=variant).fit(data)
    s = models.scored(fitted, data).toPandas()
    assert (s.predicted == s.label).mean() > 0.99
    root = scratch_path(spark, "m")
    model_store.save_model(spark, fitted, root, {"c": 1}, 0)
    again = models.scored(model_store.load_model(spark, root, {"c": 1}, 0), data).toPandas()
    assert np.allclose(s.sort_values("case_index").proba, again.sort_values("case_index").proba)


def test_shapley_adds_up(spark, sf):
    df = screening(spark, sf).select("case_index", "label", "fold", F.array("tsh", "f_k", F.col("err").cast("double")).alias("features"))
    model = models.make_model("RandomForest", numTrees=4, maxDepth=4).fit(models.ml_frame(df))
    rows, bg = df.where("case_index < 40"), df.where("case_index between 100 and 130")
    f_row = models.scored(model, models.ml_frame(rows)).toPandas().set_index("case_index").proba
    f_bg = models.scored(model, models.ml_frame(bg)).toPandas().proba
    phi = sampled_shapley(model, rows, bg, ["tsh", "f_k", "err"], permutations=6).toPandas()
    assert len(phi) == 40 * 3
    total = phi.groupby("case_index").phi.sum()
    # f(row) - phi is the mean score of the drawn background rows
    base = f_row - total
    assert base.between(f_bg.min() - 1e-9, f_bg.max() + 1e-9).all()
    exact = shapley_values(model, rows, bg, ["tsh", "f_k", "err"]).toPandas()
    assert len(exact) == 40 * 3 and np.allclose(exact.groupby("case_index").phi.sum(), f_row.sort_index() - f_bg.mean(), atol=1e-9)
    # the definition, coalition by coalition, for one case
    x, drawn = rows.where("case_index = 7").first()["features"], [r["features"] for r in bg.select("features").collect()]
    masked = [(m * 1000 + i, 0, [x[j] if m >> j & 1 else b[j] for j in range(3)]) for m in range(8) for i, b in enumerate(drawn)]
    data = spark.createDataFrame(masked, "case_index long, label int, features array<double>")
    s = models.scored(model, models.ml_frame(data)).toPandas()
    v = s.groupby(s.case_index // 1000).proba.mean()
    order = list(itertools.permutations(range(3)))
    for j, name in enumerate(["tsh", "f_k", "err"]):
        before = [sum(1 << k for k in o[: o.index(j)]) for o in order]
        want = np.mean([v[m | 1 << j] - v[m] for m in before])
        got = exact[(exact.case_index == 7) & (exact.feature == name)].phi.iloc[0]
        assert abs(got - want) < 1e-9


def test_importances_sum_to_one(spark, sf):
    df = models.ml_frame(screening(spark, sf).select("case_index", "label", F.array(*FEATURES).alias("features")))
    for name, kw in (("DecisionTree", dict(maxDepth=4)), ("BalancedRandomForest", dict(rounds=3, maxDepth=3))):
        imp = models.feature_importances(models.make_model(name, **kw).fit(df), FEATURES)
        assert abs(sum(imp.values()) - 1) < 1e-6
    assert models.feature_importances(models.ThresholdScreen(), FEATURES) is None


def test_rerun_replaces_only_its_cells(spark, sf):
    path = scratch_path(spark, "r")
    p = predictions(spark, sf).where("combination_id < 3")
    keyed = p.withColumns({c: F.lit("x") for c in ("cross_validator", "resampler", "scorer", "tag", "run_ts")}).withColumn(
        "model", F.col("combination_id").cast("string")
    )
    tables.save_results(keyed, path)
    n = spark.read.parquet(path).count()
    tables.save_results(keyed.where("fold = 2 and model = '1'"), path)
    assert spark.read.parquet(path).count() == n


def test_feature_sets(spark):
    sets = spark.createDataFrame([(1, '["a","b"]', 1)], "combination_id int, feature_set string, created_at int")
    assert catalog.load_feature_set(sets, 1) == ["a", "b"] and catalog.load_feature_set(sets, 9) == []
    with pytest.raises(ValueError):
        catalog.select_features(spark.range(1), ["absent"])


def test_search_settings_are_repeatable():
    a = experiment.sample_settings(models.SPACES["RandomForest"], 4, 3)
    assert a == experiment.sample_settings(models.SPACES["RandomForest"], 4, 3)
    assert all(3 <= s["maxDepth"] <= 30 and 50 <= s["numTrees"] <= 500 for s in a)


def test_class_without_misses_join_fails_loudly(spark):
    from raresight.operators.joins import checked_inner

    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="no match"):
        checked_inner(left, right, "k").collect()


def test_layers_shrink_both_sides(spark, sf):
    df = screening(spark, sf).select("case_index", "label", "fold", F.array(*FEATURES).alias("features"))
    layer = df.select(
        "case_index", (F.col("features")[0] >= 20).cast("int").alias("predicted"), (F.col("features")[0] / 300).alias("proba")
    )
    train, test = experiment.apply_layers(df.where("fold <> 1"), df.where("fold = 1"), [layer], 1)
    assert train.where(F.col("features")[0] < 20).count() == 0 and test.where(F.col("features")[0] < 20).count() == 0
    assert test.count() == df.where("fold = 1").where(F.col("features")[0] >= 20).count()
    high, _ = experiment.apply_layers(df.where("fold <> 1"), df.where("fold = 1"), [layer], 1, passthrough=0.9)
    v = df.where("fold <> 1").select((F.col("features")[0] / 300).alias("p")).toPandas().p
    assert high.count() == int((v > max(np.percentile(v, 90), 0.5)).sum())


def test_grid_without_folds_scores_every_row(spark, sf):
    df = screening(spark, sf).select("case_index", "label", F.array(*FEATURES).alias("features"))
    m = experiment.run_grid(
        df, {"DecisionTree": dict(maxDepth=2)}, {"none": 0.1}, ["accuracy"], "t", "2024-01-01_00-00-00",
        scratch_path(spark, "g"), scratch_path(spark, "gm"), cross_validators={"none": None},
    ).toPandas()
    assert m.total_predictions.tolist() == [df.count()]


def test_packed_trees_score_like_their_members(spark, sf):
    df = models.ml_frame(screening(spark, sf).select("case_index", "label", F.array(*FEATURES).alias("features")))
    trees = [models.tree_learner(numTrees=1, bootstrap=False, maxDepth=5, featureSubsetStrategy="sqrt", seed=i).fit(df) for i in range(4)]
    packed = models.PackedTrees.of(trees)
    x = np.array([r["f"] for r in df.select(models.vector_to_array("features").alias("f")).collect()])
    for i, tree in enumerate(trees):
        want = [r["prediction"] for r in tree.transform(df).select("prediction").collect()]
        assert packed.values(x)[:, i].tolist() == want
    few, many = (models.AveragedModel(models.PackedTrees.of(trees * n)) for n in (2, 125))
    plan = lambda m: m.transform(df)._jdf.queryExecution().executedPlan().toString().count("\n")
    assert len(many.trees.roots) == 500 and plan(few) == plan(many)
    a, b = (models.scored(m, df).orderBy("case_index").toPandas().proba for m in (few, many))
    assert np.allclose(a, b, rtol=1e-12)


def test_catalogue_takes_a_run_once(spark):
    root = scratch_path(spark, "cat")
    keys = [(m, "none", s, "cv", "t", f, 1, 2, 3, 4, "r", "m") for m in ("a", "b") for s in ("x", "y") for f in range(2)]
    names = "model string, resampler string, scorer string, cross_validator string, tag string, fold int, true_positives long, false_positives long, false_negatives long, true_negatives long, result_file string, model_file string"
    cells, at = spark.createDataFrame(keys, names), lambda d: F.to_timestamp_ntz(F.lit(f"2024-01-0{d} 00:00:00"))
    assert catalog.write_run(cells, root, "one", at(1)) and not catalog.write_run(cells, root, "one", at(1))
    more = cells.unionByName(cells.where("model = 'a'").withColumn("model", F.lit("c")))
    # a run that died before its marker is not seen, and is repeated over its own folders
    more.select(F.lit(1).alias("id")).write.parquet(f"{root}/record/run=two")
    assert catalog.read_catalog(spark, root)["record"].count() == 8
    assert catalog.write_run(more, root, "two", at(2))
    tables = catalog.read_catalog(spark, root)
    assert tables["combination"].count() == 6 and tables["record"].count() == 20
    star = catalog.star_join(tables)
    assert star.count() == 12 and {r[0].day for r in star.select("created_at").collect()} == {2}
    assert catalog.combination_id("a", "none", "x", "cv") in {r["id"] for r in tables["combination"].collect()}


def test_grid_members_are_taken_as_they_are(spark, sf):
    df = screening(spark, sf).select("case_index", "label", "fold", *FEATURES)
    with pytest.raises(ValueError, match="not in the table"):
        sets = spark.createDataFrame([(1, '["absent"]', 1)], "combination_id bigint, feature_set string, created_at int")
        experiment.feature_vectors(df, experiment.FeatureOptions(FEATURES, sets), 1)
    rows = df.select("case_index", "label", "fold", F.array(*FEATURES).alias("features"))
    root, key = scratch_path(spark, "m"), {"c": 1}
    for fold in range(2):
        model_store.save_model(spark, models.ThresholdScreen(0, 100.0 + 50 * fold), root, key, fold)
    stored = model_store.StoredModels(spark, root, key, [0, 1])
    m = experiment.run_grid(rows, {"kept": stored}, {"SMOTE": 0.1}, ["accuracy"], "t", "2024-01-01_00-00-00", scratch_path(spark, "g"), scratch_path(spark, "gm"), folds=[0, 1])
    got = {r["fold"]: r["true_positives"] + r["false_positives"] for r in m.collect()}
    assert got == {f: df.where(f"fold = {f} and tsh >= {100 + 50 * f}").count() for f in (0, 1)}


def test_profile_states_merge(spark):
    rows = [(i % 2, i % 5, float(i * i % 997) if i % 7 else None, float("nan")) for i in range(20_000)]
    df = spark.createDataFrame(rows, "g int, load int, x double, y double")
    states = profile.profile_state(df, ["x", "y"], ["g", "load"])
    assert states.count() == 20 and states.where("name = 'y'").agg({"n": "sum"}).first()[0] == 0
    for by, key in ((["g"], lambda r: r[0]), ([], lambda r: None)):
        for r in profile.merge_profiles(states, by).collect():
            xs = [x[2] for x in rows if x[2] is not None and (not by or key(x) == r["g"])]
            assert r["name"] == "x" and r["n"] == len(xs) and (r["low"], r["high"]) == (min(xs), max(xs)) and abs(r["mean"] - sum(xs) / len(xs)) < 1e-9
            under, upto = sum(x < r["value"] for x in xs), sum(x <= r["value"] for x in xs)
            assert under <= (r["p"] + profile.SKETCH_ERROR) * len(xs) and upto >= (r["p"] - profile.SKETCH_ERROR) * len(xs)


def test_profile_of_odd_columns(spark):
    df = spark.createDataFrame([(None, 1.0, "b", None), (None, 3.0, "a", None), ("g", None, None, None)], "by string, x double, t string, e double")
    got = {(r["by"], r["name"]): r for r in profile.profile_table(df, ["x", "t", "e"], ["by"]).collect()}
    assert len(got) == 6
    assert (got[None, "x"]["q50"], got[None, "x"]["q25"], got[None, "x"]["top_count"], got["g", "x"]["q50"]) == (2.0, 1.5, 1, None)
    assert got[None, "t"]["top_value"] == "b" and got[None, "t"]["q50"] is None and got[None, "e"]["missing"] == 2


def test_centroids_by_cell(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(1500, 3)), rng.normal(size=(300, 3)) + 8, np.tile([[5.0, 5.0, -5.0]], (900, 1))])
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)] + [(-1, None)], "case_index long, features array<double>")

    def error(centres):
        return (((x[:, None, :] - np.array(centres)[None]) ** 2).sum(2).min(1)).sum()

    made = rs.centroids_by_cell(df, 100, block_rows=200).orderBy("i").collect()
    assert [r["i"] for r in made] == list(range(100)) and sum(r["n"] for r in made) == len(x)
    single = [r["features"] for r in rs.centroids(df.where("features is not null"), 100).collect()]
    assert error([r["features"] for r in made]) <= 1.5 * error(single)
    again = rs.centroids_by_cell(df.repartition(3), 100, block_rows=200).orderBy("i").collect()
    assert np.allclose([r["features"] for r in again], [r["features"] for r in made])
    few = rs.centroids_by_cell(df.where("case_index >= 1798"), 500, block_rows=1).collect()
    assert sorted(r["n"] for r in few) == [1, 1, 900]
    assert rs.centroids_by_cell(df.limit(0), 5).count() == 0
    # blocks that no row was dealt to
    sparse = rs.centroids_by_cell(df.where("case_index < 60"), 4, cells=1, rounds=2, block_rows=2).collect()
    assert len(sparse) == 4 and sum(r["n"] for r in sparse) == 60


def test_shares_of_cells():
    assert rs._shares(10, [(0, 90, 90), (1, 9, 9), (2, 1, 1)]) == {0: 8, 1: 1, 2: 1}
    assert rs._shares(100, [(0, 50, 3), (1, 5, 5)]) == {0: 3, 1: 5}
    assert rs._shares(6, [(0, 1000, 2), (1, 10, 10)]) == {0: 2, 1: 4}
