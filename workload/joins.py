"""Queries over joins."""

from pyspark.sql import functions as F

from raresight.functions.metrics import confusion_counts
from raresight.operators import joins
from raresight.operators.neighbors import knn_join
from raresight.operators.sweep import CUTOFFS, threshold_counts
from raresight.sources import catalog

from .fixtures import (
    A, COUNTS_SQL, E, K, O, P, S, SP, SPMA, W, analysis, dirty, outcomes, predictions, records, screening, vectors, with_ctes,
)

# each minority row and its neighbours inside the minority
KNN_SQL = """select query, neighbor, rank, dist from (select q.case_index as query, r.case_index as neighbor,
 list_distance(q.features, r.features) as dist,
 row_number() over (partition by q.case_index order by list_distance(q.features, r.features), r.case_index)::int as rank
 from e q join e r on q.case_index<>r.case_index and r.label=1 where q.label=1) where rank<=5"""


def j1(spark, sf):
    w = dirty(spark, sf).select("Episode", "TSH_I (RAW)")
    return joins.left_outcomes(w, outcomes(spark, sf), "Episode")


def j2(spark, sf):
    cond = catalog.metadata_filter(model="Forest|SVC", tag="^(original_data|all_features)$")
    out = catalog.star_join(catalog.star_tables(records(spark, sf)), cond)
    return out.select(
        "record_id", "combination_id", "model", "resampler", "scorer", "tag", "fold", "true_positives", "false_positives",
        "false_negatives", "true_negatives", "result_file", "model_file",
    )


def j3(spark, sf):
    a = analysis(spark, sf).where("tag = 'original_data'").select("combination_id", "fold", "tag", "model", "fnr", "ppv")
    return joins.with_metadata(predictions(spark, sf), a)


def _fn_summary(spark, sf):
    p = predictions(spark, sf).where("actual = 1 and predicted = 0")
    return p.groupBy("case_index").agg(F.count(F.lit(1)).alias("count"))


def j4(spark, sf):
    s = screening(spark, sf).select("case_index", "episode", "tsh", "label")
    return joins.checked_inner(_fn_summary(spark, sf), s, "case_index")


def j5(spark, sf):
    p = predictions(spark, sf).where("combination_id = 3")
    return joins.left_features(p, screening(spark, sf).where("tsh > 20").select("case_index", "fold", "tsh")).select(
        "case_index", "fold_x", F.col("fold_y").cast("double").alias("fold_y"), "proba", "tsh"
    )


def j6(spark, sf):
    s = screening(spark, sf).select(F.col("case_index").alias("row_index"), "tsh", "f_k")
    p = predictions(spark, sf).where("combination_id = 2")
    return s.join(p, s.row_index == p.case_index).select("case_index", "tsh", "f_k", "predicted", "actual")


def j7(spark, sf):
    return screening(spark, sf).join(_fn_summary(spark, sf).select("case_index"), "case_index", "left_semi").select("case_index", "tsh", "label")


def j8(spark, sf):
    return screening(spark, sf).join(_fn_summary(spark, sf).select("case_index"), "case_index", "left_anti").select("case_index", "tsh", "label")


def j9(spark, sf):
    a = analysis(spark, sf).where("tag = 'original_data'")
    return a.groupBy("combination_id").agg(
        F.round(F.avg("fnr"), 9).alias("fnr_mean"),
        F.round(F.stddev_samp("fnr"), 9).alias("fnr_std"),
        F.round(F.avg("ppv"), 9).alias("ppv_mean"),
        F.round(F.stddev_samp("ppv"), 9).alias("ppv_std"),
    )


def j10(spark, sf):
    """Records of the combination found by name: a scalar subquery."""
    a = analysis(spark, sf)
    wanted = a.where("model = 'LinearSVC' and resampler = 'none'").agg(F.max("combination_id")).scalar()
    return a.where(F.col("combination_id") == wanted).select("combination_id", "tag", "fold", "fnr", "ppv")


def j11(spark, sf):
    return threshold_counts(screening(spark, sf), "tsh", "label")


def j12(spark, sf):
    """Plan rows per fold with the train and test sizes they will see."""
    s = screening(spark, sf)
    folds = s.groupBy("fold").agg(F.count(F.lit(1)).alias("test_rows"), F.sum("label").cast("bigint").alias("test_positives"))
    return joins.grid(
        folds,
        cross_validator=["StratifiedKFold_5"],
        model=["RandomForest", "GradientBoosting", "LinearSVC"],
        resampler=["none", "SMOTE", "NearMiss"],
        scorer=["recall_score", "f1_score_pos", "f10_score_pos", "fp_fn"],
    )


def j13(spark, sf):
    e = vectors(spark, sf)
    m = e.where("label = 1")
    return knn_join(m, m, 5).select("query", "neighbor", "rank", F.round("dist", 6).alias("dist"))


def j14(spark, sf):
    out = joins.aligned_sum(predictions(spark, sf), [2, 4, 7])
    return out.select("case_index", F.round("votes", 9).alias("votes"))


CUTS_SQL = "(select unnest([" + ",".join(f"{c}::double" for c in CUTOFFS) + "]) as cutoff)"
SWEEP_SQL = f"""select cutoff, {COUNTS_SQL} from (select cutoff, label as actual, (tsh>=cutoff)::int as predicted, fold
 from s cross join {CUTS_SQL}) group by cutoff"""

QUERIES = {
    "J1_left_equi": (
        j1,
        with_ctes(W, O) + 'select w."Episode", w."TSH_I (RAW)", o."Definitive Diagnosis" from w left join o using("Episode")',
    ),
    "J2_star_inner": (
        j2,
        SPMA
        + """select record_id, combination_id, model, resampler, scorer, tag, fold, true_positives, false_positives, false_negatives, true_negatives,
 'results_'||record_id as result_file, 'model_'||record_id as model_file from a
 where regexp_matches(model,'Forest|SVC') and regexp_matches(tag,'^(original_data|all_features)$')""",
    ),
    "J3_results_metadata": (
        j3,
        SPMA
        + "select p.*, a.tag, a.model, a.fnr, a.ppv from p join a using(combination_id, fold) where a.tag='original_data'",
    ),
    "J4_index_inner_checked": (
        j4,
        SP
        + """select case_index, count(*) as count, any_value(episode) as episode, any_value(tsh) as tsh, any_value(label) as label
 from p join s using(case_index) where actual=1 and predicted=0 group by case_index""",
    ),
    "J5_index_left": (
        j5,
        SP
        + """select p.case_index, p.fold as fold_x, f.fold::double as fold_y, proba, f.tsh from p left join (select * from s where tsh>20) f using(case_index)
 where combination_id=3""",
    ),
    "J6_index_to_column": (
        j6,
        SP + "select case_index, tsh, f_k, predicted, actual from s join p using(case_index) where combination_id=2",
    ),
    "J7_semi": (
        j7,
        SP + "select case_index, tsh, label from s where case_index in (select case_index from p where actual=1 and predicted=0)",
    ),
    "J8_anti": (
        j8,
        SP + "select case_index, tsh, label from s where case_index not in (select case_index from p where actual=1 and predicted=0)",
    ),
    "J9_mean_std_join": (
        j9,
        SPMA
        + """select combination_id, round(m.fnr,9) as fnr_mean, round(sd.fnr,9) as fnr_std, round(m.ppv,9) as ppv_mean, round(sd.ppv,9) as ppv_std from
 (select combination_id, avg(fnr) as fnr, avg(ppv) as ppv from a where tag='original_data' group by 1) m join
 (select combination_id, stddev_samp(fnr) as fnr, stddev_samp(ppv) as ppv from a where tag='original_data' group by 1) sd using(combination_id)""",
    ),
    "J10_scalar_lookup": (
        j10,
        SPMA
        + """select combination_id, tag, fold, fnr, ppv from a where combination_id=(select max(combination_id) from a where model='LinearSVC' and resampler='none')""",
    ),
    "J11_theta_cutoffs": (j11, with_ctes(S) + SWEEP_SQL),
    "J12_grid_cross": (
        j12,
        with_ctes(S)
        + """select * from (select fold, count(*) as test_rows, sum(label)::bigint as test_positives from s group by fold)
 cross join (values ('StratifiedKFold_5')) a(cross_validator)
 cross join (values ('RandomForest'),('GradientBoosting'),('LinearSVC')) b(model)
 cross join (values ('none'),('SMOTE'),('NearMiss')) c(resampler)
 cross join (values ('recall_score'),('f1_score_pos'),('f10_score_pos'),('fp_fn')) d(scorer)""",
    ),
    "J13_knn_join": (j13, with_ctes(E) + f"select query, neighbor, rank, round(dist,6) as dist from ({KNN_SQL})"),
    "J14_aligned_add": (
        j14,
        SP + "select case_index, round(sum(proba),9) as votes from p where combination_id in (2,4,7) group by case_index",
    ),
}
