"""Queries over ensemble voting."""

from pyspark.sql import functions as F

from raresight.operators import ensemble

from .fixtures import AND_SQL, GRID_SQL, MEMBERS, SP, SP10, VOTE_SQL, predictions


def votes(spark, sf):
    return predictions(spark, sf, len(MEMBERS))


def complete_combinations(spark, sf):
    """One combination loses a case and drops out."""
    p = predictions(spark, sf)
    holed = p.where(~((F.col("combination_id") == 5) & (F.col("case_index") == 17)))
    return ensemble.complete_combinations(holed)


def ensemble_and(spark, sf):
    return ensemble.and_subsets(votes(spark, sf), MEMBERS).drop("members")


def ensemble_vote(spark, sf):
    v = ensemble.vote_subsets(votes(spark, sf), MEMBERS)
    return v.drop("members").withColumn("threshold", F.round("threshold", 6))


def vote_threshold_search(spark, sf):
    out = ensemble.threshold_search(predictions(spark, sf), ["combination_id"])
    return out.withColumn("threshold", F.round("threshold", 6))


def agreement_matrix(spark, sf):
    a = ensemble.agreement(predictions(spark, sf), exclude=[8], truth=6)
    return a.select("combination_id", "case_index", "proba", F.round("agreement", 9).alias("agreement"), "true_positive")


def best_per_size(spark, sf):
    p = votes(spark, sf)
    a = ensemble.max_by_size(ensemble.and_subsets(p, MEMBERS), ["ppv", "fnr"]).withColumn("vote", F.lit("unanimous"))
    v = ensemble.max_by_size(ensemble.vote_subsets(p, MEMBERS), ["ppv", "fnr"]).withColumn("vote", F.lit("probability"))
    return a.unionByName(v)


def best_subset_per_size(spark, sf):
    out = ensemble.best_rows_by_size(ensemble.and_subsets(votes(spark, sf), MEMBERS))
    return out.select("model_count", "subset", "ppv", "fnr", "tp", "fp")


QUERIES = {
    "complete_combinations": (
        complete_combinations,
        SP
        + """select combination_id, count(*) as rows from p where not (combination_id=5 and case_index=17) group by 1 having count(*)=(select count(distinct case_index) from p)""",
    ),
    "ensemble_and": (ensemble_and, SP10 + AND_SQL + "select * from ands"),
    "ensemble_vote": (
        ensemble_vote,
        SP10 + VOTE_SQL + "select subset, model_count, tp, fp, fn, ppv, fnr, round(threshold,6) as threshold from votes",
    ),
    "vote_threshold_search": (
        vote_threshold_search,
        SP
        + f"select combination_id, round(coalesce(list_max(list_filter({GRID_SQL}, lambda t: t<=min(proba) filter (where actual=1))), 0.49),6) as threshold from p group by 1",
    ),
    "agreement_matrix": (
        agreement_matrix,
        SP
        + """, k as (select * from p where predicted=1 and combination_id<>8), t as (select case_index, sum(proba) as total from k group by 1)
 select combination_id, case_index, proba, round(total/(select max(total) from t)/2+0.5,9) as agreement,
 (case_index in (select case_index from k where combination_id=6 and actual=1))::int as true_positive from k join t using(case_index)""",
    ),
    "best_per_size": (
        best_per_size,
        SP10
        + AND_SQL
        + VOTE_SQL.replace("sub as (select unnest(range(1,1024))::int as subset),\n", "")
        + """select 'unanimous' as vote, model_count, max(ppv) as ppv, max(fnr) as fnr from ands group by model_count
 union all select 'probability', model_count, max(ppv), max(fnr) from votes group by model_count""",
    ),
    "best_subset_per_size": (
        best_subset_per_size,
        SP10
        + AND_SQL
        + "select model_count, subset, ppv, fnr, tp, fp from ands qualify row_number() over (partition by model_count order by ppv desc, fnr, subset)=1",
    ),
}
