"""Queries over sorts, limits, top-k, set operations and combinatorics."""

from pyspark.sql import Window as W, functions as F

from raresight.operators import ensemble
from raresight.operators.features import primary_weight_columns, primary_weight_rank, power_set
from raresight.plans import results

from .fixtures import (
    AND_SQL, FEATURES, MEMBERS, S, SP, SP10, SPM, SPMA, VOTE_SQL, analysis, predictions, records, screening, table, with_ctes,
)


def topk_by_ppv_per_tag(spark, sf):
    best = results.best_per_tag(analysis(spark, sf), fnr_cutoff=0.05, top=10)
    return results.rows_of(predictions(spark, sf), best).select("tag", "combination_id", "fold", "case_index", "proba")


def topk_zero_fnr(spark, sf):
    return results.top_zero_fnr(analysis(spark, sf), 10).select("tag", "combination_id", F.round("ppv", 9).alias("ppv"))


def topk_zero_fnr_folds(spark, sf):
    return results.top_zero_fnr_folds(analysis(spark, sf), 10).select("combination_id", F.round("ppv", 9).alias("ppv"))


def sort_fnr_then_ppv(spark, sf):
    return results.leaderboard(analysis(spark, sf), "original_data")


def topk_features(spark, sf):
    r = primary_weight_rank(screening(spark, sf), FEATURES, "label")
    return r.where("weight > 0").orderBy(F.col("weight").desc(), "population", "name").limit(5).select("population", "name", F.round("weight", 9).alias("weight"))


def top100_votes(spark, sf):
    v = ensemble.vote_subsets(predictions(spark, sf, len(MEMBERS)), MEMBERS)
    return v.orderBy(F.col("ppv").desc(), "subset").limit(100).select("subset", "model_count", F.round("ppv", 9).alias("ppv"))


def sort_multi(spark, sf):
    a = ensemble.and_subsets(predictions(spark, sf, len(MEMBERS)), MEMBERS)
    return a.orderBy(F.col("ppv").desc(), "model_count", "fnr", "subset").select("subset", "model_count", "ppv", "fnr")


def sort_newest(spark, sf):
    m = records(spark, sf)
    return m.orderBy(F.col("created_at").desc(), "record_id").select("record_id", "tag", "fold", "created_at")


def order_cases_by_agreement(spark, sf):
    o = ensemble.order_cases(predictions(spark, sf)).withColumn("total", F.round("total", 9))
    return o.select("case_index", "total", "rank")


def order_combinations_by_gaps(spark, sf):
    return ensemble.order_combinations(predictions(spark, sf))


def fn_rank_cases(spark, sf):
    p = predictions(spark, sf).where("actual = 1 and predicted = 0")
    return p.groupBy("case_index").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "case_index")


def union_all(spark, sf):
    """Rows of different tables under one schema, repeated rows kept."""
    s = screening(spark, sf)
    orders, parts = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    rows = [
        s.select("case_index", F.lit("screening").alias("origin"), F.col("tsh").alias("value")),
        predictions(spark, sf).select(F.col("proba").alias("value"), "case_index", F.lit("scores").alias("origin")),
        orders.select(F.col("o_orderkey").alias("case_index"), F.lit("orders").alias("origin"), F.col("o_totalprice").cast("double").alias("value")),
        parts.select(F.col("l_orderkey").alias("case_index"), F.lit("lines").alias("origin"), F.col("l_discount").cast("double").alias("value")),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def concat_columns(spark, sf):
    s = screening(spark, sf)
    return s.select("tsh", "f_k", "episode", F.col("label").alias("definitive_diagnosis"))


def distinct_values(spark, sf):
    return analysis(spark, sf).select("tag", "scorer", "resampler", "fold").distinct()


def union_distinct_cases(spark, sf):
    return predictions(spark, sf).where("predicted = 1").select("case_index").distinct()


def except_keys(spark, sf):
    s = screening(spark, sf)
    missed = predictions(spark, sf).where("actual = 1 and predicted = 0").select("case_index")
    return s.join(missed, "case_index", "left_anti").drop("f_user", "f_hour")


def subset_check(spark, sf):
    """Per combination: is its stored feature list available?"""
    have = screening(spark, sf).columns
    m = records(spark, sf).select("combination_id").distinct()
    need = F.when(F.col("combination_id") % 2 == 0, F.array(F.lit("tsh"), F.lit("f_k"))).otherwise(F.array(F.lit("tsh"), F.lit("absent")))
    missing = F.array_except(need, F.array(*[F.lit(c) for c in have]))
    return m.select("combination_id", (F.size(missing) == 0).alias("available"))


def power_set_products(spark, sf):
    """Products of every subset of three features over the whole table."""
    cols = primary_weight_columns(["tsh", "f_k", "f_hour"], [])
    assert ["x".join(x) for x in power_set(["tsh", "f_k", "f_hour"]) if len(x) > 1] == list(cols)
    return screening(spark, sf).select("case_index", *[c.alias(n) for n, c in cols.items()])


def model_subsets(spark, sf):
    """Every subset of the combinations with the cases all members flag."""
    a = ensemble.and_subsets(predictions(spark, sf, len(MEMBERS)), MEMBERS)
    return a.select("subset", "members", "model_count", "tp", "fp")


_MEMBERS = "list_aggregate(list_transform(list_filter(range(10), lambda i: (subset>>i)&1=1), lambda i: (i+1)::varchar),'string_agg',',') as members"

QUERIES = {
    "topk_by_ppv_per_tag": (
        topk_by_ppv_per_tag,
        SPMA
        + """, b as (select tag, combination_id from (select tag, combination_id, avg(fnr) as fnr, avg(ppv) as ppv from a group by all) where fnr<=0.05
 qualify row_number() over (partition by tag order by ppv desc, combination_id)<=10)
 select tag, combination_id, fold, case_index, proba from p join b using(combination_id)""",
    ),
    "topk_zero_fnr": (
        topk_zero_fnr,
        SPMA
        + "select tag, combination_id, round(ppv,9) as ppv from (select tag, combination_id, avg(fnr) as fnr, avg(ppv) as ppv from a group by all) where fnr=0 order by ppv desc, tag, combination_id limit 10",
    ),
    "topk_zero_fnr_folds": (
        topk_zero_fnr_folds,
        SPMA + "select combination_id, round(avg(ppv),9) as ppv from a where fnr=0 group by 1 order by avg(ppv) desc, combination_id limit 10",
    ),
    "sort_fnr_then_ppv": (
        sort_fnr_then_ppv,
        SPMA
        + """select model, scorer, resampler, combination_id, round(fnr,3) as fnr, round(ppv,3) as ppv, round(f1,3) as f1 from (
 select model, scorer, resampler, combination_id, avg(fnr) as fnr, avg(ppv) as ppv, avg(f1) as f1 from a where tag='original_data' group by all) order by fnr, ppv desc, combination_id limit 20""",
    ),
    "topk_features": (
        topk_features,
        with_ctes(S)
        + ", md as ("
        + " union all ".join(
            f"select '{pop}' as population, '{f}' as name, quantile_cont({f},0.5) as value from s {cond}"
            for pop, cond in (("all", ""), ("positive", "where label=1"), ("negative", "where label=0"))
            for f in FEATURES
        )
        + """) select population, name, round(w,9) as weight from (select c.population, c.name, case when o.value<>0 then abs((c.value-o.value)/o.value) when c.value<>0 then 'inf'::double end as w
 from md c join md o on o.population='all' and o.name=c.name where c.population<>'all') where w>0 order by w desc, population, name limit 5""",
    ),
    "top100_votes": (
        top100_votes,
        SP10 + VOTE_SQL + "select subset, model_count, round(ppv,9) as ppv from votes order by votes.ppv desc, subset limit 100",
    ),
    "sort_multi": (sort_multi, SP10 + AND_SQL + "select subset, model_count, ppv, fnr from ands order by ppv desc, model_count, fnr, subset"),
    "sort_newest": (sort_newest, SPM + "select record_id, tag, fold, created_at from m order by created_at desc, record_id"),
    "order_cases_by_agreement": (
        order_cases_by_agreement,
        SP
        + "select case_index, round(total,9) as total, row_number() over (order by total desc, case_index)-1 as rank from (select case_index, sum(proba) as total from p where predicted=1 group by 1)",
    ),
    "order_combinations_by_gaps": (
        order_combinations_by_gaps,
        SP
        + "select combination_id, (select count(distinct case_index) from p where predicted=1)-count(distinct case_index) as null_count from p where predicted=1 group by 1",
    ),
    "fn_rank_cases": (fn_rank_cases, SP + "select case_index, count(*) as count from p where actual=1 and predicted=0 group by 1 order by 2 desc, 1"),
    "union_all": (
        union_all,
        SP
        + """select case_index, 'screening' as origin, tsh as value from s union all select case_index, 'scores', proba from p
 union all select o_orderkey, 'orders', o_totalprice::double from orders union all select l_orderkey, 'lines', l_discount::double from lineitem""",
    ),
    "concat_columns": (concat_columns, with_ctes(S) + "select tsh, f_k, episode, label as definitive_diagnosis from s"),
    "distinct_values": (distinct_values, SPMA + "select distinct tag, scorer, resampler, fold from a"),
    "union_distinct_cases": (union_distinct_cases, SP + "select distinct case_index from p where predicted=1"),
    "except_keys": (
        except_keys,
        SP + "select * exclude (f_user, f_hour) from s where case_index not in (select case_index from p where actual=1 and predicted=0)",
    ),
    "subset_check": (subset_check, SPM + "select distinct combination_id, combination_id%2=0 as available from m"),
    "power_set": (
        power_set_products,
        with_ctes(S)
        + """select case_index, f_hour*f_k as f_hourxf_k, f_hour*tsh as f_hourxtsh, f_k*tsh as f_kxtsh, f_hour*f_k*tsh as f_hourxf_kxtsh from s""",
    ),
    "model_subsets": (model_subsets, SP10 + AND_SQL + f"select subset, {_MEMBERS}, model_count, tp, fp from ands"),
}
