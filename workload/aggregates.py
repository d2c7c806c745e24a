"""Queries over aggregations and profiles."""

from pyspark.sql import functions as F

from raresight.functions import metrics
from raresight.functions.text import outcome_label
from raresight.operators import clean, curves, explain_tables, profile
from raresight.operators.features import class_medians, primary_weight_rank
from raresight.session import truncate_lineage

from .fixtures import (
    AND_SQL, CLEAN, COUNTS_SQL, FEATURES, FLOOR, K, MEMBERS, RATES_SQL, S, SP, SP10, SPMA, T, W, WIDE, analysis, combination_means, dirty, predictions, screening,
    table, wide, with_ctes,
)

LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
QUANTILES = ["q5", "q25", "q50", "q75", "q95"]
PC = SP + f", pc as (select combination_id, fold, {COUNTS_SQL} from p group by all)\n"


def _r(df, *cols, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def confusion_counts(spark, sf):
    return metrics.confusion_counts(predictions(spark, sf), ["combination_id", "fold"])


def classification_metrics(spark, sf):
    return metrics.classification_metrics(predictions(spark, sf), ["combination_id", "fold"])


def _scorer(*names):
    def run(spark, sf):
        counts = metrics.confusion_counts(predictions(spark, sf), ["combination_id", "fold"])
        s = metrics.scorers()
        return counts.select("combination_id", "fold", *[F.round(s[n], 9).alias(n) for n in names])

    return run


def _fbeta(b, tp="true_positives", fp="false_positives", fn="false_negatives"):
    d = f"({1 + b * b}*{tp}+{b * b}*{fn}+{fp})"
    return f"(case when {d}<>0 then ({1 + b * b}*{tp})::double/{d} else 0 end)"


_NEG = _fbeta(1, "true_negatives", "false_negatives", "false_positives")
_FPR = "case when false_positives+true_negatives<>0 then false_positives::double/(false_positives+true_negatives) else 0 end"
_FNR = "case when true_positives+false_negatives<>0 then false_negatives::double/(true_positives+false_negatives) else 0 end"


def _scorer_sql(**exprs):
    return PC + "select combination_id, fold, " + ", ".join(f"round({e},9) as {n}" for n, e in exprs.items()) + " from pc"


def precision_recall_f10(spark, sf):
    a = analysis(spark, sf)
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    a = a.withColumn("precision", F.when(tp + fp != 0, tp / (tp + fp).cast("double"))).withColumn(
        "recall", F.when(tp + fn != 0, tp / (tp + fn).cast("double"))
    )
    d = F.lit(100.0) * F.col("precision") + F.col("recall")
    f10 = F.when(d != 0, F.lit(101.0) * (F.col("precision") * F.col("recall") / d))
    return _r(a.select("record_id", "precision", "recall", f10.alias("f10")), "precision", "recall", "f10")


def subset_ppv(spark, sf):
    c = metrics.confusion_counts(predictions(spark, sf).where(F.col("combination_id").isin(1, 3, 8)), ["combination_id"])
    tp, fp = F.col("true_positives"), F.col("false_positives")
    return c.select("combination_id", F.when(tp + fp != 0, tp / (tp + fp).cast("double")).alias("ppv"))


def mean_by_combination(spark, sf):
    a = analysis(spark, sf)
    return a.groupBy("tag", "model", "scorer", "resampler", "combination_id").agg(
        *[F.round(F.avg(m), 9).alias(m) for m in ("fnr", "ppv", "f1", "accuracy", "tnr")]
    )


def std_by_combination(spark, sf):
    a = analysis(spark, sf)
    return a.groupBy("tag", "model", "scorer", "resampler", "combination_id").agg(
        *[F.round(F.stddev_samp(m), 9).alias(m) for m in ("fnr", "ppv", "f1")]
    )


def metric_heatmap_pivot(spark, sf):
    a = analysis(spark, sf)
    return (
        a.groupBy("tag", "scorer", "model")
        .pivot("resampler", ["none", "SMOTE"])
        .agg(F.round(F.avg("ppv"), 9).alias("ppv_mean"), F.round(F.stddev_samp("ppv"), 9).alias("ppv_std"))
    )


def _misses(spark, sf):
    """Misses of the combinations of a tag that have between one and six over all folds; cases are dealt to three tags."""
    p = predictions(spark, sf).where("actual = 1 and predicted = 0").withColumn("tag", F.concat(F.lit("tag"), F.col("case_index") % 3))
    few = p.groupBy("tag", "combination_id").agg(F.count(F.lit(1)).alias("n")).where("n between 1 and 6")
    return p.join(few, ["tag", "combination_id"], "left_semi").select("case_index", "tag", "combination_id", "fold")


def fn_per_combination(spark, sf):
    return _misses(spark, sf)


def fn_case_frequency(spark, sf):
    return _misses(spark, sf).groupBy("case_index").agg(F.count(F.lit(1)).alias("count"))


def value_counts(spark, sf):
    return profile.value_counts(predictions(spark, sf), "combination_id", "actual", "predicted")


def count_distinct_variations(spark, sf):
    return analysis(spark, sf).agg(F.count_distinct(F.struct("combination_id", "tag")).alias("variations"))


def describe(spark, sf):
    d = profile.describe(wide(spark, sf), WIDE)
    return _r(d, "mean", "std", "q25", "q50", "q75", digits=4)


def class_medians_q(spark, sf):
    return _r(class_medians(screening(spark, sf), FEATURES, "label"), "value", digits=6)


def primary_weight_rank_q(spark, sf):
    out = primary_weight_rank(screening(spark, sf), FEATURES, "label")
    return out.select("population", "name", F.round("weight", 9).alias("weight"), "rank")


def null_fraction(spark, sf):
    m = clean.map_names(dirty(spark, sf))
    return profile.null_counts(m, m.columns).select("name", F.round("fraction", 9).alias("fraction"))


def null_count_by_column(spark, sf):
    m = clean.clean_values(clean.map_names(dirty(spark, sf)))
    return profile.null_counts(m, m.columns).select("name", "nulls")


def nulls_per_row_hist(spark, sf):
    raw = clean.map_names(dirty(spark, sf))
    cleaned = clean.clean_values(raw)
    a = profile.nulls_per_row(raw, raw.columns).withColumn("stage", F.lit("raw"))
    b = profile.nulls_per_row(cleaned, cleaned.columns).withColumn("stage", F.lit("clean"))
    return a.unionByName(b)


def histogram(spark, sf):
    return _r(profile.histogram(screening(spark, sf), "tsh", 500), "left_edge")


def histogram_by_label(spark, sf):
    p = predictions(spark, sf).where("combination_id = 6")
    s = screening(spark, sf).select("case_index", "tsh").join(p, "case_index")
    s = s.withColumn("outcome", outcome_label(F.col("predicted"), F.col("actual"))).where("outcome <> 'True Negative'")
    return profile.histogram(s, "tsh", 100, ["outcome"]).select("outcome", "bin", "n")


def histogram_weighted(spark, sf):
    p = predictions(spark, sf)
    out = profile.histogram_weighted(p, "proba", 100, "combination_id", outcome_label(F.col("predicted"), F.col("actual")))
    return _r(out, "weight")


def kde_density(spark, sf):
    out = profile.kde(predictions(spark, sf), "proba", "combination_id")
    return out.select("combination_id", "step", F.round("at", 9).alias("point"), F.round("density", 7).alias("density"))


def class_minority(spark, sf):
    return profile.minority_class(screening(spark, sf))


def max_by_model_count(spark, sf):
    from raresight.operators.ensemble import and_subsets, max_by_size

    return max_by_size(and_subsets(predictions(spark, sf, len(MEMBERS)), MEMBERS), ["ppv", "fnr"])


def importance_mean(spark, sf):
    """The strongest feature of each combination is the one that ranks the cases best by itself."""
    from .learning import forest_importances

    means = explain_tables.mean_importance(forest_importances(spark, sf), 5)
    return means.groupBy("combination_id").agg(
        F.count_distinct("feature").alias("features"), F.count_if(~F.col("importance").between(0.0, 1.0)).alias("outside"), F.max_by("feature", "importance").alias("strongest")
    )


def impact_tail_sum(spark, sf):
    return _r(explain_tables.impact_tail_sum(phi_table(spark, sf)), "impact", digits=6)


def phi_table(spark, sf):
    """Attribution-like rows per (model, case, feature) from the screening table."""
    s = screening(spark, sf).select("case_index", *FEATURES)
    s = s.withColumn("model_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    cells = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"), ((F.col(f) - 20.0) * F.col("model_id") / 100.0).alias("phi")) for f in FEATURES]
    )
    return s.select("case_index", "model_id", F.explode(cells).alias("s")).select("case_index", "model_id", "s.*")


PHI = f"""phi as (select case_index, model_id, feature, value, (value-20.0::double)*model_id/100.0::double as phi from (
 unpivot (select case_index, model_id::int as model_id, {', '.join(FEATURES)} from s cross join (values (1),(2),(3)) x(model_id))
 on {', '.join(FEATURES)} into name feature value value))"""


def auc(spark, sf):
    return _r(curves.auc(predictions(spark, sf), ["combination_id"]), "auc")


def profile_table(spark, sf):
    li = table(spark, sf, "lineitem").select(*LINEITEM)
    found = _r(profile.profile_table(li, LINEITEM), "mean", "std", digits=6)
    return _r(found, *QUANTILES, digits=4)


def profile_merged(spark, sf):
    """Profile states of seven loads, merged by population; the rank of each quantile is counted on the rows."""
    li = table(spark, sf, "lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"]
    states = truncate_lineage(profile.profile_state(li, cols, ["l_returnflag", "l_linenumber"]))
    found = truncate_lineage(profile.merge_profiles(states, ["l_returnflag"]))
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in cols])
    rows = li.select("l_returnflag", F.explode(cells).alias("s")).select("l_returnflag", "s.*")
    ranks = rows.join(found.select("l_returnflag", "name", "p", "value"), ["l_returnflag", "name"])
    ranks = ranks.groupBy("l_returnflag", "name", "p").agg(F.count_if(F.col("x") < F.col("value")).alias("under"), F.count_if(F.col("x") <= F.col("value")).alias("upto"))
    near = (F.col("under") <= (F.col("p") + profile.SKETCH_ERROR) * F.col("n")) & (F.col("upto") >= (F.col("p") - profile.SKETCH_ERROR) * F.col("n"))
    return _r(found.join(ranks, ["l_returnflag", "name", "p"]).withColumn("within", near).drop("under", "upto", "value"), "mean", digits=6)


def profile_compare(spark, sf):
    s = screening(spark, sf).withColumn("population", F.when(F.col("label") == 1, "Positive").otherwise("Negative"))
    found = _r(profile.profile_table(s, FEATURES, ["population"]), "mean", "std", digits=6)
    return _r(found, *QUANTILES, digits=4)


def profile_target(spark, sf):
    """Numeric features by bin, the fold as a category."""
    s = screening(spark, sf).withColumn("group", F.concat(F.lit("g"), F.col("fold")))
    return _r(profile.profile_target(s, [*FEATURES, "group"], "label"), "target_mean").fillna(-1, ["bin"])


def profile_associations(spark, sf):
    t = wide(spark, sf)
    num = profile.association_numeric(t, WIDE)
    return _r(num.unionByName(profile.correlation_ratio(t, "status", "price")), "value", digits=6)


def profile_categories(spark, sf):
    li = table(spark, sf, "lineitem")
    return _r(profile.categorical_association(li, "l_returnflag", "l_linestatus"), "cramers_v", "uncertainty", digits=7)


def row_preserve_check(spark, sf):
    p = predictions(spark, sf)
    per = p.groupBy("combination_id").agg(F.count_distinct("fold").alias("folds"), F.count(F.lit(1)).alias("rows"), F.count_distinct("case_index").alias("cases"))
    return clean.expect(
        per,
        {"five folds": F.bool_and(F.col("folds") == 5), "one row per case": F.bool_and(F.col("rows") == F.col("cases")), "same size": F.min("rows") == F.max("rows")},
    )


def _median_sql(by_all):
    return " union all ".join(
        f"select '{pop}' as population, '{f}' as name, quantile_cont({f},0.5) as value from s {cond}"
        for pop, cond in (("all", ""), ("positive", "where label=1"), ("negative", "where label=0"))
        for f in FEATURES
    )


_DESC = " union all ".join(
    f"""select '{c}' as name, count({c}) as count, round(avg({c}),4) as mean, round(stddev_samp({c}),4) as std, min({c}) as min, max({c}) as max,
 round(quantile_cont({c},0.25),4) as q25, round(quantile_cont({c},0.5),4) as q50, round(quantile_cont({c},0.75),4) as q75 from t"""
    for c in WIDE
)
_MAPPED = {
    "episode": '"Episode"', "definitive_diagnosis": '"Definitive Diagnosis"', "TSH": '"TSH_I (RAW)"', "sex": '"Sex"',
    "age_at_collection": '"Age at Collection (hr)"', "gestational_age": '"Gestational Age (days)"', "birth_weight": '"Birth Weight (g)"',
    "multiple_birth_rank": '"Multiple Birth Rank"', "transfusion_status": '"Transfusion Status"', "HGB_Pattern": '"HGB Pattern_I (RAW)"',
}
_BIN = "least({n}-1, greatest(0, floor(({x}-lo)*{n}.0::double/(hi-lo))))::int"


_ROUNDED = ", ".join(f"round({q},4) as {q}" for q in QUANTILES)


def _prof(cols, src, keys="", numeric=None):
    parts = []
    for c in cols:
        num = numeric is None or c in numeric
        k = f"{keys}," if keys else ""
        parts.append(
            f"""select {k} '{c}' as name, count(*) as rows, count(*)-count({c}) as missing,
 {f'min({c})::double' if num else 'null::double'} as min, {f'max({c})::double' if num else 'null::double'} as max,
 {f'avg({c})' if num else 'null::double'} as mean, {f'stddev_samp({c})' if num else 'null::double'} as std, count(distinct {c}) as "distinct",
 {', '.join((f'quantile_cont({c}::double,{int(q[1:]) / 100})' if num else 'null::double') + f' as {q}' for q in QUANTILES)},
 mode_n.top_count, mode_n.top_value from {src} {'join' if keys else 'cross join'} (select {k} max(n) as top_count, arg_max(v, {{'n': n, 'v': v}}) as top_value from (select {k} {c}::varchar as v, count(*) as n from {src} where {c} is not null group by all) {('group by '+keys) if keys else ''}) mode_n {f'using({keys})' if keys else ''} group by {k} mode_n.top_count, mode_n.top_value"""
        )
    return " union all ".join(parts)


QUERIES = {
    "confusion_counts": (confusion_counts, PC + "select *, true_positives+false_positives+false_negatives+true_negatives as total_predictions from pc"),
    "classification_metrics": (classification_metrics, PC + f"select *, {RATES_SQL} from pc"),
    "metric_fp_fn": (_scorer("fp_fn"), _scorer_sql(fp_fn=f"1.0/(greatest({_FPR},1e-8)+greatest({_FNR},1e-8))")),
    "metric_recall": (_scorer("recall_score"), _scorer_sql(recall_score="case when true_positives+false_negatives<>0 then true_positives::double/(true_positives+false_negatives) else 0 end")),
    "metric_fbeta": (
        _scorer("f1_score_pos", "f2_score_pos", "f4_score_pos", "f10_score_pos"),
        _scorer_sql(f1_score_pos=_fbeta(1), f2_score_pos=_fbeta(2), f4_score_pos=_fbeta(4), f10_score_pos=_fbeta(10)),
    ),
    "metric_f1_neg": (_scorer("f1_score_neg"), _scorer_sql(f1_score_neg=_NEG)),
    "metric_f1_macro": (_scorer("f1_score_macro"), _scorer_sql(f1_score_macro=f"({_fbeta(1)}+{_NEG})/2")),
    "metric_accuracy": (
        _scorer("accuracy"),
        _scorer_sql(accuracy="(true_positives+true_negatives)::double/(true_positives+false_positives+false_negatives+true_negatives)"),
    ),
    "precision_recall_f10": (
        precision_recall_f10,
        SPMA
        + """select record_id, round(p,9) as precision, round(r,9) as recall, case when 100*p+r<>0 then round(101.0*(p*r/(100.0*p+r)),9) end as f10 from (
 select record_id, case when true_positives+false_positives<>0 then true_positives::double/(true_positives+false_positives) end as p,
 case when true_positives+false_negatives<>0 then true_positives::double/(true_positives+false_negatives) end as r from a)""",
    ),
    "subset_ppv": (
        subset_ppv,
        SP
        + """select combination_id, count(*) filter (where actual=1)::double/nullif(count(*),0) as ppv from p where predicted=1 and combination_id in (1,3,8) group by 1""",
    ),
    "mean_by_combination": (
        mean_by_combination,
        SPMA
        + "select tag, model, scorer, resampler, combination_id, "
        + ", ".join(f"round(avg({m}),9) as {m}" for m in ("fnr", "ppv", "f1", "accuracy", "tnr"))
        + " from a group by all",
    ),
    "std_by_combination": (
        std_by_combination,
        SPMA
        + "select tag, model, scorer, resampler, combination_id, "
        + ", ".join(f"round(stddev_samp({m}),9) as {m}" for m in ("fnr", "ppv", "f1"))
        + " from a group by all",
    ),
    "metric_heatmap_pivot": (
        metric_heatmap_pivot,
        SPMA
        + "select tag, scorer, model, "
        + ", ".join(
            f"""round({f}(ppv) filter (where resampler='{r}'),9) as "{r}_{n}\""""
            for r in ("none", "SMOTE")
            for f, n in (("avg", "ppv_mean"), ("stddev_samp", "ppv_std"))
        )
        + " from a group by tag, scorer, model",
    ),
    "fn_per_combination": (
        fn_per_combination,
        SP
        + """select case_index, 'tag' || case_index % 3 as tag, combination_id, fold from (select *, count(*) over (partition by case_index % 3, combination_id) as n from p where actual=1 and predicted=0) where n between 1 and 6""",
    ),
    "fn_case_frequency": (
        fn_case_frequency,
        SP
        + """select case_index, count(*) as count from (select *, count(*) over (partition by case_index % 3, combination_id) as n from p where actual=1 and predicted=0) where n between 1 and 6 group by 1""",
    ),
    "value_counts": (value_counts, SP + "select combination_id, actual, predicted, count(*) as n from p group by all"),
    "count_distinct_variations": (count_distinct_variations, SPMA + "select count(*) as variations from (select distinct combination_id, tag from a)"),
    "describe": (describe, with_ctes(T) + _DESC),
    "class_medians": (class_medians_q, with_ctes(S) + f"select population, name, round(value,6) as value from ({_median_sql(True)})"),
    "primary_weight_rank": (
        primary_weight_rank_q,
        with_ctes(S)
        + f""", md as ({_median_sql(True)}) select c.population, c.name, round(w,9) as weight,
 row_number() over (partition by c.population order by w desc nulls last, c.name)::int as rank from (
 select c.population, c.name, case when o.value<>0 then abs((c.value-o.value)/o.value) when c.value<>0 then 'inf'::double end as w
 from md c join md o on o.population='all' and o.name=c.name where c.population<>'all') c""",
    ),
    "null_fraction": (
        null_fraction,
        with_ctes(W)
        + " union all ".join(f"select '{n}' as name, round(avg(({c} is null)::int),9) as fraction from w" for n, c in _MAPPED.items()),
    ),
    "null_count_by_column": (
        null_count_by_column,
        with_ctes(W, CLEAN) + " union all ".join(f"""select '{n}' as name, count(*)-count("{n}") as nulls from c""" for n in _MAPPED),
    ),
    "nulls_per_row_hist": (
        nulls_per_row_hist,
        with_ctes(W, CLEAN)
        + "select 'raw' as stage, "
        + "+".join(f"({c} is null)::int" for c in _MAPPED.values())
        + " as nulls, count(*) as rows from w group by all union all select 'clean' as stage, "
        + "+".join(f'("{n}" is null)::int' for n in _MAPPED)
        + " as nulls, count(*) as rows from c group by all",
    ),
    "histogram": (
        histogram,
        with_ctes(S)
        + f"""select bin, count(*) as n, round(any_value(lo)+bin*(any_value(hi-lo)/500),9) as left_edge from (
 select {_BIN.format(n=500, x='tsh')} as bin, lo, hi from s cross join (select min(tsh) as lo, max(tsh) as hi from s)) group by bin""",
    ),
    "histogram_by_label": (
        histogram_by_label,
        SP
        + f""", d as (select tsh, case when predicted=1 and actual=1 then 'True Positive' when predicted=1 then 'False Positive' else 'False Negative' end as outcome
 from s join p using(case_index) where combination_id=6 and not (predicted=0 and actual=0))
 select outcome, {_BIN.format(n=100, x='tsh')} as bin, count(*) as n from d cross join (select min(tsh) as lo, max(tsh) as hi from d) group by all""",
    ),
    "histogram_weighted": (
        histogram_weighted,
        SP
        + f""", r as (select *, avg(predicted) over (partition by combination_id) as ratio from p),
 w as (select *, case when predicted=0 then ratio else 1-ratio end as wt from r),
 g as (select combination_id, sum(wt) as total from w group by 1),
 d as (select combination_id, wt, case when predicted=1 and actual=1 then 'True Positive' when predicted=1 then 'False Positive' when actual=1 then 'False Negative' else 'True Negative' end as label,
 {_BIN.format(n=100, x='proba')} as bin from w cross join (select min(proba) as lo, max(proba) as hi from p))
 select combination_id, label, bin, round(sum(wt)/any_value(total),9) as weight, count(*) as n from d join g using(combination_id) group by combination_id, label, bin""",
    ),
    "kde_density": (
        kde_density,
        SP
        + f""", st as (select combination_id, count(*) as n, pow(count(*)::double,-0.2)*stddev_samp(proba) as bw, min(proba) as l, max(proba) as h from p group by 1),
 ce as (select combination_id, {_BIN.format(n=1024, x='proba')} as bin, count(*) as w, avg(proba) as x from p cross join (select min(proba) as lo, max(proba) as hi from p) group by 1,2),
 pt as (select st.*, step::int as step, (l-3*bw)+((h+3*bw)-(l-3*bw))*step/199.0::double as point from st cross join (select unnest(range(200)) as step) where bw>0)
 select combination_id, step, round(point,9) as point, round(sum(w*exp(-0.5*((point-x)/bw)*((point-x)/bw)))/(n*bw*sqrt(2*pi())),7) as density
 from pt join ce using(combination_id) group by combination_id, step, point, n, bw""",
    ),
    "class_minority": (class_minority, with_ctes(S) + "select label as minority, count(*) as n from s group by label order by n, label limit 1"),
    "max_by_model_count": (
        max_by_model_count,
        SP10 + AND_SQL + "select model_count, max(ppv) as ppv, max(fnr) as fnr from ands group by model_count",
    ),
    "importance_mean": (
        importance_mean,
        with_ctes(S, FLOOR)
        + """select combination_id, (select count(*) from best) as features, 0::bigint as outside, (select arg_max(feature, area) from best) as strongest
 from (select unnest([1,2])::int as combination_id)""",
    ),
    "impact_tail_sum": (
        impact_tail_sum,
        with_ctes(S, PHI)
        + """, cut as (select model_id, feature, quantile_cont(abs(phi),0.9) as cut from phi group by all)
 select feature, round(sum(abs(phi)),6) as impact from phi join cut using(model_id, feature) where abs(phi)>cut group by feature""",
    ),
    "auc": (
        auc,
        SP
        + """, r as (select combination_id, actual, rank() over (partition by combination_id order by proba)
  + (count(*) over (partition by combination_id, proba)-1)/2.0 as rk from p)
 select combination_id, round((sum(rk) filter (where actual=1) - count(*) filter (where actual=1)*(count(*) filter (where actual=1)+1)/2.0)
  /(count(*) filter (where actual=1)*count(*) filter (where actual=0)),9) as auc from r group by 1""",
    ),
    "profile_table": (
        profile_table,
        f"""select name, rows, missing, min, max, round(mean,6) as mean, round(std,6) as std, "distinct", top_count, top_value, {_ROUNDED}
 from ({_prof(LINEITEM, "lineitem", numeric=set(LINEITEM[:8]))})""",
    ),
    "profile_merged": (
        profile_merged,
        " union all ".join(
            f"""select l_returnflag, '{c}' as name, unnest([0.05, 0.25, 0.5, 0.75, 0.95])::double as p, count({c}) as n, round(avg({c}), 6) as mean,
 min({c})::double as low, max({c})::double as high, true as within from lineitem group by l_returnflag"""
            for c in ("l_quantity", "l_extendedprice", "l_discount", "l_partkey")
        ),
    ),
    "profile_compare": (
        profile_compare,
        with_ctes(S)
        + ", sp as (select *, case when label=1 then 'Positive' else 'Negative' end as population from s), pr as ("
        + _prof(FEATURES, "sp", "population")
        + """) select population, name, rows, missing, min, max, round(mean,6) as mean, round(std,6) as std, "distinct", top_count, top_value, """
        + _ROUNDED
        + " from pr",
    ),
    "profile_target": (
        profile_target,
        with_ctes(S)
        + " union all ".join(
            f"select '{f}' as name, {_BIN.format(n=10, x=f)} as bin, null::varchar as value, count(*) as n, round(avg(label),9) as target_mean from s cross join (select min({f}) as lo, max({f}) as hi from s) group by all"
            for f in FEATURES
        )
        + " union all select 'group', -1, 'g' || fold, count(*), round(avg(label),9) from s group by fold",
    ),
    "profile_associations": (
        profile_associations,
        with_ctes(T)
        + " union all ".join(
            f"select '{a}' as a, '{b}' as b, round(corr({a},{b}),6) as value from t" for i, a in enumerate(WIDE) for b in WIDE[i + 1 :]
        )
        + """ union all select 'status' as a, 'price' as b, round(sqrt(sum(n*(m-g)*(m-g))/any_value(ss)),6) as value from (
 select status, count(*) as n, avg(price) as m from t group by 1) cross join (select avg(price) as g, var_pop(price)*count(*) as ss from t)""",
    ),
    "profile_categories": (
        profile_categories,
        """with c as (select l_returnflag as x, l_linestatus as y, count(*)::double as n from lineitem group by all),
 e as (select *, sum(n) over (partition by x) as nx, sum(n) over (partition by y) as ny, sum(n) over () as t from c),
 h as (select sum(-nx/t*ln(nx/t)) as hx from (select distinct x, nx, t from e))
 select 'l_returnflag' as a, 'l_linestatus' as b, round(sqrt(sum((n-nx*ny/t)*(n-nx*ny/t)/(nx*ny/t))/any_value(t)/(least(count(distinct x),count(distinct y))-1)),7) as cramers_v,
 round(sum(n/t*ln(n*t/(nx*ny)))/(select hx from h),7) as uncertainty from e""",
    ),
    "row_preserve_check": (
        row_preserve_check,
        SP
        + """, c as (select combination_id, count(distinct fold) as f, count(*) as r, count(distinct case_index) as k from p group by 1)
 select 'five folds' as "check", bool_and(f=5) as passed from c union all select 'one row per case', bool_and(r=k) from c union all select 'same size', min(r)=max(r) from c""",
    ),
}
