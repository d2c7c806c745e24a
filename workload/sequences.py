"""Queries over windows and ordered sequences."""

from pyspark.sql import functions as F

from raresight.functions.metrics import with_rates
from raresight.operators import curves
from raresight.operators.sweep import CUTOFFS, threshold_counts
from raresight.sources.catalog import latest_records

from .fixtures import COUNTS_SQL, K, RATES_SQL, S, SP, SPM, combination_means, predictions, records, screening, with_ctes

KR = with_ctes(K, "r as (select *, (row_number() over (order by fnr, combination_id)-1)::int as rank from k)")


def latest_record(spark, sf):
    m = latest_records(records(spark, sf), ["combination_id", "tag", "fold", "metadata"], "created_at", "record_id")
    return m.select("record_id", "combination_id", "tag", "fold", "version", "metadata", "true_positives", "false_positives")


def _ranked(spark, sf):
    return curves.rank_series(combination_means(spark, sf))


def rank_series(spark, sf):
    return _ranked(spark, sf)


def last_zero_index(spark, sf):
    return curves.last_zero_rank(_ranked(spark, sf))


def rolling_mean_centered(spark, sf):
    r = curves.rolling(curves.rolling(_ranked(spark, sf), "fnr", 20, "fnr_mean"), "ppv", 20, "ppv_mean")
    return r.select("rank", F.round("fnr_mean", 9).alias("fnr_mean"), F.round("ppv_mean", 9).alias("ppv_mean"))


def rolling_quantile(spark, sf):
    r = curves.rolling(_ranked(spark, sf), "ppv", 20, "lower", 0.10)
    r = curves.rolling(r, "ppv", 20, "upper", 0.90)
    return r.select("rank", F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"))


def rolling_smooth_band(spark, sf):
    r = curves.smooth_band(_ranked(spark, sf))
    mean = curves.rolling(_ranked(spark, sf), "fnr", 20, "m").agg(F.percentile("m", 0.1)).scalar()
    return r.select("rank", F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"), F.round(mean, 9).alias("fnr_band"))


def lowess(spark, sf):
    return curves.lowess(_ranked(spark, sf), "ppv", 0.1, 3).select("rank", F.round("smooth", 7).alias("smooth"))


def _roc(spark, sf, **kw):
    return curves.roc_points(predictions(spark, sf), ["combination_id"], **kw)


def roc_points(spark, sf):
    out = _roc(spark, sf)
    return out.select("combination_id", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"), F.round("threshold", 9).alias("threshold"))


def roc_at_threshold(spark, sf):
    out = curves.roc_at_threshold(_roc(spark, sf), ["combination_id"])
    return out.select("combination_id", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"), F.round("threshold", 9).alias("threshold"))


def threshold_curves(spark, sf):
    out = _roc(spark, sf, drop_collinear=False).where("threshold <= 1.0")
    return out.select("combination_id", F.round("threshold", 9).alias("threshold"), F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


def threshold_sweep_metrics(spark, sf):
    return with_rates(threshold_counts(screening(spark, sf), "tsh", "label", ["fold"]))


def percentile_rank_cut(spark, sf):
    out = curves.percentile_cut(predictions(spark, sf), ["combination_id", "fold"], "proba", 0.9, 0.3)
    return out.select("combination_id", "fold", "case_index", F.round("cut", 9).alias("cut"))


def score_normalise_max(spark, sf):
    out = curves.normalise_by_max(predictions(spark, sf))
    return out.select("combination_id", "case_index", F.round("proba_norm", 9).alias("proba_norm"))


_CURVE = """, sc as (select combination_id, proba, count(*) filter (where actual=1) as pos, count(*) filter (where actual=0) as neg from p group by all),
 cu as (select *, sum(pos) over w as cp, sum(neg) over w as cn, sum(pos) over (partition by combination_id) as ap, sum(neg) over (partition by combination_id) as an,
  lead(pos) over w as np, lead(neg) over w as nn from sc window w as (partition by combination_id order by proba desc)),
 st as (select distinct combination_id, 0.0::double as fpr, 0.0::double as tpr, 'inf'::double as threshold from p),
 full_curve as (select combination_id, cn::double/an as fpr, cp::double/ap as tpr, proba as threshold from cu union all select * from st),
 curve as (select combination_id, cn::double/an as fpr, cp::double/ap as tpr, proba as threshold from cu where not coalesce(np=pos and nn=neg and not (cp=pos and cn=neg), false) union all select * from st)
"""


def _win(width, col, fn, name):
    b, a = width // 2, width - width // 2 - 1
    w = f"over (order by rank rows between {b} preceding and {a} following)"
    return f"case when count({col}) {w} = {width} then {fn} {w} end as {name}"


def _lowess_sql(iterations=3):
    ctes = [
        "n as (select count(*) as n, floor(0.1::double*count(*)+1e-10)::int as k from r)",
        "sp as (select rank as at_rank, least(greatest(rank-((k-1)-(k-1)//2),0), n-k)::int as l, k from r cross join n)",
        "nb as (select at_rank, j as rank, greatest(at_rank-l, l+k-1-at_rank)::double as h from (select at_rank, l, k, unnest(range(l, l+k)) as j from sp))",
        "tri as (select at_rank, rank, case when abs(rank-at_rank)/h<1 then pow(1-pow(abs(rank-at_rank)/h,3),3) else 0 end as t from nb)",
        "f0 as (select rank, ppv as y, 1.0::double as rb from r)",
    ]
    for i in range(iterations + 1):
        ctes.append(
            f"""g{i} as (select at_rank, sum(w) as sw, sum(w*x) as sx, sum(w*y) as sy, sum(w*x*x) as sxx, sum(w*x*y) as sxy from (
 select at_rank, t*rb as w, (tri.rank-at_rank)::double as x, y from tri join f{i} on tri.rank=f{i}.rank) group by at_rank)"""
        )
        ctes.append(
            f"""m{i} as (select rank, y, coalesce(case when abs(sw*sxx-sx*sx)>1e-12 then (sxx*sy-sx*sxy)/(sw*sxx-sx*sx) when sw>0 then sy/sw end, y) as smooth
 from f{i} join g{i} on rank=at_rank)"""
        )
        if i < iterations:
            ctes.append(
                f"""f{i + 1} as (select rank, y, case when s>0 then case when res/s<1 then pow(1-(res/s)*(res/s),2) else 0 end else 1 end as rb
 from (select rank, y, abs(y-smooth) as res, 6*(select median(abs(y-smooth)) from m{i}) as s from m{i}))"""
            )
    return KR + ", " + ",\n".join(ctes) + f" select rank, round(smooth,7) as smooth from m{iterations}"


_CUTS = "(select unnest([" + ",".join(f"{c}::double" for c in CUTOFFS) + "]) as cutoff)"

QUERIES = {
    "latest_record": (
        latest_record,
        SPM
        + """select record_id, combination_id, tag, fold, version, metadata, true_positives, false_positives from m
 qualify row_number() over (partition by combination_id, tag, fold, metadata order by created_at desc, record_id desc)=1""",
    ),
    "rank_series": (rank_series, KR + "select * from r"),
    "last_zero_index": (last_zero_index, KR + "select (max(rank) filter (where fnr=0))::double as last_zero from r"),
    "rolling_mean_centered": (
        rolling_mean_centered,
        KR
        + f"select rank, round(fnr_mean,9) as fnr_mean, round(ppv_mean,9) as ppv_mean from (select rank, {_win(20, 'fnr', 'avg(fnr)', 'fnr_mean')}, {_win(20, 'ppv', 'avg(ppv)', 'ppv_mean')} from r)",
    ),
    "rolling_quantile": (
        rolling_quantile,
        KR
        + f"select rank, round(lower,9) as lower, round(upper,9) as upper from (select rank, {_win(20, 'ppv', 'quantile_cont(ppv,0.1)', 'lower')}, {_win(20, 'ppv', 'quantile_cont(ppv,0.9)', 'upper')} from r)",
    ),
    "rolling_smooth_band": (
        rolling_smooth_band,
        KR
        + f""", q as (select rank, {_win(20, 'ppv', 'quantile_cont(ppv,0.1)', 'lo')}, {_win(20, 'ppv', 'quantile_cont(ppv,0.9)', 'hi')}, {_win(20, 'fnr', 'avg(fnr)', 'm')} from r)
 select rank, round(lower,9) as lower, round(upper,9) as upper, (select round(quantile_cont(m,0.1),9) from q) as fnr_band from (
 select rank, {_win(10, 'lo', 'avg(lo)', 'lower')}, {_win(10, 'hi', 'avg(hi)', 'upper')} from q)""",
    ),
    "lowess": (lowess, _lowess_sql()),
    "roc_points": (
        roc_points,
        SP + _CURVE + "select combination_id, round(fpr,9) as fpr, round(tpr,9) as tpr, round(threshold,9) as threshold from curve",
    ),
    "roc_at_threshold": (
        roc_at_threshold,
        SP
        + _CURVE
        + """select combination_id, round(fpr,9) as fpr, round(tpr,9) as tpr, round(threshold,9) as threshold from curve where threshold<'inf'::double
 qualify row_number() over (partition by combination_id order by abs(threshold-0.5), threshold desc)=1""",
    ),
    "threshold_curves": (
        threshold_curves,
        SP + _CURVE + "select combination_id, round(threshold,9) as threshold, round(fpr,9) as fpr, round(tpr,9) as tpr from full_curve where threshold<=1",
    ),
    "threshold_sweep_metrics": (
        threshold_sweep_metrics,
        with_ctes(S)
        + f"""select *, {RATES_SQL.replace('true_positives+false_positives+false_negatives+true_negatives as total_predictions,', '')} from (
 select fold, cutoff, {COUNTS_SQL} from (select fold, cutoff, label as actual, (tsh>=cutoff)::int as predicted from s cross join {_CUTS}) group by all)""",
    ),
    "percentile_rank_cut": (
        percentile_rank_cut,
        SP
        + """, c as (select combination_id, fold, greatest(quantile_cont(proba,0.9),0.3::double) as cut from p group by all)
 select combination_id, fold, case_index, round(cut,9) as cut from p join c using(combination_id, fold) where proba>cut""",
    ),
    "score_normalise_max": (
        score_normalise_max,
        SP
        + "select combination_id, case_index, round(proba/mx,9) as proba_norm from p join (select combination_id, max(proba) as mx from p group by 1) using(combination_id)",
    ),
}
