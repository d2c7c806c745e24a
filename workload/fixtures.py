"""Inputs of the registered queries, derived from the given tables.

Every fixture exists twice: as a DataFrame and as a DuckDB common table
expression, so that both engines see identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from raresight.functions.numeric import uniform

N_COMBINATIONS = 8
TAGS = ("original_data", "all_features", "baseline_ge_14.0")
FEATURES = ["tsh", "f_user", "f_k", "f_hour"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def u_sql(text: str) -> str:
    return f"(('0x'||substr(md5({text}),1,13))::bigint/4503599627370496.0::double)"


def u_parts(*parts: str) -> str:
    """DuckDB twin of ``uniform``: parts are SQL expressions."""
    return u_sql("||'|'||".join(f"({p})::varchar" for p in parts))


# ---- S: screening table -------------------------------------------------


def screening(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    err = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("case_index"),
        F.col("event_id").cast("string").alias("episode"),
        F.col("value").alias("tsh"),
        F.col("user_id").cast("double").alias("f_user"),
        F.get_json_object("props", "$.k").cast("double").alias("f_k"),
        F.hour("ts").cast("double").alias("f_hour"),
        err.cast("int").alias("err"),
        (err & (F.col("value") >= 150)).cast("int").alias("label"),
        F.floor(uniform("fold", F.col("event_id")) * 5).cast("int").alias("fold"),
    )


S = f"""s as (
 select event_id as case_index, event_id::varchar as episode, value as tsh, user_id::double as f_user,
  json_extract_string(props,'$.k')::double as f_k, hour(ts)::double as f_hour,
  (event_type='error')::int as err, (event_type='error' and value>=150)::int as label,
  floor({u_parts("'fold'", "event_id")}*5)::int as fold
 from events)"""

# ---- how well single features rank the cases ----------------------------

FLOOR = """best as (select feature, greatest(area, 1-area) as area from (
 select feature, (sum(rk) filter (where label=1) - count(*) filter (where label=1)*(count(*) filter (where label=1)+1)/2.0)
  /(count(*) filter (where label=1)*count(*) filter (where label=0)) as area from (
  select feature, label, rank() over (partition by feature order by x) + (count(*) over (partition by feature, x)-1)/2.0 as rk from ("""+" union all ".join(f"select '{f}' as feature, {f} as x, label from s" for f in FEATURES)+""")) group by feature)),
fl as (select 0.5::double+(max(area)-0.5)/2 as floor from best)"""

# ---- P: predictions of eight combinations -------------------------------


def predictions(spark, sf, combinations: int = N_COMBINATIONS) -> DataFrame:
    s = screening(spark, sf).select("case_index", "fold", "label", "tsh", "err")
    s = s.withColumn("combination_id", F.explode(F.array(*[F.lit(i) for i in range(1, combinations + 1)])))
    raw = (
        F.col("tsh") / F.lit(300.0)
        + F.lit(0.25) * uniform(F.col("combination_id"), F.col("case_index"))
        + F.lit(0.25) * F.col("err")
        - F.lit(0.06) * (F.col("combination_id") - 1)
    )
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    return s.withColumn("proba", x).select(
        "combination_id",
        "fold",
        "case_index",
        F.col("label").alias("actual"),
        (F.col("proba") >= 0.5).cast("int").alias("predicted"),
        "proba",
    )


def p_sql(combinations: int) -> str:
    return f"""p0 as (
 select c.combination_id::int as combination_id, s.fold, s.case_index, s.label as actual,
  greatest(0.0::double, least(1.0::double, s.tsh/300.0::double
   + 0.25::double*{u_parts("c.combination_id", "s.case_index")} + 0.25::double*s.err
   - 0.06::double*(c.combination_id-1))) as proba
 from s cross join (values {",".join(f"({i})" for i in range(1, combinations + 1))}) as c(combination_id)),
p as (select combination_id, fold, case_index, actual, (proba>=0.5)::int as predicted, proba from p0)"""


P = p_sql(N_COMBINATIONS)

# ---- M: run records with metrics ----------------------------------------

_THRESHOLDS = {  # (tag, version) -> cut applied to the scores
    ("original_data", 2): 0.5,
    ("original_data", 1): 0.55,
    ("all_features", 2): 0.6,
    ("all_features", 1): 0.65,
    ("baseline_ge_14.0", 2): 0.4,
    ("baseline_ge_14.0", 1): 0.45,
}


def combination_columns(c) -> dict:
    return {
        "model": F.element_at(
            F.array(*[F.lit(m) for m in ("RandomForest", "GradientBoosting", "BalancedBagging", "LinearSVC")]),
            ((c - 1) % 4 + 1).cast("int"),
        ),
        "resampler": F.when(c <= 4, F.lit("none")).otherwise(F.lit("SMOTE")),
        "cross_validator": F.lit("StratifiedKFold_5"),
        "scorer": F.when(c % 2 == 0, F.lit("recall_score")).otherwise(F.lit("f10_score_pos")),
    }


COMBO_SQL = """(['RandomForest','GradientBoosting','BalancedBagging','LinearSVC'])[((combination_id-1)%4+1)::int] as model,
 case when combination_id<=4 then 'none' else 'SMOTE' end as resampler, 'StratifiedKFold_5' as cross_validator,
 case when combination_id%2=0 then 'recall_score' else 'f10_score_pos' end as scorer"""


def records(spark, sf) -> DataFrame:
    """One row per (combination, tag, version, fold): key, version, counts.

    All six cuts are counted in one pass over the predictions.
    """
    p = predictions(spark, sf)
    counts = p.groupBy("combination_id", "fold").agg(
        *[
            F.count_if((F.col("actual") == a) & (F.col("proba") >= t if q else F.col("proba") < t)).alias(f"n_{i}_{a}{q}")
            for i, t in enumerate(_THRESHOLDS.values())
            for a in (0, 1)
            for q in (0, 1)
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(tag).alias("tag"),
                F.lit(version).alias("version"),
                F.col(f"n_{i}_11").alias("true_positives"),
                F.col(f"n_{i}_01").alias("false_positives"),
                F.col(f"n_{i}_10").alias("false_negatives"),
                F.col(f"n_{i}_00").alias("true_negatives"),
            )
            for i, (tag, version) in enumerate(_THRESHOLDS)
        ]
    )
    out = counts.select("combination_id", "fold", F.explode(rows).alias("r")).select("combination_id", "fold", "r.*")
    c = F.col("combination_id")
    tag_no = F.array_position(F.array(*[F.lit(t) for t in TAGS]), F.col("tag"))
    return out.withColumns(
        {
            **combination_columns(c),
            "record_id": ((F.col("version") * 10 + tag_no) * 1000 + c * 10 + F.col("fold")).cast("bigint"),
            "metadata": F.format_string('{"layer": %d}', (c % 2).cast("int")),
            "created_at": F.lit("2024-03-01 08:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(F.lit(0), F.col("version"), F.col("fold")),
        }
    )


def _m_sql() -> str:
    parts = []
    for (tag, version), t in _THRESHOLDS.items():
        parts.append(
            f"""select combination_id, fold, '{tag}' as tag, {version} as version,
 count(*) filter (where actual=1 and proba>={t}::double) as true_positives,
 count(*) filter (where actual=0 and proba>={t}::double) as false_positives,
 count(*) filter (where actual=1 and proba<{t}::double) as false_negatives,
 count(*) filter (where actual=0 and proba<{t}::double) as true_negatives from p group by all"""
        )
    tags = "[" + ",".join(f"'{t}'" for t in TAGS) + "]"
    return f"""m as (select *, {COMBO_SQL},
 ((version*10+list_position({tags}, tag))*1000+combination_id*10+fold)::bigint as record_id,
 '{{"layer": '||(combination_id%2)||'}}' as metadata,
 timestamp '2024-03-01 08:00:00' + to_hours(version::int) + to_minutes(fold::int) as created_at
 from ({" union all ".join(parts)}))"""


M = _m_sql()

RATES_SQL = """true_positives+false_positives+false_negatives+true_negatives as total_predictions,
 case when 2*true_positives+false_positives+false_negatives<>0 then (2*true_positives)::double/(2*true_positives+false_positives+false_negatives) else 0 end as f1,
 case when true_positives+false_negatives<>0 then false_negatives::double/(true_positives+false_negatives) else 0 end as fnr,
 case when true_negatives+false_positives<>0 then false_positives::double/(true_negatives+false_positives) else 0 end as fpr,
 case when fnr+fpr<>0 then 1.0::double/(fpr+fnr) else 100 end as fp_fn,
 case when true_positives+false_negatives<>0 then true_positives::double/(true_positives+false_negatives) else 0 end as tpr,
 case when true_negatives+false_positives<>0 then true_negatives::double/(true_negatives+false_positives) else 0 end as tnr,
 case when true_positives+false_positives+false_negatives+true_negatives<>0 then (true_positives+true_negatives)::double/(true_positives+false_positives+false_negatives+true_negatives) else 0 end as accuracy,
 tpr as sensitivity, tnr as specificity,
 case when true_positives+false_positives<>0 then true_positives::double/(true_positives+false_positives) else 0 end as ppv,
 case when true_negatives+false_negatives<>0 then true_negatives::double/(true_negatives+false_negatives) else 0 end as npv,
 true_positives+false_negatives as actual_positives, true_negatives+false_positives as actual_negatives"""

COUNTS_SQL = """count(*) filter (where actual=1 and predicted=1) as true_positives,
 count(*) filter (where actual=0 and predicted=1) as false_positives,
 count(*) filter (where actual=1 and predicted=0) as false_negatives,
 count(*) filter (where actual=0 and predicted=0) as true_negatives"""

# A: newest records with all rates (what the analysis table holds)
A = f"""a as (select *, {RATES_SQL} from (select * from m qualify row_number() over
 (partition by combination_id, tag, fold, metadata order by created_at desc, record_id desc)=1))"""


def analysis(spark, sf) -> DataFrame:
    from raresight.functions.metrics import rates
    from raresight.sources.catalog import latest_records

    m = latest_records(records(spark, sf), ["combination_id", "tag", "fold", "metadata"], "created_at", "record_id")
    m = m.withColumn(
        "total_predictions",
        F.col("true_positives") + F.col("false_positives") + F.col("false_negatives") + F.col("true_negatives"),
    )
    return m.withColumns(rates())


# ---- W: dirty text table ------------------------------------------------


def dirty(spark, sf) -> DataFrame:
    table(spark, sf, "events").createOrReplaceTempView("w_events")
    return spark.sql(_w("`", "string").replace("from events", "from w_events"))


def _w(q: str, text: str) -> str:
    def n(name):
        return f"{q}{name}{q}"

    return f"""select cast(event_id as {text}) as {n('Episode')},
 case when event_id%53=0 then null when event_id%47=0 then 'DERF Pending'
  when event_type='error' and value>=150 then 'CH' when event_type='signup' then 'Transient'
  else 'negative' end as {n('Definitive Diagnosis')},
 case when event_id%97=0 then 'Not Tested' when event_id%89=0 then 'abc' when event_id%83=0 then null
  when event_id%79=0 then '-12.5' when event_id%73=0 then '1e2' when event_id%71=0 then '5.'
  else cast(value as {text}) end as {n('TSH_I (RAW)')},
 case when event_id%4=0 then 'Male' when event_id%4=1 then 'Female' when event_id%4=2 then 'F'
  when event_id%8=3 then 'Ambiguous' else 'Unknown' end as {n('Sex')},
 cast(20+event_id%160 as {text}) as {n('Age at Collection (hr)')},
 case when event_id%19=0 then '0' else cast(250+user_id%50 as {text}) end as {n('Gestational Age (days)')},
 case when event_id%101=0 then '3.5' else cast(1500+event_id%2500 as {text}) end as {n('Birth Weight (g)')},
 case when event_id%3=0 then null when event_id%3=1 then 'A' else 'bb' end as {n('Multiple Birth Rank')},
 case when event_id%5=0 then 'Y' when event_id%5=1 then 'U' else 'No' end as {n('Transfusion Status')},
 case when event_id%7=0 then null when event_id%7=1 then 'FAS' else 'FA' end as {n('HGB Pattern_I (RAW)')},
 event_type as junk from events"""


W = "w as (" + _w('"', "varchar") + ")"

NUMERIC_RE = r"^[+-]?\d*\.?\d+(?:[eE][+-]?\d+)?$"

# mapped and cleaned form of W
CLEAN = rf"""c as (select "Episode" as episode,
 case when d is null then null when regexp_matches(d,'^(?:(CH))') then 1 when regexp_matches(d,'^(?:.*negative.*)') then 0
  when regexp_matches(d,'^(?:(Not Affected)$|(Transient)$|(Deceased)$)') then 0 end as definitive_diagnosis,
 case when regexp_matches(ga,'{NUMERIC_RE}') then abs(try_cast(case when regexp_matches(ga,'^[+-]?\d+$') then ga end as bigint)) end as gestational_age,
 case when regexp_matches(bw,'{NUMERIC_RE}') then abs(try_cast(case when regexp_matches(bw,'^[+-]?\d+$') then bw end as bigint)) end as birth_weight,
 case when regexp_matches("Sex",'^(?:.*(M|F).*)') then case when contains(lower("Sex"),'fe') then 0 else 1 end
  when regexp_matches("Sex",'^(?:.*(Ambiguous).*)') then 2 when regexp_matches("Sex",'^(?:.*(Unknown).*)') then 3 end as sex,
 case when regexp_matches(age,'{NUMERIC_RE}') and abs(age::double)>24 and abs(age::double)<168 then abs(age::double) end as age_at_collection,
 case when regexp_matches(ts,'^N') then 0 when regexp_matches(ts,'^Y') then 1 when regexp_matches(ts,'^U') then 0 end as transfusion_status,
 case when mbr is null then 0 when regexp_matches(mbr,'^[a-zA-Z]$') then 1 end as multiple_birth_rank,
 case when regexp_matches(tsh,'{NUMERIC_RE}') then abs(tsh::double) end as "TSH",
 case when hgb='FA' then 1 else 0 end as "HGB_Pattern"
 from (select *, "Definitive Diagnosis" as d, "TSH_I (RAW)" as tsh, "Age at Collection (hr)" as age,
  "Gestational Age (days)" as ga, "Birth Weight (g)" as bw, "Multiple Birth Rank" as mbr, "Transfusion Status" as ts,
  "HGB Pattern_I (RAW)" as hgb from w))"""


# ---- E: vectors ---------------------------------------------------------


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("case_index"),
        (F.col("label") == 5).cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


E = "e as (select vec_id as case_index, (label=5)::int as label, embedding::double[] as features from embeddings)"

# ---- K: many combinations with fnr and ppv ------------------------------


def combination_means(spark, sf) -> DataFrame:
    """240 combinations scored from the line items."""
    actual = F.col("l_returnflag") == "R"
    predicted = F.col("l_discount") >= 0.05
    g = (
        table(spark, sf, "lineitem")
        .groupBy((F.col("l_partkey") % 240).cast("int").alias("combination_id"))
        .agg(
            F.count_if(actual & predicted).alias("tp"),
            F.count_if(~actual & predicted).alias("fp"),
            F.count_if(actual & ~predicted).alias("fn"),
        )
    )
    raw = F.when(F.col("tp") + F.col("fn") != 0, F.col("fn") / (F.col("tp") + F.col("fn")).cast("double")).otherwise(0.0)
    ppv = F.when(F.col("tp") + F.col("fp") != 0, F.col("tp") / (F.col("tp") + F.col("fp")).cast("double")).otherwise(0.0)
    return g.select("combination_id", F.when(raw < 0.42, F.lit(0.0)).otherwise(raw).alias("fnr"), ppv.alias("ppv"))


K = """k as (select combination_id, case when raw<0.42 then 0 else raw end as fnr, ppv from (
 select combination_id, case when tp+fn<>0 then fn::double/(tp+fn) else 0 end as raw,
  case when tp+fp<>0 then tp::double/(tp+fp) else 0 end as ppv from (
  select (l_partkey%240)::int as combination_id,
   count(*) filter (where l_returnflag='R' and l_discount>=0.05) as tp,
   count(*) filter (where l_returnflag<>'R' and l_discount>=0.05) as fp,
   count(*) filter (where l_returnflag='R' and l_discount<0.05) as fn
  from lineitem group by 1)))"""


# ---- T: wide numeric table ----------------------------------------------

WIDE = ["quantity", "price", "discount", "tax", "total", "acctbal"]


def wide(spark, sf) -> DataFrame:
    li, o, c = (table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(c, o.o_custkey == c.c_custkey)
        .select(
            "l_orderkey",
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax"),
            F.col("o_totalprice").alias("total"),
            F.col("c_acctbal").alias("acctbal"),
            (F.col("l_returnflag") == "R").cast("int").alias("label"),
            F.col("l_linestatus").alias("status"),
        )
    )


T = """t as (select l_orderkey, l_quantity as quantity, l_extendedprice as price, l_discount as discount, l_tax as tax,
 o_totalprice as total, c_acctbal as acctbal, (l_returnflag='R')::int as label, l_linestatus as status
 from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey)"""

# ---- O: outcomes --------------------------------------------------------


def outcomes(spark, sf) -> DataFrame:
    w = dirty(spark, sf).select("Episode", "Definitive Diagnosis")
    n = F.col("Episode").cast("bigint")
    kept = w.where(n % 5 != 0)
    return kept.unionAll(kept.where(n % 37 == 0))


O = """o as (select "Episode","Definitive Diagnosis" from w where "Episode"::bigint%5<>0
 union all select "Episode","Definitive Diagnosis" from w where "Episode"::bigint%5<>0 and "Episode"::bigint%37=0)"""


def with_ctes(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


SP = with_ctes(S, P)
#: The votes combine ten models.
MEMBERS = list(range(1, 11))
SP10 = with_ctes(S, p_sql(len(MEMBERS)))
SPM = with_ctes(S, P, M)
SPMA = with_ctes(S, P, M, A)

# unanimous vote of every subset, the naive way: one row per (subset, case, member)
AND_SQL = """, sub as (select unnest(range(1,1024))::int as subset),
ands as (select subset, bit_count(subset)::int as model_count, tp, fp, fn,
  case when tp+fp<>0 then tp::double/(tp+fp) else 0 end as ppv, case when tp+fn<>0 then fn::double/(tp+fn) else 0 end as fnr from (
  select subset, count(*) filter (where v=1 and actual=1) as tp, count(*) filter (where v=1 and actual=0) as fp,
   count(*) filter (where v=0 and actual=1) as fn from (
   select subset, case_index, any_value(actual) as actual, min(predicted) as v from sub join p on (subset>>(combination_id-1))&1=1
   group by subset, case_index) group by subset)) """

_VOTE = "(" + "+".join(f"case when (subset>>{i})&1=1 then p{i} else 0.0::double end" for i in range(len(MEMBERS))) + ")/bit_count(subset)"


def _vote_grid() -> list[float]:
    out = [0.49]
    while out[-1] <= 2.0:
        out.append(out[-1] + 0.01)
    return out


GRID_SQL = "[" + ",".join(f"{x!r}::double" for x in _vote_grid()) + "]"

# mean normalised score of every subset and its best threshold
VOTE_SQL = f""", n as (select case_index, combination_id, actual, proba/max(proba) over (partition by combination_id) as x from p),
pv as (select case_index, max(actual) as actual, {", ".join(f"max(x) filter (where combination_id={i + 1}) as p{i}" for i in range(len(MEMBERS)))} from n group by 1),
sub as (select unnest(range(1,1024))::int as subset),
vt as (select subset, case_index, actual, {_VOTE} as vote from pv cross join sub),
th as (select subset, coalesce(list_max(list_filter({GRID_SQL}, lambda t: t<=min(vote) filter (where actual=1))), 0.49::double) as threshold from vt group by subset),
votes as (select subset, bit_count(subset)::int as model_count, threshold, tp, fp, fn,
 case when tp+fp<>0 then tp::double/(tp+fp) else 0 end as ppv, case when tp+fn<>0 then fn::double/(tp+fn) else 0 end as fnr from (
 select subset, any_value(threshold) as threshold, count(*) filter (where vote>=threshold and actual=1) as tp,
  count(*) filter (where vote>=threshold and actual=0) as fp, count(*) filter (where vote<threshold and actual=1) as fn
 from vt join th using(subset) group by subset)) """
