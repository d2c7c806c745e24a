"""Queries over projections, filters and cleaning."""

from pyspark.sql import functions as F

from raresight.functions.text import combination_display_name, outcome_label, title_case
from raresight.operators import clean
from raresight.plans.preparation import prepare
from raresight.sources.catalog import metadata_filter

from .fixtures import (
    CLEAN, NUMERIC_RE, S, SP, SPMA, T, W, O, analysis, dirty, outcomes, predictions, screening, wide, with_ctes,
)

WC = with_ctes(W, CLEAN)
_MAPPED = """"Episode" as episode, "Definitive Diagnosis" as definitive_diagnosis, "TSH_I (RAW)" as "TSH", "Sex" as sex,
 "Age at Collection (hr)" as age_at_collection, "Gestational Age (days)" as gestational_age, "Birth Weight (g)" as birth_weight,
 "Multiple Birth Rank" as multiple_birth_rank, "Transfusion Status" as transfusion_status, "HGB Pattern_I (RAW)" as "HGB_Pattern\""""
_TEXT = """episode, definitive_diagnosis::double as definitive_diagnosis, gestational_age::double as gestational_age,
 birth_weight::double as birth_weight, sex, age_at_collection, transfusion_status, multiple_birth_rank::double as multiple_birth_rank, "TSH", "HGB_Pattern\""""
_COMPLETE = """f as (select * from c where coalesce(not("TSH"<14 and definitive_diagnosis=1), true)
 and definitive_diagnosis is not null and gestational_age is not null and birth_weight is not null and sex is not null
 and age_at_collection is not null and transfusion_status is not null and multiple_birth_rank is not null and "TSH" is not null)"""
WCF = with_ctes(W, CLEAN, _COMPLETE)


def _clean(spark, sf):
    return clean.clean_values(clean.map_names(dirty(spark, sf)))


def _complete(spark, sf):
    return clean.drop_incomplete(clean.drop_inconsistent_labels(_clean(spark, sf)))


def map_names(spark, sf):
    return clean.map_names(dirty(spark, sf))


def clean_rules(spark, sf):
    nullable = ["definitive_diagnosis", "gestational_age", "birth_weight", "multiple_birth_rank"]
    return _clean(spark, sf).withColumns({c: F.col(c).cast("double") for c in nullable})


def clean_numeric_default(spark, sf):
    w = dirty(spark, sf)
    return w.select("Episode", clean.rule_column(F.col("TSH_I (RAW)"), clean.DEFAULT_RULES).alias("TSH"))


def filter_label_consistency(spark, sf):
    df = clean.drop_inconsistent_labels(_clean(spark, sf), cutoff=200.0)
    return df.select("episode", "TSH", F.col("definitive_diagnosis").cast("double").alias("definitive_diagnosis"))


def drop_incomplete(spark, sf):
    return _complete(spark, sf)


def fill_label_default(spark, sf):
    w = dirty(spark, sf).select("Episode", "TSH_I (RAW)")
    joined = w.join(outcomes(spark, sf), "Episode", "left")
    return clean.fill_label_default(joined, "Definitive Diagnosis")


def derive_columns(spark, sf):
    df = clean.derive_columns(_complete(spark, sf))
    return df.select("episode", *clean.DERIVED)


def one_hot_multi(spark, sf):
    return clean.one_hot(_clean(spark, sf).select("episode", "sex"))


def narrow_integers(spark, sf):
    return clean.narrow_integers(screening(spark, sf).drop("fold"))


def split_x_y(spark, sf):
    return screening(spark, sf).select("tsh", "f_user", "f_k", "f_hour", "label")


def drop_derived(spark, sf):
    return clean.derive_columns(_complete(spark, sf)).drop("tsh_squared", "tsh_cubed", "weight_to_gestational_age", "weight_to_age_at_collection")


def select_numeric(spark, sf):
    t = wide(spark, sf)
    return t.select(*clean.numeric_columns(t))


def filter_metadata_regex(spark, sf):
    cond = metadata_filter(model="Forest|Bagging", tag="data$", resampler="^SM")
    return analysis(spark, sf).where(cond).select("combination_id", "tag", "fold", "fnr", "ppv")


def filter_in_list(spark, sf):
    return analysis(spark, sf).where(F.col("tag").isin("original_data", "all_features")).select("combination_id", "tag", "fold", "fnr")


def filter_range(spark, sf):
    return screening(spark, sf).where("tsh > 14 and tsh < 50").select("case_index", "tsh")


def lookup_by_index(spark, sf):
    keys = predictions(spark, sf).where("combination_id = 8 and actual = 1 and predicted = 0")
    return clean.rows_by_key(screening(spark, sf), keys, "case_index")


def lookup_by_episode(spark, sf):
    keys = screening(spark, sf).where("label = 1").select("episode")
    df = clean.rows_by_key(_clean(spark, sf), keys, "episode")
    return df.select("episode", F.col("definitive_diagnosis").cast("double").alias("definitive_diagnosis"))


def label_confusion(spark, sf):
    p = predictions(spark, sf)
    return p.select("combination_id", "case_index", outcome_label(F.col("predicted"), F.col("actual")).alias("outcome"))


def split_outcome_scenarios(spark, sf):
    p = predictions(spark, sf).where("combination_id = 7")
    p = p.select("case_index", outcome_label(F.col("predicted"), F.col("actual")).alias("outcome"))
    p = p.where(F.col("outcome") != "False Negative")
    return screening(spark, sf).select("case_index", "tsh", "f_user").join(p, "case_index")


def threshold_screen(spark, sf):
    s = screening(spark, sf)
    return s.select("case_index", F.col("label").alias("actual"), clean.threshold_screen(F.col("tsh"), 14.0).alias("predicted"))


def combo_display_name(spark, sf):
    return analysis(spark, sf).select("combination_id", combination_display_name(F.col("model"), F.col("resampler"), F.col("scorer")).alias("name")).distinct()


def title_case_names(spark, sf):
    """Every result name in title case with its number of rows."""
    a = analysis(spark, sf)
    names = F.explode(F.array(F.concat(F.lit("mean_fnr_"), F.col("scorer")), F.concat(F.lit("tsh_"), F.col("tag")), F.lit("false_neg"), F.lit("FPR")))
    return a.select(names.alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("n")).withColumn("shown", title_case(F.col("raw")))


def prepare_table(spark, sf):
    return prepare(dirty(spark, sf)).select("episode", "definitive_diagnosis", "TSH", "sex_male", "sex_female", "weight_to_gestational_age")


_TITLE = "array_to_string(list_transform(string_split(lower(raw),'_'), lambda x: upper(x[1])||x[2:]),' ')"

QUERIES = {
    "map_names": (map_names, with_ctes(W) + f"select {_MAPPED} from w"),
    "clean_rules": (clean_rules, WC + f"select {_TEXT} from c"),
    "clean_numeric_default": (
        clean_numeric_default,
        with_ctes(W)
        + f"""select "Episode", case when regexp_matches("TSH_I (RAW)",'{NUMERIC_RE}') then abs("TSH_I (RAW)"::double) end as "TSH" from w""",
    ),
    "filter_label_consistency": (
        filter_label_consistency,
        WC
        + """select episode, "TSH", definitive_diagnosis::double as definitive_diagnosis from c where coalesce(not("TSH"<200 and definitive_diagnosis=1), true)""",
    ),
    "drop_incomplete": (drop_incomplete, WCF + "select * from f"),
    "fill_label_default": (
        fill_label_default,
        with_ctes(W, O)
        + """select w."Episode", w."TSH_I (RAW)", coalesce(o."Definitive Diagnosis",'negative') as "Definitive Diagnosis" from w left join o using("Episode")""",
    ),
    "derive_columns": (
        derive_columns,
        WCF
        + """select episode, case when age_at_collection=0 then case when birth_weight>0 then 'inf'::double else 'nan'::double end else birth_weight::double/age_at_collection end as weight_to_age_at_collection,
 case when gestational_age=0 then case when birth_weight>0 then 'inf'::double else 'nan'::double end else birth_weight::double/gestational_age end as weight_to_gestational_age,
 "TSH"*"TSH" as tsh_squared, "TSH"*"TSH"*"TSH" as tsh_cubed from f""",
    ),
    "one_hot_multi": (
        one_hot_multi,
        WC + "select episode, case when sex in (0,2) then 1.0 else 0.0 end::double as sex_male, case when sex in (1,2) then 1.0 else 0.0 end::double as sex_female from c",
    ),
    "narrow_integers": (
        narrow_integers,
        with_ctes(S)
        + "select case_index, episode, tsh, f_user::bigint as f_user, f_k::bigint as f_k, f_hour::bigint as f_hour, err, label from s",
    ),
    "split_X_y": (split_x_y, with_ctes(S) + "select tsh, f_user, f_k, f_hour, label from s"),
    "drop_derived": (drop_derived, WCF + "select * from f"),
    "select_numeric": (select_numeric, with_ctes(T) + "select * exclude (status) from t"),
    "filter_metadata_regex": (
        filter_metadata_regex,
        SPMA
        + "select combination_id, tag, fold, fnr, ppv from a where regexp_matches(model,'Forest|Bagging') and regexp_matches(tag,'data$') and regexp_matches(resampler,'^SM')",
    ),
    "filter_in_list": (filter_in_list, SPMA + "select combination_id, tag, fold, fnr from a where tag in ('original_data','all_features')"),
    "filter_range": (filter_range, with_ctes(S) + "select case_index, tsh from s where tsh>14 and tsh<50"),
    "lookup_by_index": (
        lookup_by_index,
        SP + "select * from s where case_index in (select case_index from p where combination_id=8 and actual=1 and predicted=0)",
    ),
    "lookup_by_episode": (
        lookup_by_episode,
        with_ctes(S, W, CLEAN)
        + "select episode, definitive_diagnosis::double as definitive_diagnosis from c where episode in (select episode from s where label=1)",
    ),
    "label_confusion": (
        label_confusion,
        SP
        + """select combination_id, case_index, case when predicted=actual then case when predicted=1 then 'True Positive' else 'True Negative' end
 else case when predicted=1 then 'False Positive' else 'False Negative' end end as outcome from p""",
    ),
    "split_outcome_scenarios": (
        split_outcome_scenarios,
        SP
        + """select case_index, tsh, f_user, case when predicted=0 then 'True Negative' when actual=1 then 'True Positive' else 'False Positive' end as outcome
 from s join p using(case_index) where combination_id=7 and not (actual=1 and predicted=0)""",
    ),
    "threshold_screen": (threshold_screen, with_ctes(S) + "select case_index, label as actual, (tsh>=14)::int as predicted from s"),
    "combo_display_name": (
        combo_display_name,
        SPMA + "select distinct combination_id, model||chr(10)||resampler||chr(10)||scorer as name from a",
    ),
    "title_case": (
        title_case_names,
        SPMA
        + f"""select raw, count(*) as n, replace(replace(replace(replace({_TITLE},'Tsh','TSH'),'tsh','TSH'),'Fpr','FPR'),'Fnr','FNR') as shown
 from (select unnest(['mean_fnr_'||scorer,'tsh_'||tag,'false_neg','FPR']) as raw from a) group by raw""",
    ),
    "prepare_table": (
        prepare_table,
        WCF
        + """select episode, definitive_diagnosis, "TSH", (case when sex in (0,2) then 1 else 0 end)::bigint as sex_male, (case when sex in (1,2) then 1 else 0 end)::bigint as sex_female,
 birth_weight::double/gestational_age as weight_to_gestational_age from f where gestational_age<>0
 union all select episode, definitive_diagnosis, "TSH", (case when sex in (0,2) then 1 else 0 end)::bigint, (case when sex in (1,2) then 1 else 0 end)::bigint,
 'inf'::double from f where gestational_age=0""",
    ),
}
