"""Queries over scans and sinks."""

from pyspark.sql import functions as F

from raresight.functions.metrics import confusion_counts, classification_metrics
from raresight.session import scratch_path
from raresight.sources import catalog, tables

from .fixtures import (
    COUNTS_SQL, RATES_SQL, S, SP, SPM, SPMA, W, combination_columns, dirty, predictions, records, screening, with_ctes,
)

RUN_OLD, RUN_NEW = "2024-03-01_08-00-00", "2024-03-02_09-30-00"


def scan_csv(spark, sf):
    w = dirty(spark, sf)
    path = scratch_path(spark, "csv")
    tables.sink_csv(w, path)
    return tables.scan_csv(spark, path, w.schema)


def scan_multi_file(spark, sf):
    root = scratch_path(spark, "yearly")
    w = dirty(spark, sf)
    n = F.col("Episode").cast("bigint")
    tables.sink_csv(w.where(n % 2 == 0), f"{root}/20200101-20201231_measurements_a")
    tables.sink_csv(
        w.where(n % 2 == 1).withColumnRenamed("Episode", "Accession Number").drop("junk"),
        f"{root}/20210101-20211231_measurements_b",
    )
    tables.sink_csv(w.select("Episode"), f"{root}/notes")
    return tables.scan_matching_files(
        spark, root, r".*/\d{8}-\d{8}_measurements_[a-z]$", {"Accession Number": "Episode"}
    )


def sink_csv(spark, sf):
    s = screening(spark, sf)
    path = scratch_path(spark, "clean")
    tables.sink_csv(s, path)
    return tables.scan_csv(spark, path, s.schema)


def _stored(spark, sf, runs=(RUN_NEW,)):
    """P under its key for each run; the older run holds shifted scores."""
    p = predictions(spark, sf)
    p = p.withColumns(combination_columns(F.col("combination_id"))).withColumn("tag", F.lit("original_data"))
    out = None
    for run in runs:
        part = p.withColumn("run_ts", F.lit(run))
        if run == RUN_OLD:
            part = part.withColumn("predicted", F.lit(0))
        out = part if out is None else out.unionByName(part)
    return out


def _store(spark, sf, runs=(RUN_NEW,)):
    path = scratch_path(spark, "results")
    tables.save_results(_stored(spark, sf, runs), path)
    return path


def sink_partitioned_results(spark, sf):
    path = _store(spark, sf)
    # a re-run of one fold must replace, not duplicate
    again = _stored(spark, sf).where("fold = 1")
    tables.save_results(again, path)
    return tables.scan_results(spark, path).select("combination_id", "fold", "case_index", "actual", "predicted", "proba")


def scan_partitioned_latest(spark, sf):
    path = _store(spark, sf, (RUN_OLD, RUN_NEW))
    df = tables.scan_latest_results(spark, path, model="(RandomForest|LinearSVC)", resampler="none")
    return confusion_counts(df, ["model", "resampler", "run_ts", "fold"])


def scan_with_provenance(spark, sf):
    path = _store(spark, sf)
    df = tables.with_provenance(tables.scan_results(spark, path))
    return confusion_counts(df, ["cross_validator", "resampler", "model", "scorer", "tag", "source_fold"])


def scan_catalog_star(spark, sf):
    t = catalog.star_tables(records(spark, sf))
    for name, df in t.items():
        df.createOrReplaceTempView(f"cat_{name}")
    return spark.sql(
        """select c.model, c.resampler, c.scorer, r.tag, r.fold, r.version,
                  a.true_positives, a.false_positives, a.false_negatives, a.true_negatives
           from cat_record r join cat_combination c on r.combination_id = c.id
           join cat_analysis a on a.record_id = r.id
           join cat_model_data md on md.record_id = r.id
           join cat_record_data rd on rd.record_id = r.id"""
    )


def sink_record_versioned(spark, sf):
    path = scratch_path(spark, "records")
    m = records(spark, sf)
    catalog.append_records(m.where("version = 1"), path)
    catalog.append_records(m.where("version = 2"), path)
    return catalog.read_latest(spark, path).select("record_id", "combination_id", "tag", "fold", "version", "true_positives")


def _feature_sets(spark, sf):
    """Two writes per combination, the list depending on the records."""
    m = records(spark, sf).groupBy("combination_id", "version").agg(
        F.sum("true_positives").alias("tp"), F.max("created_at").alias("created_at")
    )
    names = F.when(F.col("version") == 1, F.array(F.lit("tsh"))).otherwise(
        F.when(F.col("combination_id") % 2 == 0, F.array(F.lit("tsh"), F.lit("f_k"))).otherwise(F.array(F.lit("tsh"), F.lit("f_hour")))
    )
    return m.select("combination_id", "version", F.to_json(names).alias("feature_set"), "created_at")


def upsert_feature_set(spark, sf):
    f = _feature_sets(spark, sf)
    cols = ["combination_id", "feature_set", "created_at"]
    out = catalog.upsert_feature_sets(f.where("version = 1").select(*cols), f.where("version = 2").select(*cols))
    return out.select("combination_id", "feature_set")


def load_feature_set(spark, sf):
    f = _feature_sets(spark, sf)
    cols = ["combination_id", "feature_set", "created_at"]
    sets = catalog.upsert_feature_sets(f.where("version = 1").select(*cols), f.where("version = 2").select(*cols))
    return catalog.select_features(screening(spark, sf), catalog.load_feature_set(sets, 4), keep=["case_index"])


def materialize_folds(spark, sf):
    path = scratch_path(spark, "folds")
    tables.materialize_folds(screening(spark, sf), path, "StratifiedKFold_5", 5)
    return (
        spark.read.parquet(path)
        .groupBy("cv", "fold", "side")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("positives"), F.sum("case_index").alias("keys"))
    )


def append_extra_train(spark, sf):
    s = screening(spark, sf).select("case_index", "fold", "tsh", "label")
    train = s.where("fold <> 2")
    extra = s.where("label = 1").withColumns({"case_index": -F.col("case_index") - 1, "tsh": F.col("tsh") + 1.0})
    return tables.append_extra_train(train, extra, 2)


def sink_report(spark, sf):
    df = classification_metrics(predictions(spark, sf), ["combination_id", "fold"])
    path = catalog.write_report(df, scratch_path(spark, "report"), RUN_NEW)
    return tables.scan_csv(spark, path, df.schema)


_W_ALL = with_ctes(W) + "select * from w"
_COMBO = """(['RandomForest','GradientBoosting','BalancedBagging','LinearSVC'])[((combination_id-1)%4+1)::int] as model,
 case when combination_id<=4 then 'none' else 'SMOTE' end as resampler"""

QUERIES = {
    "scan_csv": (scan_csv, _W_ALL),
    "scan_multi_file": (
        scan_multi_file,
        with_ctes(W) + """select * replace (case when "Episode"::bigint%2=0 then junk end as junk) from w""",
    ),
    "sink_csv": (sink_csv, with_ctes(S) + "select * from s"),
    "sink_partitioned_results": (sink_partitioned_results, SP + "select * from p"),
    "scan_partitioned_latest": (
        scan_partitioned_latest,
        SP
        + f"""select {_COMBO}, '{RUN_NEW}' as run_ts, fold, {COUNTS_SQL}, count(*) as total_predictions
 from p where combination_id in (1,4) group by combination_id, fold""",
    ),
    "scan_with_provenance": (
        scan_with_provenance,
        SP
        + f"""select {_COMBO}, 'StratifiedKFold_5' as cross_validator,
 case when combination_id%2=0 then 'recall_score' else 'f10_score_pos' end as scorer, 'original_data' as tag,
 fold as source_fold, {COUNTS_SQL}, count(*) as total_predictions from p group by combination_id, fold""",
    ),
    "scan_catalog_star": (
        scan_catalog_star,
        SPM
        + "select model, resampler, scorer, tag, fold, version, true_positives, false_positives, false_negatives, true_negatives from m",
    ),
    "sink_record_versioned": (
        sink_record_versioned,
        SPMA + "select record_id, combination_id, tag, fold, version, true_positives from a",
    ),
    "upsert_feature_set": (
        upsert_feature_set,
        SPM
        + """select distinct combination_id, case when combination_id%2=0 then '["tsh","f_k"]' else '["tsh","f_hour"]' end as feature_set from m""",
    ),
    "load_feature_set": (load_feature_set, with_ctes(S) + "select case_index, tsh, f_k from s"),
    "materialize_folds": (
        materialize_folds,
        with_ctes(S)
        + """select 'StratifiedKFold_5' as cv, f.fold::int as fold, case when s.fold=f.fold then 'test' else 'train' end as side,
 count(*) as n, sum(label)::bigint as positives, sum(case_index)::bigint as keys
 from s cross join (values (0),(1),(2),(3),(4)) f(fold) group by 1,2,3""",
    ),
    "append_extra_train": (
        append_extra_train,
        with_ctes(S)
        + """select case_index, fold, tsh, label from s where fold<>2
 union all select -case_index-1, fold, tsh+1.0, label from s where label=1 and fold=2""",
    ),
    "sink_report": (
        sink_report,
        SP + f"select *, {RATES_SQL} from (select combination_id, fold, {COUNTS_SQL} from p group by all)",
    ),
}
