"""Queries over feature engineering and fold assignment."""

from pyspark.sql import functions as F

from raresight.functions.text import splitter_name
from raresight.operators import features as fe, folds

from .fixtures import FEATURES, S, T, WIDE, screening, wide, with_ctes

_RATIO_COLS = ["tsh", "f_k", "f_hour"]


def _inv(c):
    return f"case when {c}=0 then 0.0::double else 1.0::double/{c} end"


def _ratios_sql(cols, src, keep):
    parts = [f'{a} as "{a}"' if a == b else f'{a}*{_inv(b)} as "{a}/{b}"' for a in cols for b in cols]
    return f"select {', '.join(keep + parts)} from {src}"


def create_ratios(spark, sf):
    return fe.create_ratios(screening(spark, sf).select("case_index", *_RATIO_COLS), _RATIO_COLS)


def ratio_array(spark, sf):
    t = fe.ratio_array(wide(spark, sf).select("l_orderkey", *WIDE), WIDE)
    return t.select(F.round(F.aggregate("ratios", F.lit(0.0), lambda a, x: a + x), 3).alias("ratio_sum"), F.size("ratios").alias("n"))


def create_powers(spark, sf):
    s = screening(spark, sf).select("case_index", "tsh", "f_k", "err")
    two = fe.create_powers(s, 2, ["tsh", "err"])
    return fe.create_powers(two, 3, ["f_k"])


def feature_chain(spark, sf):
    return fe.feature_chain(screening(spark, sf), FEATURES, "label", feature_set=["tsh", "f_k"], ratios=True, powers=True)


def pca_by_class(spark, sf):
    """Per component: its length, and whether its share of the variance is that of the rows along it."""
    s, cols = screening(spark, sf), [*FEATURES, "label"]
    found = fe.pca_by_class(s, cols, "label")
    by_name = found.groupBy("population", "component", "explained").pivot("feature", cols).agg(F.first("loading"))
    loads = by_name.select("population", "component", "explained", *[F.col(c).alias(f"w_{c}") for c in cols])
    rows = s.withColumn("population", F.when(F.col("label") == 1, "Positive").otherwise("Negative")).join(loads, "population")
    along = sum((F.col(c) * F.col(f"w_{c}") for c in cols[1:]), F.col(cols[0]) * F.col(f"w_{cols[0]}"))
    norm = sum((F.col(f"w_{c}") ** 2 for c in cols[1:]), F.col(f"w_{cols[0]}") ** 2)
    total = sum((F.var_samp(c) for c in cols[1:]), F.var_samp(cols[0]))
    out = rows.groupBy("population", "component").agg(F.count(F.lit(1)).alias("cases"), F.round(F.sqrt(F.first(norm)), 6).alias("length"), (F.var_samp(along) / total).alias("share"), F.first("explained").alias("explained"))
    return out.select("population", "component", "cases", "length", (F.abs(F.col("share") - F.col("explained")) < 1e-6).alias("valid"))


def standard_scale(spark, sf):
    s = fe.standard_scale(screening(spark, sf), FEATURES)
    return s.select("case_index", *[F.round(c, 6).alias(c) for c in FEATURES])


def assemble_matrix(spark, sf):
    from pyspark.ml.functions import vector_to_array

    v = fe.assemble(screening(spark, sf), FEATURES).select("case_index", vector_to_array("features").alias("v"))
    return v.select("case_index", F.size("v").alias("width"), *[F.col("v")[i].alias(f"x{i}") for i in range(len(FEATURES))])


def _folds(spark, sf):
    return screening(spark, sf).select("case_index", "label")


def fold_stratified(spark, sf):
    return folds.stratified(_folds(spark, sf))


def fold_stratified_shuffled(spark, sf):
    return folds.stratified(_folds(spark, sf), seed=42)


def fold_stratified_fast(spark, sf):
    return folds.stratified_fast(_folds(spark, sf), seed=42)


def fold_repeated_stratified(spark, sf):
    return folds.repeated_stratified(_folds(spark, sf), k=5, repeats=2, seed=7)


def fold_kfold(spark, sf):
    return folds.kfold(_folds(spark, sf))


def fold_none(spark, sf):
    return folds.no_folds(_folds(spark, sf))


def cv_name(spark, sf):
    """Fold sizes stored under their splitter names."""
    s = _folds(spark, sf)
    out = None
    for name, df in (
        (splitter_name("StratifiedKFold", 5), folds.stratified_fast(s, seed=42)),
        (splitter_name("KFold", 5), folds.kfold(s)),
        (splitter_name(None), s.withColumn("fold", F.lit(0))),
    ):
        part = df.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).withColumn("cross_validator", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def u32(*parts):
    from .fixtures import u_parts

    return u_parts(*parts)


def _cnt(x, i, k=5):
    return f"greatest(0, floor(({x}-{i}+{k - 1})/{k}.0))"


def _strat_sql(order, name="fold"):
    cum = [" + ".join(f"({_cnt('s0+n', i)}-{_cnt('s0', i)})" for i in range(j + 1)) for j in range(4)]
    fold = " + ".join(f"(r>={c})::int" for c in cum)
    return f"""select case_index, label, ({fold})::int as {name} from (
 select case_index, label, row_number() over (partition by label order by {order})-1 as r from s) x
 join (select label, n, coalesce(sum(n) over (order by f rows between unbounded preceding and 1 preceding),0) as s0
  from (select label, count(*) as n, min(case_index) as f from s group by 1)) y using(label)"""


_KF = """select case_index, label, (case when r<(n%5)*(n//5+1) then r//(n//5+1) else (r-(n%5))//(n//5) end)::int as fold
 from (select case_index, label, row_number() over (order by case_index)-1 as r, count(*) over () as n from s)"""
_FAST = f"select case_index, label, floor({u32(repr('fast'), '42', 'case_index')}*5)::int as fold from s"


def _prod(*cols):
    return "*".join(f"coalesce({c},1.0::double)" for c in cols)


def _primary_sql():
    """The two strongest features per class, picked by the data itself."""
    med = " union all ".join(
        f"select '{pop}' as population, '{f}' as name, quantile_cont({f},0.5) as value from s {cond}"
        for pop, cond in (("all", ""), ("positive", "where label=1"), ("negative", "where label=0"))
        for f in FEATURES
    )
    return f"""md as ({med}), wr as (select c.population, c.name, case when o.value<>0 then abs((c.value-o.value)/o.value) when c.value<>0 then 'inf'::double end as w
 from md c join md o on o.population='all' and o.name=c.name where c.population<>'all'),
 top as (select population, name, row_number() over (partition by population order by w desc nulls last, name) as rank from wr)"""


def primary_weight_sums(spark, sf):
    """Row-wise total of the synthetic features with their count: names depend
    on the data, so the check is over values."""
    out = fe.primary_weight_features(screening(spark, sf), FEATURES, "label", 2, keep=["case_index"])
    names = [c for c in out.columns if c != "case_index"]
    pos, neg = fe.top_primary(screening(spark, sf), FEATURES, "label", 2)
    ordered = [f"{p}/{n}" for p in pos for n in neg]
    return out.select(
        "case_index",
        F.col(f"`{pos[1]}x{pos[0]}`").alias("pos_product"),
        F.col(f"`{neg[1]}x{neg[0]}`").alias("neg_product"),
        *[F.col(f"`{c}`").alias(f"ratio_{i}") for i, c in enumerate(ordered)],
        F.lit(len(names)).alias("n_features"),
    )


def _value(pop, rank):
    return "case (select name from top where population='%s' and rank=%d) %s end" % (pop, rank, " ".join(f"when '{f}' then {f}" for f in FEATURES))


def _fin(a, b):
    return f"case when {b}=0 then case when {a}=0 then 0.0::double else 3.4028234663852886e38::double end else {a}/{b} end"


QUERIES = {
    "create_ratios": (create_ratios, with_ctes(S) + _ratios_sql(_RATIO_COLS, "s", ["case_index"])),
    "ratio_array": (
        ratio_array,
        with_ctes(T)
        + "select round("
        + "+".join(a if a == b else f"{a}*({_inv(b)})" for a in WIDE for b in WIDE)
        + ",3) as ratio_sum, 36::int as n from t",
    ),
    "create_powers": (create_powers, with_ctes(S) + "select case_index, tsh*tsh as tsh, f_k*f_k*f_k as f_k, err*err as err from s"),
    "primary_weight_features": (
        primary_weight_sums,
        with_ctes(S)
        + ", "
        + _primary_sql()
        + f""", v as (select case_index, {_value('positive', 1)} as p1, {_value('positive', 2)} as p2, {_value('negative', 1)} as n1, {_value('negative', 2)} as n2 from s)
 select case_index, p2*p1 as pos_product, n2*n1 as neg_product, {_fin('p1', 'n1')} as ratio_0, {_fin('p1', 'n2')} as ratio_1, {_fin('p2', 'n1')} as ratio_2, {_fin('p2', 'n2')} as ratio_3,
 (select count(distinct x) from (select string_agg(name, 'x' order by rank desc) as x from top where rank<=2 group by population
   union all select a.name||'/'||b.name from top a join top b on a.population='positive' and b.population='negative' where a.rank<=2 and b.rank<=2))::int as n_features from v""",
    ),
    "feature_chain": (
        feature_chain,
        with_ctes(S)
        + f"""select case_index, label, tsh*tsh as tsh, (tsh*({_inv('f_k')}))*(tsh*({_inv('f_k')})) as "tsh/f_k", (f_k*({_inv('tsh')}))*(f_k*({_inv('tsh')})) as "f_k/tsh", f_k*f_k as f_k from s""",
    ),
    "pca_by_class": (pca_by_class, with_ctes(S) + "select case when label=1 then 'Positive' else 'Negative' end as population, component, count(*) as cases, 1.0::double as length, true as valid from s cross join (select unnest([0,1])::int as component) group by 1,2"),
    "standard_scale": (
        standard_scale,
        with_ctes(S)
        + "select case_index, "
        + ", ".join(f"round(({f}-m_{f})/s_{f},6) as {f}" for f in FEATURES)
        + " from s cross join (select "
        + ", ".join(f"avg({f}) as m_{f}, stddev_pop({f}) as s_{f}" for f in FEATURES)
        + " from s)",
    ),
    "assemble_matrix": (
        assemble_matrix,
        with_ctes(S) + "select case_index, 4::int as width, " + ", ".join(f"{f} as x{i}" for i, f in enumerate(FEATURES)) + " from s",
    ),
    "fold_stratified": (fold_stratified, with_ctes(S) + _strat_sql("case_index")),
    "fold_stratified_shuffled": (
        fold_stratified_shuffled,
        with_ctes(S) + _strat_sql(f"{u32(repr('shuffle'), '42', 'case_index')}, case_index"),
    ),
    "fold_stratified_fast": (fold_stratified_fast, with_ctes(S) + _FAST),
    "fold_repeated_stratified": (
        fold_repeated_stratified,
        with_ctes(S)
        + " union all ".join(
            f"select case_index, label, (fold+{r * 5})::int as fold from ({_strat_sql(u32(repr('shuffle'), str(7 + r), 'case_index') + ', case_index')})" for r in range(2)
        ),
    ),
    "fold_kfold": (fold_kfold, with_ctes(S) + _KF),
    "fold_none": (fold_none, with_ctes(S) + "select case_index, label, 0::int as fold, unnest(['train','test']) as side from s"),
    "cv_name": (
        cv_name,
        with_ctes(S)
        + f"""select 'StratifiedKFold_5' as cross_validator, fold, count(*) as n from ({_FAST}) group by fold
 union all select 'KFold_5', fold, count(*) from ({_KF}) group by fold union all select 'none', 0::int, count(*) from s""",
    ),
}
