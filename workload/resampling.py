"""Queries over the resamplers."""

from pyspark.sql import functions as F

from raresight.operators import resample as rs
from raresight.session import truncate_lineage

from .fixtures import E, FEATURES, S, screening, u_parts, vectors, with_ctes

RATIO = 0.5


def as_rows(s):
    """Screening rows with their features in one array."""
    return s.select("case_index", "label", F.array(*FEATURES).alias("features"))


def _rows(spark, sf):
    return as_rows(screening(spark, sf))


def _summary(df, digits=6):
    """Key, label, source and the plain sum of the features."""
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return df.select("case_index", "label", "source", F.round(total, digits).alias("feature_sum"))


def q(fn, source, **kw):
    def run(spark, sf):
        return _summary(fn(source(spark, sf), **kw))

    return run


def cluster_centroids(spark, sf):
    return rs.cluster_centroids(_rows(spark, sf), 0.02, k=8).select("case_index", "label", F.size("features").alias("d"))


def centroids_by_cell(spark, sf):
    """300 centres of the majority: their rows, how many lie within the range of all, and their weighted mean."""
    df = _rows(spark, sf).where("label = 0")
    made = truncate_lineage(rs.centroids_by_cell(df, 300))
    box = df.agg(*[f(F.col("features")[j]).alias(f"{n}{j}") for j in range(len(FEATURES)) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    inside = F.lit(True)
    for j in range(len(FEATURES)):
        inside = inside & F.col("features")[j].between(box[f"lo{j}"] - 1e-9, box[f"hi{j}"] + 1e-9)
    mean = [F.round(F.sum(F.col("features")[j] * F.col("n")) / F.sum("n"), 6).alias(f"mean{j}") for j in range(len(FEATURES))]
    return made.agg(F.count_distinct("i").alias("centres"), F.sum("n").alias("rows"), F.count_if(inside).alias("inside"), *mean)


def prototype_points(spark, sf):
    """Centres per fold that lie within the range of the rejected rows of their fold."""
    s = screening(spark, sf)
    df = s.select("case_index", "label", "fold", F.array(*FEATURES).alias("features"), (F.col("tsh") >= 150).cast("int").alias("predicted"))
    points = rs.prototypes(df, "predicted", k=8)
    box = df.where("predicted = 0").groupBy("fold").agg(*[f(F.col("features")[j]).alias(f"{n}{j}") for j in range(len(FEATURES)) for n, f in (("lo", F.min), ("hi", F.max))])
    inside = F.lit(True)
    for j in range(len(FEATURES)):
        inside = inside & F.col("features")[j].between(F.col(f"lo{j}") - 1e-9, F.col(f"hi{j}") + 1e-9)
    return points.join(box, "fold").groupBy("fold").agg(F.count_if(inside).alias("inside"), F.count_if(F.col("label") == 0).alias("negative"))


_FS = "(tsh+f_user+f_k+f_hour)"
_R = f"r as (select case_index, label, {_FS} as fs, tsh, f_user, f_k, f_hour from s)"
_CNT = "c as (select count(*) filter (where label=1) as m, count(*) filter (where label=0) as n from {src})"
_SRC = with_ctes(S, _R, _CNT.format(src="s"))
_ORIG = "select case_index, label, case_index as source, round(fs,6) as feature_sum from r"
# vectors: neighbours within the minority, and of minority rows among all rows
_V = (
    E,
    "c as (select count(*) filter (where label=1) as m, count(*) filter (where label=0) as n from e)",
    "mi as (select *, row_number() over (order by case_index)-1 as rank from e where label=1)",
    """nn as (select a.case_index as q, b.case_index as b, row_number() over (partition by a.case_index order by list_distance(a.features,b.features), b.case_index) as j
  from mi a join mi b on a.case_index<>b.case_index)""",
    """na as (select a.case_index as q, b.case_index as b, b.label, row_number() over (partition by a.case_index order by list_distance(a.features,b.features), b.case_index) as j
  from mi a join e b on a.case_index<>b.case_index)""",
)
_VORIG = "select case_index, label, case_index as source, round(list_sum(features),6) as feature_sum from e"


def _new_points(seeds, seed=0):
    """seeds(i, a, j) -> interpolated rows."""
    gap = u_parts("'gap'", str(seed), "i")
    return f"""select (-i-1)::bigint as case_index, 1::int as label, a as source,
 round(list_sum(list_transform(list_zip(x.features, y.features), lambda t: t[1]+g*(t[2]-t[1]))),6) as feature_sum
 from (select i, a, b, {gap} as g from ({seeds}) sd join nn on nn.q=sd.a and nn.j=sd.j) p join e x on x.case_index=p.a join e y on y.case_index=p.b"""


def _pick(tag, n, seed=0):
    return f"floor({u_parts(repr(tag), str(seed), 'i')}*{n})::bigint"


_NEED = f"(select floor({RATIO}*n)::bigint-m from c)"
_SMOTE_SEEDS = f"""select i, mi.case_index as a, k as j from (select i, {_pick('seed', '(select m from c)')} as rank, {_pick('nb', '5')}+1 as k
 from (select unnest(range({_NEED})) as i)) join mi using(rank)"""
_ADA = f"""select r+d as i, a from (select r, a, unnest(range(g::bigint)) as d from (
 select (sum(g) over (order by q) - g)::bigint as r, q as a, g from (
  select q, round_even((o/5.0::double)/((select sum((label=0)::int) from na where j<=5)/5.0::double)*{_NEED},0) as g
  from (select q, sum((label=0)::int) as o from na where j<=5 group by q)) where g>0))"""
_ADA_SEEDS = f"select i, a, {_pick('nb', '5')}+1 as j from ({_ADA})"
_DANGER = "dg as (select q as case_index, row_number() over (order by q)-1 as rank from (select q, sum((label=0)::int) as o from na where j<=10 group by q) where o*2>=10 and o<10)"
_BORDER_SEEDS = f"""select i, dg.case_index as a, k as j from (select i, {_pick('seed', '(select count(*) from dg)')} as rank, {_pick('nb', '5')}+1 as k
 from (select unnest(range({_NEED})) as i)) join dg using(rank)"""


def _gauss_sql(fr=0.5, noise=0.01, npr=2.0, seed=3):
    us = [u_parts("'col'", str(seed), "i", str(j)) for j in range(4)]
    n1 = [u_parts("'n1'", str(seed), "i", str(j)) for j in range(4)]
    n2 = [u_parts("'n2'", str(seed), "i", str(j)) for j in range(4)]
    share = int(fr * 4)
    cells = []
    for j, f in enumerate(FEATURES):
        before = "+".join(f"(u{g}<u{j} or (u{g}=u{j} and {g}<{j}))::int" for g in range(4) if g != j)
        cells.append(
            f"({f}+case when ({before})<{share} then sqrt(-2.0::double*ln(1.0::double-{n1[j]}))*cos(6.283185307179586::double*{n2[j]})*(s_{f}*{noise}::double) else 0.0::double end)"
        )
    return f"""select (-i-1)::bigint as case_index, 1::int as label, src as source, round({'+'.join(cells)},6) as feature_sum from (
 select i, q.case_index as src, {', '.join(FEATURES)}, {', '.join(f's_{f}' for f in FEATURES)}, {', '.join(f'{u} as u{j}' for j, u in enumerate(us))}
 from (select i, floor({u_parts("'src'", str(seed), 'i')}*(select m from c))::bigint as rank from (select unnest(range((select ceil(m*{npr})::bigint from c))) as i))
 join (select *, row_number() over (order by case_index)-1 as rank from r where label=1) q using(rank)
 cross join (select {', '.join(f'stddev_pop({f}) as s_{f}' for f in FEATURES)} from r where label=1))"""


_UNDER = u_parts("'under'", "0", "case_index")

QUERIES = {
    "resample_none": (q(rs.none, _rows), _SRC + _ORIG),
    "resample_random_over": (
        q(rs.random_over, _rows, ratio=0.02),
        _SRC
        + _ORIG
        + f""" union all select (-i-1)::bigint, 1::int, q.case_index, round(fs,6) from (select i, {_pick('over', '(select m from c)')} as rank from (
 select unnest(range((select greatest(0, floor(0.02::double*n)::bigint-m) from c))) as i)) join (select *, row_number() over (order by case_index)-1 as rank from r where label=1) q using(rank)""",
    ),
    "resample_random_under": (
        q(rs.random_under, _rows, ratio=0.02),
        _SRC
        + f"""select case_index, label, case_index as source, round(fs,6) as feature_sum from (select *, row_number() over (partition by label order by {_UNDER}, case_index) as k from r)
 where label=1 or k<=(select floor(m/0.02::double) from c)""",
    ),
    "resample_undersample_n": (
        q(rs.undersample_n, _rows, n=100),
        _SRC
        + f"""select case_index, label, case_index as source, round(fs,6) as feature_sum from (select *, row_number() over (partition by label order by {_UNDER}, case_index) as k from r)
 where label=1 or k<=100""",
    ),
    "resample_smote": (q(rs.smote, vectors, ratio=RATIO), with_ctes(*_V) + _VORIG + " union all " + _new_points(_SMOTE_SEEDS)),
    "resample_adasyn": (q(rs.adasyn, vectors, ratio=RATIO), with_ctes(*_V) + _VORIG + " union all " + _new_points(_ADA_SEEDS)),
    "resample_borderline_smote": (
        q(rs.borderline_smote, vectors, ratio=RATIO),
        with_ctes(*_V, _DANGER) + _VORIG + " union all " + _new_points(_BORDER_SEEDS),
    ),
    "resample_nearmiss": (
        q(rs.near_miss, vectors, ratio=RATIO),
        with_ctes(*_V)
        + f""", d as (select a.case_index, list_distance(a.features,b.features) as dist, row_number() over (partition by a.case_index order by list_distance(a.features,b.features), b.case_index) as j
  from e a join mi b on a.label=0), md as (select case_index, row_number() over (order by avg(dist), case_index) as k from d where j<=3 group by case_index)
 {_VORIG} where label=1 or case_index in (select case_index from md where k<=(select floor(m/{RATIO}) from c))""",
    ),
    "resample_tomek": (
        q(rs.tomek, vectors),
        with_ctes(E)
        + f""", f as (select q, b, la, lb from (select a.case_index as q, b.case_index as b, a.label as la, b.label as lb,
  row_number() over (partition by a.case_index order by list_distance(a.features,b.features), b.case_index) as j from e a join e b on a.case_index<>b.case_index) where j=1)
 {_VORIG} where case_index not in (select x.q from f x join f y on x.q=y.b and x.b=y.q where x.la=0 and x.lb=1)""",
    ),
    "resample_gaussian": (
        q(rs.gaussian, _rows, feature_ratio=0.5, noise_level=0.01, new_points_ratio=2.0, seed=3),
        _SRC + _ORIG + " union all " + _gauss_sql(),
    ),
    # keys, labels and width; the centres themselves are not SQL
    "resample_cluster_centroids": (
        cluster_centroids,
        _SRC + "select case_index, label, 4::int as d from r where label=1 union all select (-i-1)::bigint, 0::int, 4::int from (select unnest(range(8)) as i)",
    ),
    "centroids_by_cell": (
        centroids_by_cell,
        with_ctes(S)
        + "select least(300, (select count(*) from (select distinct tsh, f_user, f_k, f_hour from s where label=0))) as centres, count(*)::bigint as rows, least(300, (select count(*) from (select distinct tsh, f_user, f_k, f_hour from s where label=0))) as inside, "
        + ", ".join(f"round(avg({f}),6) as mean{j}" for j, f in enumerate(FEATURES))
        + " from s where label=0",
    ),
    "prototype_points": (prototype_points, with_ctes(S) + "select fold, least(8, count(*)) as inside, least(8, count(*)) as negative from s where tsh<150 group by fold"),
}
