"""Ratios, powers, primary-weight features, scaling and PCA."""

from __future__ import annotations


from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.numeric import fdiv, finite32, nan_to_null, reciprocal_or_zero
from .ordering import exact_quantiles


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def create_ratios(df: DataFrame, columns: list[str] | None = None, keep: list[str] = ()) -> DataFrame:
    """All ordered pairs a/b as ``a * (1/b)`` with 1/0 = 0; a/a is a itself.

    One projection; columns not taking part follow unchanged.
    """
    cols = columns if columns is not None else [c for c in _numeric(df) if c not in keep]
    if len(cols) < 2:
        return df
    rest = [c for c in df.columns if c not in cols]
    out = [
        _q(a).cast("double").alias(a) if a == b else (_q(a).cast("double") * reciprocal_or_zero(_q(b))).alias(f"{a}/{b}")
        for a in cols
        for b in cols
    ]
    return df.select(*out, *[_q(c) for c in rest])


def ratio_array(df: DataFrame, columns: list[str], name: str = "ratios") -> DataFrame:
    """The same values row-major in one array: the wide-table form, where
    thousands of columns would outgrow code generation."""
    vals = F.array(*[_q(c).cast("double") for c in columns])
    work = df.withColumn("__v", vals).withColumn("__i", F.transform("__v", lambda b: reciprocal_or_zero(b)))
    rows = F.transform(
        "__v",
        lambda a, i: F.transform("__i", lambda inv, j: F.when(i == j, a).otherwise(a * inv)),
    )
    return work.withColumn(name, F.flatten(rows)).drop("__v", "__i")


def create_powers(df: DataFrame, power: int = 2, columns: list[str] = ()) -> DataFrame:
    """Replace the named columns by their power; small powers multiply, so
    whole numbers stay whole."""
    if not columns:
        raise ValueError("at least one column is needed")
    present = [c for c in columns if c in df.columns]

    def raised(c: str) -> Column:
        if power in (2, 3):
            out = _q(c)
            for _ in range(power - 1):
                out = out * _q(c)
            return out
        return F.pow(_q(c), F.lit(float(power)))

    return df.withColumns({c: raised(c) for c in present})


def power_set(names: list[str]) -> list[list[str]]:
    """All subsets; a later name comes first inside a subset."""
    out: list[list[str]] = []
    for bits in range(1 << len(names)):
        picked = [n for i, n in enumerate(names) if bits >> (len(names) - 1 - i) & 1]
        out.append(picked[::-1])
    return out


def class_medians(df: DataFrame, cols: list[str], label: str, **options) -> DataFrame:
    """Median per feature overall, of positives and of negatives."""
    whole = exact_quantiles(df, cols, [0.5], **options).withColumn("population", F.lit("all"))
    per = exact_quantiles(df, cols, [0.5], by=[label], **options).withColumn(
        "population", F.when(F.col(label) == 1, F.lit("positive")).otherwise(F.lit("negative"))
    )
    cols_out = ["population", "name", "value"]
    return whole.select(*cols_out).unionByName(per.select(*cols_out))


def primary_weight_rank(df: DataFrame, cols: list[str], label: str, **options) -> DataFrame:
    """|class median / median - 1| per class, largest first.

    The input has one row per (class, feature); the window is over features.
    """
    med = class_medians(df, cols, label, **options)
    base = med.where("population = 'all'").select("name", F.col("value").alias("base"))
    weight = nan_to_null(F.abs(fdiv(F.col("value") - F.col("base"), F.col("base"))))
    w = W.partitionBy("population").orderBy(F.col("weight").desc_nulls_last(), "name")
    return (
        med.where("population <> 'all'")
        .join(base, "name")
        .withColumn("weight", weight)
        .withColumn("rank", F.row_number().over(w))
        .select("population", "name", "weight", "rank")
    )


def top_primary(df: DataFrame, cols: list[str], label: str, top_n: int = 3, **options) -> tuple[list[str], list[str]]:
    """Names of the strongest features per class: a few driver-side strings."""
    rows = primary_weight_rank(df, cols, label, **options).where(F.col("rank") <= min(top_n, len(cols))).collect()

    def names(pop: str) -> list[str]:
        return [r["name"] for r in sorted((r for r in rows if r["population"] == pop), key=lambda r: r["rank"])]

    return names("positive"), names("negative")


def primary_weight_columns(pos: list[str], neg: list[str]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for names in (pos, neg):
        for subset in power_set(names):
            if len(subset) > 1:
                prod = None
                for c in subset:
                    # a missing factor counts as one
                    x = F.when(~F.isnan(_q(c).cast("double")), _q(c).cast("double"))
                    x = F.coalesce(x, F.lit(1.0))
                    prod = x if prod is None else prod * x
                out["x".join(subset)] = finite32(prod)
    for p in pos:
        for n in neg:
            out[f"{p}/{n}"] = finite32(fdiv(_q(p), _q(n)))
    return out


def primary_weight_features(
    df: DataFrame, cols: list[str], label: str, top_n: int = 3, keep: list[str] = (), fit_on: DataFrame | None = None, **options
) -> DataFrame:
    """Products of the strongest features per class and their cross ratios.

    ``fit_on`` chooses the rows the medians come from (the train side avoids
    the leak of using all rows).
    """
    pos, neg = top_primary(df if fit_on is None else fit_on, cols, label, top_n, **options)
    return df.select(*keep, *[c.alias(n) for n, c in primary_weight_columns(pos, neg).items()])


def feature_chain(
    df: DataFrame,
    cols: list[str],
    label: str,
    key: str = "case_index",
    feature_set: list[str] | None = None,
    primary: bool = False,
    ratios: bool = False,
    powers: bool = False,
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Stored feature set -> primary weights -> ratios -> powers, in order."""
    if feature_set:
        missing = [f for f in feature_set if f not in df.columns]
        if missing:
            raise ValueError(f"features not in the table: {missing}")
        cols = list(feature_set)
    keep = [key, label]
    out = df.select(*keep, *[_q(c) for c in cols])
    if primary:
        out = primary_weight_features(out, cols, label, keep=keep, fit_on=fit_on)
        cols = [c for c in out.columns if c not in keep]
    if ratios:
        out = create_ratios(out, cols)
        cols = [c for c in out.columns if c not in keep]
    if powers:
        out = create_powers(out, 2, cols)
    return out


def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population std; a constant column becomes zero."""
    stats = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = {}
    for i, c in enumerate(cols):
        m, s = stats[f"m{i}"], stats[f"s{i}"]
        scaled[c] = (_q(c) - F.lit(m)) / F.lit(s if s else 1.0)
    return df.withColumns(scaled)


def assemble(df: DataFrame, cols: list[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=output, handleInvalid="error").transform(df)


def pca_by_class(df: DataFrame, cols: list[str], label: str, k: int = 2) -> DataFrame:
    """Loadings per class and component; the largest loading is positive.

    A driver loop over the two classes; each fit is a distributed Gram matrix
    of d x d numbers.
    """
    rows = []
    for value, name in ((1, "Positive"), (0, "Negative")):
        part = df.where(F.col(label) == value)
        model = PCA(k=k, inputCol="__f", outputCol="__p").fit(assemble(part, cols, "__f"))
        m = model.pc.toArray()
        for comp in range(k):
            column = m[:, comp]
            sign = 1.0 if column[abs(column).argmax()] >= 0 else -1.0
            rows += [(name, comp, c, float(sign * column[i]), float(model.explainedVariance[comp])) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "population string, component int, feature string, loading double, explained double")


