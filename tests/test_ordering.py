"""Bucketed ranks and quantiles against plain pandas, on both paths."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from raresight.operators import folds
from raresight.operators.ordering import _splits, exact_quantiles, keep_smallest, order_statistics, running_totals, with_rank


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    n = 3000
    v = rng.normal(size=n).round(2)
    v[: n // 3] = 0.25  # one value holds a third of the rows
    g = np.where(rng.random(n) < 0.9, 0, 1)
    return pd.DataFrame({"case_index": rng.permutation(n).astype("int64") * 7, "v": v, "g": g.astype("int64")})


@pytest.mark.parametrize("per", [None, 100])
@pytest.mark.parametrize("descending", [False, True])
def test_rank(spark, data, per, descending):
    got = with_rank(spark.createDataFrame(data), "v", "case_index", ["g"], descending=descending, rows_per_bucket=per).toPandas()
    want = data.sort_values(["v", "case_index"], ascending=[not descending, True])
    want["rank"] = want.groupby("g").cumcount()
    a = got.sort_values("case_index")[["case_index", "rank"]].to_numpy()
    b = want.sort_values("case_index")[["case_index", "rank"]].to_numpy()
    assert (a == b).all()


@pytest.mark.parametrize("per", [None, 100])
def test_order_statistics(spark, data, per):
    targets = {(0,): [0, 10, 900, 2500], (1,): [0, 5, 10**6]}
    got = order_statistics(spark.createDataFrame(data), "v", targets, "case_index", ["g"], rows_per_bucket=per)
    for (g,), ranks in targets.items():
        rows = data[data.g == g].sort_values(["v", "case_index"]).reset_index(drop=True)
        for r in ranks:
            if r < len(rows):
                assert got[(g,)][r] == (rows.v[r], rows.case_index[r])
            else:
                assert r not in got[(g,)]


@pytest.mark.parametrize("per", [None, 100])
@pytest.mark.parametrize("k", [0, 1, 700, 3000, 5000])
def test_keep_smallest(spark, data, per, k):
    got = keep_smallest(spark.createDataFrame(data), "v", k, "case_index", rows_per_bucket=per).toPandas()
    want = data.sort_values(["v", "case_index"]).head(k)
    assert set(got.case_index) == set(want.case_index)


def test_quantile_paths_agree(spark, data):
    df = data.assign(w=data.v * 3 + data.case_index)
    df.loc[::50, "w"] = np.nan
    sdf = spark.createDataFrame(df)
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    small = exact_quantiles(sdf, ["v", "w"], probs, ["g"]).toPandas()
    large = exact_quantiles(sdf, ["v", "w"], probs, ["g"], small_rows=0, rows_per_bucket=100).toPandas()
    keys = ["g", "name", "p"]
    a, b = (x.sort_values(keys).reset_index(drop=True) for x in (small, large))
    assert a[keys].equals(b[keys]) and a["value"].tolist() == b["value"].tolist()
    for (g, name), part in a.groupby(["g", "name"]):
        assert np.allclose(part["value"], df[df.g == g][name].quantile(probs).to_numpy())


@pytest.mark.parametrize("per", [None, 20])
def test_running_totals(spark, data, per):
    counts = data.groupby(["g", "v"]).size().rename("n").reset_index()
    got = running_totals(spark.createDataFrame(counts), "v", ["n"], ["g"], following=True, rows_per_bucket=per).toPandas()
    want = counts.sort_values("v", ascending=False)
    want["cum_n"] = want.groupby("g")["n"].cumsum()
    want["next_n"] = want.groupby("g")["n"].shift(-1)
    a = got.sort_values(["g", "v"])[["cum_n", "next_n"]].to_numpy(dtype=float)
    b = want.sort_values(["g", "v"])[["cum_n", "next_n"]].to_numpy(dtype=float)
    assert np.array_equal(a, b, equal_nan=True)


def test_heavy_value_gets_its_own_bucket():
    edges = _splits([1.0, 2.0, 2.0, 2.0, 3.0])
    assert edges[1:4] == [1.0, 2.0, np.nextafter(2.0, np.inf)]


@pytest.mark.parametrize("per", [None, 100])
@pytest.mark.parametrize("seed", [None, 5])
def test_stratified_folds(spark, data, per, seed):
    sdf = spark.createDataFrame(data.rename(columns={"g": "label"}))
    got = folds.stratified(sdf, seed=seed, rows_per_bucket=per).toPandas()
    assert len(got) == len(data) and set(got.fold) == set(range(5))
    for _, part in got.groupby("label"):
        sizes = part.groupby("fold").size()
        assert sizes.max() - sizes.min() <= 1
    if seed is None:
        for _, part in got.groupby("label"):
            assert part.sort_values("case_index").fold.is_monotonic_increasing
    # the same whatever the input order and partitioning
    again = folds.stratified(sdf.repartition(13).orderBy(F.rand(1)), seed=seed).toPandas()
    assert got.sort_values("case_index").fold.tolist() == again.sort_values("case_index").fold.tolist()


def test_folds_follow_the_position_rule():
    assert [sum(folds.allocation(7, 0, 3)), folds.allocation(7, 0, 3)] == [7, [3, 2, 2]]
    assert folds.allocation(4, 7, 3) == [1, 2, 1]


def test_tiny_classes(spark):
    sdf = spark.createDataFrame([(i, 1 if i == 3 else 0) for i in range(6)], "case_index bigint, label int")
    got = folds.stratified(sdf).toPandas()
    assert len(got) == 6 and got.fold.between(0, 4).all()


@pytest.mark.parametrize("per", [None, 3])
@pytest.mark.parametrize("descending", [False, True])
def test_null_orders_rank_first(spark, per, descending):
    rows = [(0, None), (1, 5.0), (2, 1.0), (3, None), (4, 5.0), (5, 2.0), (6, float("nan"))]
    got = with_rank(spark.createDataFrame(rows, "case_index bigint, v double"), "v", "case_index", descending=descending, rows_per_bucket=per)
    ranks = {r["case_index"]: r["rank"] for r in got.collect()}
    assert sorted(ranks.values()) == list(range(7)) and ranks[0] == 0 and ranks[3] == 1
    assert [i for i, _ in sorted(ranks.items(), key=lambda x: x[1])][2:] == ([1, 4, 5, 2, 6] if descending else [2, 5, 1, 4, 6])


def test_draws_have_52_bits(spark):
    from raresight.functions.numeric import uniform

    u = [r[0] for r in spark.range(2000).select(uniform("x", F.col("id"))).collect()]
    assert all(0 <= x < 1 for x in u) and sum((x * 2**32) % 1 != 0 for x in u) > 1900
