"""The three neighbour plans against brute force, duplicates included."""

import numpy as np
import pytest

from raresight.operators import neighbors
from raresight.operators.neighbors import knn_join


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(a) for a in r]) for i, r in zip(ids, x)], "case_index bigint, features array<double>")


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(250, 4)), rng.normal(size=(150, 4)) + 6, np.tile(rng.normal(size=4), (150, 1))])
    return rng.permutation(len(x)), x


def brute(ids, x, q, k):
    out = {}
    for i in q:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


@pytest.mark.parametrize(
    "plan",
    [
        dict(),
        dict(broadcast_bytes=6_000),  # only the queries fit
        dict(broadcast_bytes=0, block_rows=40),
        dict(broadcast_bytes=0, block_rows=100_000),
    ],
)
@pytest.mark.parametrize("k", [1, 5])
def test_exact(spark, points, plan, k):
    ids, x = points
    q = np.arange(0, len(x), 7)
    got = knn_join(frame(spark, ids[q], x[q]), frame(spark, ids, x), k, **plan).toPandas()
    want = brute(ids, x, q, k)
    assert len(got) == len(q) * k
    for query, part in got.groupby("query"):
        assert part.sort_values("rank").neighbor.tolist() == want[query]


def test_vectors_go_to_searched_cells_only(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(30, 64)) * 0.1 + rng.normal(size=64) * 3 for _ in range(20)])
    ids, q, k = rng.permutation(len(x)), np.arange(0, len(x), 3), 4
    written = []

    def counted(df, cut=neighbors.truncate_lineage):
        out = cut(df)
        written.append((set(out.columns), out.count()))
        return out

    monkeypatch.setattr(neighbors, "truncate_lineage", counted)
    got = knn_join(frame(spark, ids[q], x[q]), frame(spark, ids, x), k, broadcast_bytes=0, block_rows=10).toPandas()
    want = brute(ids, x, q, k)
    assert len(got) == len(q) * k
    for query, part in got.groupby("query"):
        assert part.sort_values("rank").neighbor.tolist() == want[query]
    # a vector is written with its own row alone, everything else carries ids
    assert all(n <= len(x) for columns, n in written if "v" in columns)
    rounds = [n for columns, n in written if columns == {"id", "cell"}]
    [listed] = [n for columns, n in written if "turn" in columns]
    assert rounds[-1] == 0 and sum(rounds) <= listed


def test_queries_with_few_neighbours(spark):
    x = np.array([[0.0], [1.0], [50.0], [51.0], [51.0]])
    got = knn_join(frame(spark, range(5), x), frame(spark, range(5), x), 9, broadcast_bytes=0, block_rows=1).toPandas()
    assert got.groupby("query").neighbor.apply(set).to_dict() == {i: set(range(5)) - {i} for i in range(5)}
