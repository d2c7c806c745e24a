"""Exact k-nearest-neighbour join (Euclidean).

Three physical shapes, all exact, chosen by measured size:

* references fit in a broadcast: every task scores its queries against them;
* queries fit in a broadcast: every task scores its references, keeps k per
  query, and the partial lists are merged by a top-k window;
* neither fits: copies of one vector are folded into one row first, so a group
  of copies of any size costs one search. Both sides are then cut into Voronoi
  cells of sampled pivots, cells into blocks of bounded size. A first pass over
  each query's own cell gives an upper bound of its k-th distance. The cells that
  the triangle inequality cannot exclude are listed by id alone and visited
  nearest first, twice as many in each round; every round shrinks the bound, so
  a vector is only sent to the cells that are really searched.

Ties are broken by ``case_index``.
"""

from __future__ import annotations

import math
import sys
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.numeric import uniform
from ..session import truncate_lineage

# the block functions travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_ROWS = 20_000
SCHEMA = "query bigint, neighbor bigint, dist double"


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64) if len(col) else np.zeros((0, 0))


def _top_k(qid, q, rid, r, k: int, exclude_self: bool, chunk: int = 256) -> Iterator[pd.DataFrame]:
    """k nearest references of each query in this block pair.

    A matrix product ranks all pairs; those within its rounding error of the
    k-th are measured again by differences, so equal rows tie exactly.
    """
    if not len(qid) or not len(rid):
        return
    rr = np.einsum("ij,ij->i", r, r)
    for s in range(0, len(qid), chunk):
        qs, ids = q[s : s + chunk], qid[s : s + chunk]
        qq = np.einsum("ij,ij->i", qs, qs)
        d2 = qq[:, None] + rr[None, :] - 2.0 * (qs @ r.T)
        if exclude_self:
            d2[ids[:, None] == rid[None, :]] = np.inf
        m = min(k, d2.shape[1])
        kth = np.partition(d2, m - 1, axis=1)[:, m - 1]
        slack = 1e-10 * (qq + rr.max()) + 1e-12
        qi, ri = np.nonzero(d2 <= (kth + slack)[:, None])
        ok = np.isfinite(d2[qi, ri])
        qi, ri = qi[ok], ri[ok]
        diff = qs[qi] - r[ri]
        dist = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        order = np.lexsort((rid[ri], dist, qi))
        qi, ri, dist = qi[order], ri[order], dist[order]
        first = np.searchsorted(qi, qi, side="left")
        keep = np.arange(len(qi)) - first < k
        yield pd.DataFrame({"query": ids[qi[keep]], "neighbor": rid[ri[keep]], "dist": dist[keep]})


def _merge(parts: DataFrame, k: int) -> DataFrame:
    """Best k per query; the rank filter is also applied before the shuffle."""
    w = W.partitionBy("query").orderBy("dist", "neighbor")
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _side(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def _bytes(n: int, dim: int) -> int:
    return n * (8 * dim + 8)


def _collect_side(df: DataFrame):
    """Driver copy of a side whose size was checked before."""
    pdf = df.toPandas()
    return pdf["id"].to_numpy(dtype=np.int64), _matrix(pdf["v"])


def knn_join(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    key: str = "case_index",
    vector: str = "features",
    exclude_self: bool = True,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query, neighbor, dist, rank) with rank 1..k."""
    q, r = _side(queries, key, vector), _side(refs, key, vector)
    spark = queries.sparkSession
    stats = [d.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first() for d in (q, r)]
    (nq, dq), (nr, dr) = [(s["n"], s["d"] or 1) for s in stats]
    if _bytes(nr, dr) <= min(broadcast_bytes, max(_bytes(nq, dq), 1 << 20)) or (
        _bytes(nr, dr) <= broadcast_bytes and _bytes(nq, dq) > broadcast_bytes
    ):
        shared = spark.sparkContext.broadcast(_collect_side(r))

        def against_refs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rid, rv = shared.value
            for pdf in batches:
                if len(pdf):
                    yield from _top_k(pdf["id"].to_numpy(dtype=np.int64), _matrix(pdf["v"]), rid, rv, k, exclude_self)

        return _merge(q.mapInPandas(against_refs, SCHEMA), k)
    if _bytes(nq, dq) <= broadcast_bytes:
        shared = spark.sparkContext.broadcast(_collect_side(q))

        def against_queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qid, qv = shared.value
            for pdf in batches:
                if len(pdf):
                    yield from _top_k(qid, qv, pdf["id"].to_numpy(dtype=np.int64), _matrix(pdf["v"]), k, exclude_self)

        return _merge(r.mapInPandas(against_queries, SCHEMA), k)
    return _distinct_join(q, r, k, exclude_self, block_rows)


def _distinct_join(q: DataFrame, r: DataFrame, k: int, exclude_self: bool, block_rows: int) -> DataFrame:
    """Search among distinct vectors, then give every row its neighbours.

    A vector stands for its copies under their smallest id. The k nearest rows
    lie within the k nearest vectors, as each vector holds a row; one more is
    kept because the row itself may be among them.
    """
    kk = k + 1 if exclude_self else k
    w = W.partitionBy("v").orderBy("id")
    # the rank filter also runs before the shuffle: at most kk copies leave a task
    heads = r.withColumn("n", F.row_number().over(w)).where(F.col("n") <= kk)
    refs = truncate_lineage(heads.groupBy("v").agg(F.min("id").alias("id"), F.collect_list("id").alias("ids")))
    asked = truncate_lineage(q.groupBy("v").agg(F.min("id").alias("id")))
    found = _cell_join(asked, refs.select("id", "v"), kk, refs.count(), False, block_rows)
    rows = found.join(refs.select(F.col("id").alias("neighbor"), "ids"), "neighbor").select(
        F.col("query").alias("rep"), F.explode("ids").alias("neighbor"), "dist"
    )
    best = truncate_lineage(_merge(rows.withColumnRenamed("rep", "query"), kk).drop("rank").withColumnRenamed("query", "rep"))
    owners = q.join(asked.select("v", F.col("id").alias("rep")), "v").select(F.col("id").alias("query"), "rep")
    out = owners.join(best, "rep").select("query", "neighbor", "dist")
    return _merge(out.where(F.col("query") != F.col("neighbor")) if exclude_self else out, k)


def _cell_join(q: DataFrame, r: DataFrame, k: int, nr: int, exclude_self: bool, block_rows: int) -> DataFrame:
    spark = q.sparkSession
    n_pivots = max(2, min(1024, math.ceil(math.sqrt(nr / block_rows) * 4)))
    # pivots only steer pruning; the smallest hashes make the choice repeatable
    picked = r.orderBy(uniform("pivot", F.col("id")), "id").limit(n_pivots).select("v").toPandas()
    pivots = np.unique(_matrix(picked["v"]), axis=0)
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["v"])
                d = np.sqrt(np.maximum(((x[:, None, :] - p[None, :, :]) ** 2).sum(-1), 0.0)) if len(x) * p.size < 5e7 else np.sqrt(
                    np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T, 0.0)
                )
                yield pdf.assign(cell=d.argmin(1).astype("int32"), pd=d.min(1))

    with_cell = "id bigint, v array<double>, cell int, pd double"
    qc = truncate_lineage(q.mapInPandas(assign, with_cell))
    rc = truncate_lineage(r.mapInPandas(assign, with_cell))
    # per cell: radius and size; at most n_pivots rows on the driver
    info = {
        x["cell"]: (x["radius"], x["n"])
        for x in rc.groupBy("cell").agg(F.max("pd").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    }
    qn = {x["cell"]: x["n"] for x in qc.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    r_blocks = {c: max(1, math.ceil(n / block_rows)) for c, (_, n) in info.items()}
    rb_expr = F.element_at(F.create_map(*[F.lit(x) for c, b in r_blocks.items() for x in (c, b)]), F.col("cell"))
    refs = rc.withColumn("rb", F.pmod(F.xxhash64("id"), rb_expr).cast("int")).select("id", "v", "cell", "rb")

    def visit(wanted: DataFrame, per_cell: dict[int, int]) -> DataFrame:
        """wanted(id, v, cell): each query meets every block of its cell.

        Queries of a cell are cut into chunks, references are copied once per
        chunk, so no group holds more than block_rows of either side.
        """
        chunks = {c: max(1, math.ceil(per_cell.get(c, 0) / block_rows)) for c in r_blocks}
        qb = F.element_at(F.create_map(*[F.lit(x) for c, b in chunks.items() for x in (c, b)]), F.col("cell"))
        left = wanted.withColumn("qb", F.pmod(F.xxhash64("id", "cell"), qb).cast("int")).withColumn(
            "rb", F.explode(F.sequence(F.lit(0), (rb_expr - 1).cast("int")))
        )
        right = refs.where(F.col("cell").isin([c for c in per_cell])).withColumn(
            "qb", F.explode(F.sequence(F.lit(0), (qb - 1).cast("int")))
        )

        def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = (
                list(
                    _top_k(a["id"].to_numpy(dtype=np.int64), _matrix(a["v"]), b["id"].to_numpy(dtype=np.int64), _matrix(b["v"]), k, exclude_self)
                )
                if len(a) and len(b)
                else []
            )
            return pd.concat(out) if out else pd.DataFrame({"query": [], "neighbor": [], "dist": []})

        keys = ["cell", "rb", "qb"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, SCHEMA)

    own = [c for c in qn if c in info]
    first = truncate_lineage(_merge(visit(qc.where(F.col("cell").isin(own)).select("id", "v", "cell"), {c: qn[c] for c in own}), k).drop("rank"))
    radius = {c: rad for c, (rad, _) in info.items()}

    def bounds(best: DataFrame) -> DataFrame:
        """(id, bound): the k-th distance so far; queries with fewer than k found are left out."""
        found = best.groupBy(F.col("query").alias("id")).agg(F.count(F.lit(1)).alias("found"), F.max("dist").alias("bound"))
        return found.where(F.col("found") >= k).drop("found")

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells whose lower bound |q - pivot| - radius is within the bound, by turns from the nearest."""
        p = shared.value
        cells = np.array(sorted(radius), dtype=np.int32)
        rad = np.array([radius[c] for c in cells])
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf["v"])
            d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p[cells] ** 2).sum(1)[None, :] - 2 * x @ p[cells].T, 0.0))
            low = d - rad[None, :] - 1e-6 * (1.0 + d + rad[None, :])
            open_ = (low <= pdf["bound"].fillna(math.inf).to_numpy()[:, None]) & (cells[None, :] != pdf["own"].to_numpy()[:, None])
            order = np.argsort(np.where(open_, low, math.inf), axis=1, kind="stable")
            qi, turn = np.nonzero(np.take_along_axis(open_, order, axis=1))
            ci = order[qi, turn]
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[qi], "cell": cells[ci], "low": low[qi, ci], "turn": turn.astype("int32")})

    asked = qc.join(bounds(first), "id", "left").select("id", "v", F.col("cell").alias("own"), "bound")
    routes = truncate_lineage(asked.mapInPandas(route, "id bigint, cell int, low double, turn int"))
    best, turn, width = first, 0, 1
    while True:
        # lower bounds rise with the turn and the bound only shrinks: a round without an open cell is the last
        open_now = routes.where((F.col("turn") >= turn) & (F.col("turn") < turn + width)).join(bounds(best), "id", "left")
        wanted = truncate_lineage(open_now.where(F.col("bound").isNull() | (F.col("low") <= F.col("bound"))).select("id", "cell"))
        per_cell = {x["cell"]: x["n"] for x in wanted.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not per_cell:
            return _merge(best, k)
        near = visit(wanted.join(qc.select("id", "v"), "id"), per_cell)
        best = truncate_lineage(_merge(best.unionByName(near), k).drop("rank"))
        turn, width = turn + width, 2 * width
