"""Approximate nearest neighbours along shifted Hilbert curves of projected vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from raresight.llm.common import carried, cut, range_rank
from raresight.llm.topk import _ragged, finite

CURVES = 16
AXES, AXIS_BITS = 16, 3
#: A query looks at this share of the rows on either side of it on every curve, MIN_WINDOW at least.
WINDOW_SHARE = 0.03
MIN_WINDOW = 100
BLOCK = 4096
SEED = 7


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Order of integer points (n, axes) of ``bits`` bits along a Hilbert curve, as (n, words) 64-bit words.

    The coordinates are turned from the most significant bit down: where an axis
    has the bit, the lower bits of the first axis are inverted, elsewhere they
    trade places with the axis; a Gray decoding over the axes gives the order.
    """
    x = np.ascontiguousarray(cells.T.astype(np.uint32))
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        low = np.uint32((1 << level) - 1)
        for i in range(axes):
            has = (x[i] >> np.uint32(level)) & np.uint32(1) == 1
            swap = np.where(has, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(has, low, swap)
            x[i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint32(level)) & np.uint32(1) == 1, np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    stream = [(x[i] >> np.uint32(level)) & np.uint32(1) for level in range(bits - 1, -1, -1) for i in range(axes)]
    words = [np.zeros(x.shape[1], np.int64) for _ in range(-(-len(stream) // 63))]
    for at, bit in enumerate(stream):
        words[at // 63] = (words[at // 63] << 1) | bit.astype(np.int64)
    return np.stack(words, axis=1)


def curve_points(unit: np.ndarray, curve: int, axes: int, bits: int, seed: int) -> np.ndarray:
    """Cells of unit vectors on a curve: its own random projection, spread evenly, then shifted."""
    rng = np.random.default_rng([seed, curve])
    dims = unit.shape[1]
    direction = rng.standard_normal((max(dims, 1), axes))[:dims]
    direction /= np.maximum(np.linalg.norm(direction, axis=0), 1e-300)
    spread = 1 / (1 + np.exp(-1.702 * np.sqrt(max(dims, 1)) * (unit @ direction)))
    side = 1 << bits
    shift = rng.random(axes)
    return np.clip(np.floor(spread * (side - 1) + shift), 0, side - 1).astype(np.uint32)


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    lengths, values = _ragged(column)
    if len(lengths) and (lengths == dims).all():
        return values.reshape(-1, dims).astype(np.float64)
    out = np.zeros((len(lengths), dims))
    at = np.repeat(np.arange(len(lengths)), lengths)
    within = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[at, within] = values
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    # the largest component is taken out first: squares neither vanish nor overflow
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0), 1e-320)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def search(vectors: DataFrame, is_query, k: int, key: str = "vec_id", vector: str = "embedding", curves: int = CURVES, axes: int = AXES,
           bits: int = AXIS_BITS, share: float = WINDOW_SHARE, least: int = MIN_WINDOW, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest cosines found for rows where ``is_query``.

    Vectors null, zero or holding null or non-finite components, and null keys,
    take no part; shorter vectors count as filled up with zeros. Equal vectors are
    folded before the search and their smallest keys unfolded after it, so copies
    are found exactly and a common vector is one point. A repeated key is one row
    (its smallest vector). Ties go to the smaller key.
    """
    good = vectors.where(F.col(key).isNotNull() & finite(F.col(vector)) & F.exists(F.col(vector), lambda x: x != 0))
    rows = good.groupBy(F.col(key).alias("id")).agg(F.min(F.col(vector).cast("array<double>")).alias("v"))
    rows = cut(rows.withColumns({"h": F.xxhash64("v"), "is_query": is_query(F.col("id"))}))
    points = _fold(rows, k)
    n, dims = points.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    window = max(least, int(np.ceil(share * n)))
    keys = points.mapInArrow(_curve_rows(curves, axes, bits, seed, dims), "curve int, id long, asked boolean, k0 long, k1 long")
    placed = range_rank(keys, [F.col("k0"), F.col("k1"), F.col("id")], ["curve"], "at")
    placed = placed.select("curve", "at", "id", "asked").join(points.select("id", "v"), "id")
    placed = cut(placed)
    last = F.floor(F.lit(max(0, n - 1)) / F.lit(BLOCK))
    lo, hi = F.floor(F.greatest(F.col("at") - window, F.lit(0)) / BLOCK), F.least(F.floor((F.col("at") + window) / BLOCK), last)
    asked = placed.where("asked").withColumn("block", F.explode(F.sequence(lo, hi)))
    there = placed.withColumn("block", F.floor(F.col("at") / BLOCK))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, at = b["id"].to_numpy(), b["at"].to_numpy()
        q_ids, q_at = a["id"].to_numpy(), a["at"].to_numpy()
        out = [[], [], []]
        if len(ids) and len(q_ids):
            order = np.argsort(ids)
            ids, at = ids[order], at[order]
            units, q_units = _unit(_matrix(b["v"], dims))[order], _unit(_matrix(a["v"], dims))
            for begin in range(0, len(q_ids), 256):
                scores = q_units[begin : begin + 256] @ units.T
                far = np.abs(q_at[begin : begin + 256, None] - at[None, :]) > window
                scores[far | (q_ids[begin : begin + 256, None] == ids[None, :])] = -np.inf
                top = np.argpartition(-scores, k, axis=1)[:, : k + 1] if len(ids) > k + 1 else np.tile(np.arange(len(ids)), (len(scores), 1))
                value = np.take_along_axis(scores, top, 1)
                keep = value > -np.inf
                out[0].append(np.repeat(q_ids[begin : begin + 256], keep.sum(axis=1)))
                out[1].append(ids[top[keep]])
                out[2].append(value[keep])
        cat = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0), kind)
        return pa.table({"q": cat(out[0], pa.int64()), "c": cat(out[1], pa.int64()), "score": cat(out[2], pa.float64())})

    found = asked.groupBy("curve", "block").cogroup(there.groupBy("curve", "block")).applyInArrow(cell, "q long, c long, score double")
    pairs = found.groupBy("q", "c").agg(F.max("score").alias("score"))
    near = pairs.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "c"))).where(F.col("n") <= k + 1)
    return _unfold(cut(near.select("q", "c")), points, rows.where("is_query"), k, key)


def _fold(rows: DataFrame, k: int) -> DataFrame:
    """(id, v, h, ids, asked): equal vectors as one point with its k + 1 smallest ids."""
    salted = rows.withColumn("salt", F.pmod("id", F.lit(64)))
    first = F.row_number().over(W.partitionBy("h", "v", "salt").orderBy("id"))
    few = salted.withColumn("n", first).where(F.col("n") <= k + 1).groupBy("h", "v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))
    asked = rows.where("is_query").select("h", "v").distinct().withColumn("asked", F.lit(True))
    return cut(few.join(asked, ["h", "v"], "left").select(F.col("ids")[0].alias("id"), "v", "h", "ids", F.coalesce("asked", F.lit(False)).alias("asked")))


def _curve_rows(curves: int, axes: int, bits: int, seed: int, dims: int):
    def run(batches):
        for batch in batches:
            one = pa.Table.from_batches([batch])
            unit = _unit(_matrix(one["v"], dims))
            for curve in range(curves):
                words = hilbert_keys(curve_points(unit, curve, axes, bits, seed), bits)
                second = words[:, 1] if words.shape[1] > 1 else np.zeros(len(words), np.int64)
                yield pa.RecordBatch.from_pydict({"curve": pa.array(np.full(len(words), curve), pa.int32()), "id": one["id"].combine_chunks(), "asked": one["asked"].combine_chunks(), "k0": pa.array(words[:, 0]), "k1": pa.array(second)})

    return run


def _cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p * q, F.lit(0.0))), F.lit(0.0), lambda s, z: s + z)
    peak = lambda x: F.transform(x, lambda z: z / F.array_max(F.transform(x, F.abs)))
    a, b = peak(a), peak(b)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _unfold(near: DataFrame, points: DataFrame, queries: DataFrame, k: int, key: str) -> DataFrame:
    """Exact scores of the found points, then every copy of both sides, then the k best."""
    own = points.where("asked").select(F.col("id").alias("q"), F.col("id").alias("c"))
    q, c = points.select(F.col("id").alias("q"), F.col("v").alias("qv"), F.col("h")), points.select(F.col("id").alias("c"), F.col("v").alias("cv"), "ids")
    scored = near.union(own).distinct().join(q, "q").join(c, "c").withColumn("score", _cosine(F.col("qv"), F.col("cv")))
    each = scored.select("h", "qv", "score", F.explode("ids").alias("vec"))
    few = each.withColumn("n", F.row_number().over(W.partitionBy("h", "qv").orderBy(F.desc("score"), "vec"))).where(F.col("n") <= k + 1)
    lists = few.groupBy("h", "qv").agg(F.collect_list(F.struct("vec", "score")).alias("found"))
    joined = queries.join(lists, (queries.h == lists.h) & (queries.v == lists.qv)).select(queries.id.alias("query_id"), F.explode("found").alias("f"))
    others = joined.where(F.col("f.vec") != F.col("query_id")).select("query_id", F.col("f.vec").alias(key), F.col("f.score").alias("score"))
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), key))
    return others.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


carried(__name__)
