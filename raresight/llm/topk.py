"""Exact top-k by inner product: term-at-a-time accumulation over sparse rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from raresight.llm.common import carried, cut

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 4096
#: A posting list over this share of a block is held as a dense column.
DENSE = 0.25
OUT = "query_id long, vec_id long, score long"


def _ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row lengths and values of a list column without nulls."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    if not len(lists):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = lists.offsets.to_numpy()
    return np.diff(offsets), lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]


def _pick(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest, ties to the earlier position."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate((above, np.flatnonzero(scores == least)[: k - len(above)]))


def accumulate(q_ids, q_len, q_terms, q_weights, c_ids, c_len, c_terms, c_weights, k: int):
    """Top ``k`` of a block of candidates for each query of a block: (query ids, ids, scores)."""
    order = np.argsort(c_ids, kind="stable")
    place = np.empty(len(c_ids), np.int64)
    place[order] = np.arange(len(order))
    rows = np.repeat(place, c_len)
    by_term = np.argsort(c_terms, kind="stable")
    terms, starts = np.unique(c_terms[by_term], return_index=True)
    ids, n = c_ids[order], len(c_ids)
    # a sum that could leave 64 bits is made with Python's integers and held at the limits
    most = lambda x: max((abs(int(v)) for v in (x.min(), x.max())), default=0) if len(x) else 0
    wide = most(q_weights) * most(c_weights) * max(1, min(int(q_len.max(initial=0)), int(c_len.max(initial=0)))) >= 2**62
    kind = object if wide else np.int64
    postings = {}
    for term, lo, hi in zip(terms.tolist(), starts, [*starts[1:], len(by_term)]):
        at, weight = rows[by_term[lo:hi]], c_weights[by_term[lo:hi]].astype(kind)
        if hi - lo >= DENSE * n:
            column = np.zeros(n, kind)
            column[at] = weight
            postings[term] = (None, column)
        else:
            postings[term] = (at, weight)
    out_q, out_c, out_s = [], [], []
    begin = np.concatenate(([0], np.cumsum(q_len)))
    for i, query in enumerate(q_ids.tolist()):
        scores = np.zeros(n, kind)
        for term, weight in zip(q_terms[begin[i] : begin[i + 1]].tolist(), q_weights[begin[i] : begin[i + 1]].tolist()):
            hit = postings.get(term)
            if hit is None:
                continue
            if hit[0] is None:
                scores += hit[1] * weight
            else:
                scores[hit[0]] += hit[1] * weight
        if wide:
            scores = np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in scores], np.int64)
        best = _pick(scores, k + 1)
        best = best[ids[best] != query]
        best = best[np.lexsort((ids[best], -scores[best].astype(object) if wide else -scores[best]))][:k]
        out_q.append(np.full(len(best), query, np.int64))
        out_c.append(ids[best])
        out_s.append(scores[best])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(out_q), cat(out_c), cat(out_s)


def search(queries: DataFrame, candidates: DataFrame, k: int, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) from sparse rows (id, terms array<int>, weights array<bigint>).

    Every query meets every candidate but itself, in blocks: both sides are cut by
    a hash of their id and a task holds one block of each, a dense score array and
    k results per query. Ties go to the smaller id; fewer candidates give fewer
    rows. Ids must be unique; sums beyond 64 bits are held at its limits.
    """
    queries, candidates = cut(queries), cut(candidates)
    n_q = -(-queries.count() // query_block) or 1
    n_c = -(-candidates.count() // candidate_block) or 1
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("q", block(n_q)).withColumn("c", every(n_c))
    right = candidates.withColumn("c", block(n_c)).withColumn("q", every(n_q))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        (q_len, q_terms), (c_len, c_terms) = _ragged(a["terms"]), _ragged(b["terms"])
        q, c, s = accumulate(a["id"].to_numpy(), q_len, q_terms, _ragged(a["weights"])[1], b["id"].to_numpy(), c_len, c_terms, _ragged(b["weights"])[1], k)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(c, pa.int64()), "score": pa.array(s, pa.int64())})

    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(cell, OUT)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def finite(vector: Column) -> Column:
    """Vectors that take part: not null, no null, NaN or infinite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)))


def sparse_rows(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, terms, weights): floor(scale * x) of each component, zeros left out.

    Rows with a null key or a vector that takes no part go; of rows with the same
    key the smallest vector counts.
    """
    good = vectors.where(F.col(key).isNotNull() & finite(F.col(vector)))
    one = good.groupBy(F.col(key).alias("id")).agg(F.min(F.col(vector).cast("array<double>")).alias("__v"))
    cells = F.transform("__v", lambda x, i: F.struct(i.alias("t"), F.floor(x * F.lit(float(scale))).alias("w")))
    kept = one.select("id", F.filter(cells, lambda x: x["w"] != 0).alias("__c"))
    return kept.select("id", F.col("__c.t").alias("terms"), F.col("__c.w").alias("weights"))


carried(__name__)
