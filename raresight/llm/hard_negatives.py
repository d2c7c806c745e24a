"""Hard negatives by Four-Russians scoring: subset-sum tables of anchors, looked up by candidates' bit planes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from raresight.llm.common import carried, cut
from raresight.llm.topk import _pick, _ragged, finite

ANCHOR_BLOCK, CANDIDATE_BLOCK = 1024, 4096
#: Anchors and candidates scored in one step: the tables and sums of a step stay in a core's cache.
ANCHORS, ROWS = 128, 512
GROUP = 8
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 50, 95
PACKED = "id long, label long, bits int, planes binary"
_LEAST, _MOST = -(2**63), 2**63 - 1


def pack_planes(w: np.ndarray, bits: int) -> np.ndarray:
    """(rows, groups, planes) bytes of integers (rows, dims) in two's complement of ``bits`` bits: bit j of a byte is of dimension 8 * group + j."""
    n, dims = w.shape
    groups = -(-dims // GROUP)
    full = np.zeros((n, groups * GROUP), np.int64)
    full[:, :dims] = w
    full = full.reshape(n, groups, 1, GROUP)
    on = (full >> np.arange(bits, dtype=np.int64)[None, None, :, None]) & 1
    return np.packbits(on.astype(np.uint8), axis=3, bitorder="little")[..., 0]


def _bits(w: np.ndarray) -> np.ndarray:
    """Bits of two's complement that hold each row."""
    if not w.shape[1]:
        return np.ones(len(w), np.int64)
    top = np.where(w < 0, ~w, w).max(axis=1)
    return np.array([int(x).bit_length() + 1 for x in top], np.int64)


def _planes(batches):
    """Batches of (id, label, w) to PACKED rows."""
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        lengths, values = _ragged(rows["w"])
        begin = np.cumsum(lengths) - lengths
        out_bits, out = np.ones(len(lengths), np.int32), [b""] * len(lengths)
        for dims in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == dims)
            w = values[begin[mine, None] + np.arange(dims)[None, :]] if dims else np.zeros((len(mine), 0), np.int64)
            need = _bits(w)
            for bits in np.unique(need).tolist():
                some = np.flatnonzero(need == bits)
                packed = pack_planes(w[some], bits)
                for at, row in zip(mine[some].tolist(), packed):
                    out[at] = row.tobytes()
                out_bits[mine[some]] = bits
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out_bits), pa.array(out, pa.binary())], ["id", "label", "bits", "planes"])


def subset_sums(group: np.ndarray) -> np.ndarray:
    """(256, anchors): for each byte the sum of the anchors' weights (anchors, 8) at its bits."""
    table = np.zeros((1 << GROUP, len(group)), group.dtype)
    for j in range(GROUP):
        table[1 << j : 2 << j] = table[: 1 << j] + group[:, j]
    return table


class Candidates:
    """A block of packed rows in the order of their ids."""

    def __init__(self, rows: pa.Table):
        order = np.argsort(rows["id"].to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        self.id, self.label, self.bits = (rows[c].to_numpy() for c in ("id", "label", "bits"))
        planes = rows["planes"].to_pylist()
        sizes = np.array([len(x) for x in planes], np.int64)
        self.classes = []
        for size, bits in sorted(set(zip(sizes.tolist(), self.bits.tolist()))):
            mine = np.flatnonzero((sizes == size) & (self.bits == bits))
            packed = np.frombuffer(b"".join(planes[i] for i in mine.tolist()), np.uint8)
            self.classes.append((mine, packed.reshape(len(mine), size // bits, bits)))

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """(rows, anchors) full inner products with weights (anchors, 8 * groups).

        Plane by plane from the sign down: the sum is doubled and the looked-up
        subset sums are added. Sums that 64 bits might not hold are made with
        Python's integers and held at the limits.
        """
        most = max((abs(int(x)) for x in (anchors.min(), anchors.max())), default=0) if anchors.size else 0
        bound = most * anchors.shape[1] << int(self.bits.max(initial=1))
        kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**62 else object
        out = np.zeros((len(self.id), len(anchors)), kind)
        for g in range(anchors.shape[1] // GROUP):
            table = subset_sums(anchors[:, g * GROUP : (g + 1) * GROUP].astype(kind))
            for mine, packed in self.classes:
                if g >= packed.shape[1]:
                    continue
                for lo in range(0, len(mine), ROWS):
                    some = packed[lo : lo + ROWS, g]
                    total = -table.take(some[:, -1], axis=0)
                    for plane in range(some.shape[1] - 2, -1, -1):
                        total = total + total
                        total += table.take(some[:, plane], axis=0)
                    out[mine[lo : lo + ROWS]] += total
        if kind is object:
            out = np.array([max(_LEAST, min(_MOST, x)) for x in out.ravel().tolist()], np.int64).reshape(out.shape)
        return out.astype(np.int64)


def _anchor_steps(rows: pa.Table, candidates: Candidates):
    """(number of the anchor, its scores of all candidates), ``ANCHORS`` made at a time."""
    lengths, values = _ragged(rows["w"])
    begin = np.cumsum(lengths) - lengths
    for lo in range(0, len(lengths), ANCHORS):
        n, start = lengths[lo : lo + ANCHORS], begin[lo : lo + ANCHORS]
        w = np.zeros((len(n), -(-int(n.max(initial=0)) // GROUP) * GROUP), np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        w[owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)] = values[start[0] : start[-1] + n[-1]]
        scores = np.ascontiguousarray(candidates.scores(w).T)
        for i in range(len(n)):
            yield lo + i, scores[i]


def _found(columns: list[tuple[list, str]]) -> pa.Table:
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.table({name: pa.array(cat(values), pa.int64()) for values, name in columns})


def _best_of_label(k: int):
    """A cell's ``k`` best rows of each anchor's own label."""

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        rows, out = Candidates(b), ([], [], [])
        ids, labels = a["id"].to_numpy(), a["label"].to_numpy()
        of_label = {x: np.flatnonzero(rows.label == x) for x in np.unique(labels).tolist()}
        for i, scores in _anchor_steps(a, rows):
            mine = of_label[int(labels[i])]
            mine = mine[rows.id[mine] != ids[i]]
            best = mine[_pick(scores[mine], k)]
            for column, values in zip(out, (np.full(len(best), ids[i]), rows.id[best], scores[best])):
                column.append(values)
        return _found(list(zip(out, ("anchor_id", "positive_id", "positive_score"))))

    return cell


def _best_in_range(k: int, low: int, high: int):
    """A cell's ``k`` best rows of other labels for each score of a positive."""

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        rows, out = Candidates(b), ([], [], [], [])
        ids, labels, wanted = a["id"].to_numpy(), a["label"].to_numpy(), a["positives"].to_pylist()
        others = {x: np.flatnonzero(rows.label != x) for x in np.unique(labels).tolist()}
        for i, scores in _anchor_steps(a, rows):
            other = others[int(labels[i])]
            theirs = scores[other]
            for p in wanted[i]:
                least, most = -(-low * p // 100), high * p // 100
                if least > most:
                    continue
                near = np.flatnonzero((theirs >= max(_LEAST, least)) & (theirs <= most))
                best = near[_pick(theirs[near], k)]
                for column, values in zip(out, (np.full(len(best), ids[i]), np.full(len(best), p), rows.id[other[best]], theirs[best])):
                    column.append(values)
        return _found(list(zip(out, ("anchor_id", "positive_score", "negative_id", "negative_score"))))

    return cell


def labelled_rows(vectors: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(id, label, w): floor(scale * x) of each component; of rows with one key the smallest (label, vector)."""
    good = vectors.where(F.col(key).isNotNull() & label.isNotNull() & finite(F.col(vector)))
    one = good.groupBy(F.col(key).alias("id")).agg(F.min(F.struct(label.cast("long").alias("l"), F.col(vector).cast("array<double>").alias("v"))).alias("x"))
    return one.select("id", F.col("x.l").alias("label"), F.transform("x.v", lambda x: F.floor(x * F.lit(float(scale)))).alias("w"))


def mine(vectors: DataFrame, is_anchor, key: str = "vec_id", vector: str = "embedding", label: Column | None = None, scale: int = 256, positives: int = POSITIVES,
         negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, anchor_block: int = ANCHOR_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its best other rows of its label; each gets the best
    rows of other labels that score between ``low`` and ``high`` hundredths of it.
    Scores are exact integer inner products, missing components zero; ties go to the
    smaller key. Every anchor meets every row, in blocks: a task holds one block of
    either side. Null keys, labels and vectors and null or non-finite components
    take no part; rows of one key are one row, the smallest (label, vector).
    Anchors without positives, and positives without negatives, give no row.
    """
    label = F.col("label") if label is None else label
    rows = cut(labelled_rows(vectors, key, vector, label, scale))
    packed = cut(rows.mapInArrow(_planes, PACKED))
    anchors = rows.where(is_anchor(F.col("id")))
    n_a = -(-anchors.count() // anchor_block) or 1
    n_c = -(-rows.count() // candidate_block) or 1
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    there = packed.withColumn("c", block(n_c)).withColumn("q", every(n_a))

    def meet(asked: DataFrame, cell, out: str) -> DataFrame:
        left = asked.withColumn("q", block(n_a)).withColumn("c", every(n_c))
        return left.groupBy("q", "c").cogroup(there.groupBy("q", "c")).applyInArrow(cell, out)

    best = lambda df, by, score, to, k: df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), to))).where(F.col("rank") <= k)
    pairs = meet(anchors, _best_of_label(positives), "anchor_id long, positive_id long, positive_score long")
    pairs = cut(best(pairs, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"))
    scores = pairs.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("positives"))
    near = meet(anchors.join(scores, "id"), _best_in_range(negatives, low, high), "anchor_id long, positive_score long, negative_id long, negative_score long")
    few = best(near, ["anchor_id", "positive_score"], "negative_score", "negative_id", negatives)
    return pairs.join(few, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


carried(__name__)
