"""Threshold sweeps in one pass instead of one run per cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def cutoff_grid(start: float = 10.0, count: int = 151, per_unit: int = 10) -> list[float]:
    """``count`` evenly spaced cutoffs, ``per_unit`` of them to the unit, each the nearest double."""
    first = round(start * per_unit)
    return [(first + i) / per_unit for i in range(count)]


CUTOFFS = cutoff_grid()


def slot(value: Column, cutoffs: list[float]) -> Column:
    """Number of cutoffs at or below the value, for an even grid.

    The position is estimated by arithmetic and corrected by one comparison
    each way, so it agrees exactly with ``value >= cutoff``.
    """
    n = len(cutoffs)
    step = (cutoffs[-1] - cutoffs[0]) / (n - 1)
    cuts = F.array(*[F.lit(c) for c in cutoffs])
    guess = F.floor((F.least(F.greatest(value, F.lit(cutoffs[0])), F.lit(cutoffs[-1])) - cutoffs[0]) / step).cast("int")
    at = F.least(F.greatest(guess, F.lit(0)), F.lit(n - 1))
    below = F.element_at(cuts, at + 1)
    above = F.element_at(cuts, F.least(at + 2, F.lit(n)))
    inside = F.when(value < below, at).when((at + 1 < n) & (value >= above), at + 2).otherwise(at + 1)
    return F.when(value < cutoffs[0], F.lit(0)).when(value >= cutoffs[-1], F.lit(n)).otherwise(inside).cast("int")


def threshold_counts(df: DataFrame, value: str, label: str, by: list[str] | tuple = (), cutoffs: list[float] = CUTOFFS) -> DataFrame:
    """Confusion counts per cutoff for ``value >= cutoff``.

    Rows are counted per (slot, label), at most cutoffs + 1 slots per group;
    the reverse cumulative sum then runs over those counts only.
    """
    by = list(by)
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    per_slot = known.groupBy(*by, slot(F.col(value), cutoffs).alias("__slot")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    # a slot nobody fell into still needs its row
    cells = F.array(*[F.struct(F.lit(i + 1).alias("__slot"), F.lit(c).alias("cutoff")) for i, c in enumerate(cutoffs)])
    groups = per_slot.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    frame = groups.select(*by, "all_pos", "all_neg", F.explode(cells).alias("c")).select(*by, "all_pos", "all_neg", "c.*")
    filled = frame.join(per_slot, [*by, "__slot"], "left")
    w = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(F.col("__slot").desc())
    cum = w.rowsBetween(W.unboundedPreceding, 0)
    tp = F.sum(F.coalesce(F.col("pos"), F.lit(0))).over(cum).cast("bigint")
    fp = F.sum(F.coalesce(F.col("neg"), F.lit(0))).over(cum).cast("bigint")
    return filled.select(
        *by, "cutoff", tp.alias("true_positives"), fp.alias("false_positives"), "all_pos", "all_neg"
    ).select(
        *by,
        "cutoff",
        "true_positives",
        "false_positives",
        (F.col("all_pos") - F.col("true_positives")).cast("bigint").alias("false_negatives"),
        (F.col("all_neg") - F.col("false_positives")).cast("bigint").alias("true_negatives"),
    )
