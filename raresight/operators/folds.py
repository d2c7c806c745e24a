"""Fold assignment: stratified, shuffled, repeated, plain.

Rows are never ranked. A fold is a contiguous block of the ordered class, so
the k - 1 boundary keys per class are looked up as order statistics and the
assignment itself is a projection with literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import uniform
from .ordering import order_statistics


def allocation(n: int, start: int, k: int) -> list[int]:
    """Rows per fold of a class at positions start .. start + n - 1, position
    p belonging to fold p mod k."""

    def upto(x: int, i: int) -> int:
        return max(0, (x - i + k - 1) // k)

    return [upto(start + n, i) - upto(start, i) for i in range(k)]


def _block_column(order: Column, key: Column, cuts: list[tuple]) -> Column:
    """How many block starts lie at or before (order, key)."""
    fold = F.lit(0)
    for v, kv in cuts:
        after = (order > F.lit(v)) | ((order == F.lit(v)) & (key >= F.lit(kv)))
        fold = fold + F.when(after, F.lit(1)).otherwise(F.lit(0))
    return fold.cast("int")


def _starts(sizes: list[int]) -> list[int]:
    out, total = [], 0
    for s in sizes[:-1]:
        total += s
        out.append(total)
    return out


def _class_sizes(df: DataFrame, label: str, key: str) -> list[tuple]:
    """(class, rows) by first appearance: one row per class on the driver."""
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).collect()
    return [(r[label], r["n"]) for r in sorted(rows, key=lambda r: r["first"])]


def stratified(df: DataFrame, label: str = "label", key: str = "case_index", k: int = 5, seed: int | None = None, name: str = "fold", **options) -> DataFrame:
    """k folds that keep the class rate; ``seed`` shuffles inside the class."""
    order = "__order"
    work = df.withColumn(order, F.col(key) if seed is None else uniform("shuffle", seed, F.col(key)))
    targets, start = {}, 0
    sizes = _class_sizes(df, label, key)
    for cls, n in sizes:
        targets[(cls,)] = _starts(allocation(n, start, k))
        start += n
    found = order_statistics(work, order, targets, key=key, by=[label], **options)
    fold = None
    for cls, _ in sizes:
        at = found.get((cls,), {})
        cuts = [at[r] for r in targets[(cls,)] if r in at]
        # a start beyond the last row opens empty folds only
        column = _block_column(F.col(order), F.col(key), cuts)
        fold = F.when(F.col(label) == cls, column) if fold is None else fold.when(F.col(label) == cls, column)
    return work.withColumn(name, fold if fold is not None else F.lit(0)).drop(order)


def stratified_fast(df: DataFrame, key: str = "case_index", k: int = 5, seed: int = 0, name: str = "fold") -> DataFrame:
    """Hash folds: no pass over the data at all; class rates hold in expectation."""
    return df.withColumn(name, F.floor(uniform("fast", seed, F.col(key)) * k).cast("int"))


def repeated_stratified(df: DataFrame, label: str = "label", key: str = "case_index", k: int = 5, repeats: int = 2, seed: int = 0, **options) -> DataFrame:
    """Shuffled folds per repeat; fold id is repeat * k + fold."""
    out = df
    for r in range(repeats):
        out = stratified(out, label, key, k, seed + r, name=f"__f{r}", **options)
    cells = F.array(*[(F.col(f"__f{r}") + r * k) for r in range(repeats)])
    return out.withColumn("fold", F.explode(cells)).drop(*[f"__f{r}" for r in range(repeats)])


def kfold(df: DataFrame, key: str = "case_index", k: int = 5, name: str = "fold", **options) -> DataFrame:
    """Contiguous unstratified blocks; the first n mod k get one row more."""
    n = df.count()
    sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
    starts = _starts(sizes)
    found = order_statistics(df, key, {(): starts}, **options).get((), {})
    return df.withColumn(name, _block_column(F.col(key), F.col(key), [found[s] for s in starts if s in found]))


def no_folds(df: DataFrame, name: str = "fold") -> DataFrame:
    """Train and test are all rows: both sides of fold 0."""
    return df.withColumn(name, F.lit(0)).withColumn("side", F.explode(F.array(F.lit("train"), F.lit("test"))))


def split(df: DataFrame, fold: int, name: str = "fold") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(name) != fold), df.where(F.col(name) == fold)
