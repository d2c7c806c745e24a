"""Helpers the operators share: lineage cuts, ranks over range partitions, task state."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from raresight.session import truncate_lineage

BATCH_BYTES = "2m"
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def carried(module: str) -> None:
    """Ship a module's functions with the tasks, so that workers need not import it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table."""
    return truncate_lineage(df)


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, of which the next join broadcasts neither side.

    For tables that grow with the input: Spark sizes a written table by its compressed
    file, and exploded rows by the rows they come from, so a small estimate may be
    more than the driver can hold.
    """
    return df.hint("merge")


def small_batches(spark) -> None:
    """Bound what a Python task is handed at once: texts can be long, and copies are made of a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_state(key: str, make: Callable):
    """A value that a Python worker makes once and keeps over its tasks."""
    store = sys.modules.setdefault("raresight_worker_state", types.ModuleType("raresight_worker_state"))
    if not hasattr(store, key):
        setattr(store, key, make())
    return getattr(store, key)


#: Values hashed at once, so few that they stay in a core's cache.
SEGMENT = 1 << 16
TURN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit words."""
    x = (x ^ (x >> np.uint64(32))) * TURN
    return x ^ (x >> np.uint64(29))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """64-bit hashes of runs of ``data``: a polynomial in the odd ``base`` by running sums, moved to a common origin and mixed."""

    def powers(x: int) -> np.ndarray:
        return np.concatenate(([np.uint64(1)], np.full(SEGMENT, x, np.uint64))).cumprod(dtype=np.uint64)

    up, down = worker_state(f"powers_{base}", lambda: (powers(base), powers(pow(base, -1, 1 << 64))))
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, lo + SEGMENT, "right")))
        if int(ends[stop - 1]) - lo > SEGMENT:  # one run longer than a segment
            out[at] = xxhash.xxh64_intdigest(data[lo : ends[at]].tobytes(), base & 0xFFFF)
            at += 1
            continue
        part = data[lo : ends[stop - 1]].astype(np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part + np.uint64(1)) * up[: len(part)], dtype=np.uint64)))
        s, e = starts[at:stop] - lo, ends[at:stop] - lo
        out[at:stop] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * TURN)
        at = stop
    return out


def own(df: DataFrame) -> list[Column]:
    """The columns of ``df`` whatever their names hold."""
    return [F.col(f"`{c}`") for c in df.columns]


def word_count(text: Column) -> Column:
    """Number of words; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def range_rank(df: DataFrame, order: list[Column], by: list[str] = (), name: str = "rank") -> DataFrame:
    """0-based position in ``order`` inside each ``by``, without a one-task window.

    Rows are range-partitioned by (by, order) and written, so that the partition
    number is fixed; partition counts give offsets. ``order`` must tell rows apart.
    """
    by = list(by)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(df.repartitionByRange(n, *by, *order).withColumn("__p", F.spark_partition_id()))
    counts = parts.groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*(by or [F.lit(0)])).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*by, "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = parts.withColumn("__r", F.row_number().over(W.partitionBy(*by, "__p").orderBy(*order)))
    return inside.join(offsets, [*by, "__p"]).withColumn(name, F.col("__off") + F.col("__r") - 1).drop("__p", "__r", "__off")


carried(__name__)
