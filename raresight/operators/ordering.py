"""Exact ranks, order statistics and running totals without a one-task window.

A window without a partition key, or over a class holding most rows, sends
everything to one task. Here the ordering key is first cut into monotone
buckets (sketch quantiles, about ``ROWS_PER_BUCKET`` rows each), bucket totals
give exact offsets, and the window runs inside one bucket only. A single value
held by many rows gets a bucket of its own, cut further by the tie key.
"""

from __future__ import annotations

import bisect
import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 1 << 16  # 6.5e10 rows; beyond them a bucket's sort grows and spills
BROADCAST_ROWS = 200_000


def bounded_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast only when the known row count is under the limit."""
    return F.broadcast(df) if rows <= limit else df


def _splits(quantiles: list[float]) -> list[float]:
    """Bucket edges; a repeated quantile is a heavy value and is isolated."""
    edges: list[float] = []
    for i, q in enumerate(quantiles):
        if i and q == quantiles[i - 1]:
            nxt = math.nextafter(q, math.inf)
            if edges and edges[-1] != nxt:
                edges.append(nxt)
        elif not edges or q > edges[-1]:
            edges.append(q)
    inner = [e for e in edges if math.isfinite(e)]
    return [-math.inf] + inner + [math.inf]


def bucket_count(n: int, rows_per_bucket: int | None = None) -> int:
    per = rows_per_bucket or ROWS_PER_BUCKET
    return max(1, min(MAX_BUCKETS, math.ceil(n / per)))


def with_range_buckets(df: DataFrame, cols: list[str], n_buckets: int, suffix: str = "__b") -> DataFrame:
    """Add a monotone bucket id per column (one sketch pass for all of them).

    The edges only steer the balance; ranks stay exact for any edges because
    bucket membership is decided by comparing values with literals.
    """
    if n_buckets <= 1:
        return df.withColumns({c + suffix: F.lit(0).cast("int") for c in cols})
    probs = [i / n_buckets for i in range(1, n_buckets)]
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    found = doubles.approxQuantile(cols, probs, 1.0 / (4 * n_buckets))
    tmp = {c + suffix + "v": F.col(c).cast("double") for c in cols}
    out = df.withColumns(tmp)
    out = Bucketizer(
        inputCols=list(tmp),
        outputCols=[c + suffix for c in cols],
        splitsArray=[_splits(q) if q and len(_splits(q)) > 2 else [-math.inf, 0.0, math.inf] for q in found],
        handleInvalid="keep",
    ).transform(out)
    # nulls sort before every value and get a bucket below all
    return out.drop(*tmp).withColumns({c + suffix: F.coalesce(F.col(c + suffix).cast("int"), F.lit(-1)) for c in cols})


def _composite_bucket(df: DataFrame, value: str, key: str | None, n: int, rows_per_bucket) -> DataFrame:
    """``__b``: bucket by value, cut again by key inside single-value buckets."""
    nb = bucket_count(n, rows_per_bucket)
    if key is None or key == value or nb == 1:
        return with_range_buckets(df, [value], nb).withColumnRenamed(value + "__b", "__b")
    both = with_range_buckets(df, [value, key], nb)
    span = (
        both.groupBy(value + "__b")
        .agg((F.min(value) == F.max(value)).alias("single"))
        .where("single")
        .select(value + "__b")
        .collect()
    )
    single = [r[0] for r in span]
    sub = F.when(F.col(value + "__b").isin(single), F.col(key + "__b")).otherwise(F.lit(0))
    return both.withColumn("__b", F.col(value + "__b") * F.lit(nb + 2) + sub).drop(value + "__b", key + "__b")


def with_rank(
    df: DataFrame,
    order: str,
    key: str | None = None,
    by: list[str] | tuple = (),
    name: str = "rank",
    descending: bool = False,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Exact 0-based rank by (order, key) inside ``by``."""
    by = list(by)
    value = "__ord"
    work = df.withColumn(value, -F.col(order) if descending else F.col(order))
    n = df.count()
    if bucket_count(n, rows_per_bucket) == 1:  # the whole input is one bucket
        w = W.partitionBy(*(by or [F.lit(0)])).orderBy(value, *([key] if key and key != order else []))
        return work.withColumn(name, (F.row_number().over(w) - 1).cast("bigint")).drop(value)
    work = _composite_bucket(work, value, key, n, rows_per_bucket)
    totals = work.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w_off = W.partitionBy(*by).orderBy("__b") if by else W.partitionBy(F.lit(0)).orderBy("__b")
    offsets = totals.withColumn(
        "__off", F.coalesce(F.sum("__n").over(w_off.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).drop("__n")
    w_in = W.partitionBy(*by, "__b").orderBy(value, *([key] if key and key != order else []))
    ranked = work.withColumn("__r", F.row_number().over(w_in) - 1)
    joined = ranked.join(offsets, [*by, "__b"], "left")
    return joined.withColumn(name, (F.col("__r") + F.col("__off")).cast("bigint")).drop("__r", "__off", "__b", value)


def order_statistics(
    df: DataFrame,
    order: str,
    targets: dict[tuple, list[int]],
    key: str | None = None,
    by: list[str] | tuple = (),
    rows_per_bucket: int | None = None,
) -> dict[tuple, dict[int, tuple]]:
    """Rows at given 0-based ranks: {group: {rank: (value, key)}}.

    Only the rows of the buckets that hold a target are sorted. Driver traffic:
    one count per (group, bucket) and one row per target.
    """
    by = list(by)
    keep = list(dict.fromkeys([*by, order, *([key] if key else [])]))
    work = df.select(*keep).where(F.col(order).isNotNull())
    n = work.count()
    work = _composite_bucket(work, order, key, n, rows_per_bucket)
    counts: dict[tuple, list[tuple[int, int]]] = {}
    for r in work.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(tuple(r[b] for b in by), []).append((r["__b"], r["n"]))
    wanted = []
    for group, ranks in targets.items():
        cells = sorted(counts.get(group, []))
        ends, total = [], 0
        for _, c in cells:
            total += c
            ends.append(total)
        for rank in ranks:
            if 0 <= rank < total:
                i = bisect.bisect_right(ends, rank)
                wanted.append((*group, cells[i][0], rank - (ends[i] - cells[i][1]), rank))
    if not wanted:
        return {}
    spark = df.sparkSession
    types = dict(work.dtypes)
    schema = ", ".join([f"`{b}` {types[b]}" for b in by] + ["__b int", "__local bigint", "__rank bigint"])
    want = spark.createDataFrame(wanted, schema)
    cells = want.select(*by, "__b").distinct()
    w_in = W.partitionBy(*by, "__b").orderBy(order, *([key] if key and key != order else []))
    small = work.join(bounded_broadcast(cells, len(wanted)), [*by, "__b"], "left_semi")
    hit = (
        small.withColumn("__local", (F.row_number().over(w_in) - 1).cast("bigint"))
        .join(bounded_broadcast(want, len(wanted)), [*by, "__b", "__local"])
        .select(*by, "__rank", F.col(order).alias("__v"), F.col(key or order).alias("__k"))
    )
    out: dict[tuple, dict[int, tuple]] = {}
    for r in hit.collect():
        out.setdefault(tuple(r[b] for b in by), {})[r["__rank"]] = (r["__v"], r["__k"])
    return out


def keep_smallest(
    df: DataFrame, order: str, k: int, key: str, rows_per_bucket: int | None = None
) -> DataFrame:
    """The k first rows by (order, key), as a filter: no sort of the whole table."""
    if k <= 0:
        return df.limit(0)
    stat = order_statistics(df, order, {(): [k - 1]}, key, rows_per_bucket=rows_per_bucket)
    if not stat:
        return df.where(F.col(order).isNotNull())
    v, kv = stat[()][k - 1]
    return df.where((F.col(order) < F.lit(v)) | ((F.col(order) == F.lit(v)) & (F.col(key) <= F.lit(kv))))


def exact_quantiles(
    df: DataFrame,
    cols: list[str],
    probs: list[float],
    by: list[str] | tuple = (),
    small_rows: int = 2_000_000,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Long table (by..., name, p, value) of linear-interpolated quantiles.

    Under ``small_rows`` the built-in ``percentile`` is used, which keeps all
    distinct values of a group in one buffer. Beyond it: bucket counts for all
    columns in one pass, then only the buckets that hold a wanted rank are
    counted by value. Nulls and NaN are skipped. ``by`` must be of low
    cardinality (classes, folds, combinations).
    """
    by = list(by)
    clean = df.select(*by, *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in cols])
    n = clean.count()
    if n <= small_rows:
        wide = clean.groupBy(*by).agg(*[F.percentile(c, [float(p) for p in probs]).alias(c) for c in cols])
        pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("vs")) for c in cols])
        return wide.select(*by, F.explode(pairs).alias("s")).select(
            *by,
            "s.name",
            F.explode(
                F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("p"), F.col("s.vs").alias("value"))
            ).alias("z"),
        ).select(*by, "name", F.col("z.p").alias("p"), F.col("z.value").alias("value"))
    bucketed = with_range_buckets(clean, cols, bucket_count(n, rows_per_bucket))
    cells = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).alias("v"), F.col(c + "__b").alias("b")) for c in cols]
    )
    long = (
        bucketed.select(*by, F.explode(cells).alias("s"))
        .select(*by, "s.name", "s.v", "s.b")
        .where(F.col("v").isNotNull())
    )
    totals = long.groupBy(*by, "name", "b").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*by, "name").orderBy("b")
    pos = F.array(*[F.struct(F.lit(float(p)).alias("p")) for p in probs])
    spans = (
        totals.withColumn("end", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("total", F.sum("n").over(W.partitionBy(*by, "name")))
        .withColumn("start", F.col("end") - F.col("n"))
        .withColumn("p", F.explode(F.transform(pos, lambda s: s["p"])))
        .withColumn("pos", F.col("p") * (F.col("total") - 1))
        .withColumn("lo", F.floor("pos"))
        .withColumn("hi", F.ceil("pos"))
    )
    wanted = spans.where(
        ((F.col("lo") >= F.col("start")) & (F.col("lo") < F.col("end")))
        | ((F.col("hi") >= F.col("start")) & (F.col("hi") < F.col("end")))
    ).select(*by, "name", "b", "start", "p", "pos", "lo", "hi")
    values = (
        long.join(wanted.select(*by, "name", "b").distinct(), [*by, "name", "b"], "left_semi")
        .groupBy(*by, "name", "b", "v")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    wv = W.partitionBy(*by, "name", "b").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    placed = values.withColumn("cend", F.sum("c").over(wv)).withColumn("cstart", F.col("cend") - F.col("c"))
    hit = placed.join(wanted, [*by, "name", "b"])

    def at(rank: str) -> Column:
        r = F.col(rank) - F.col("start")
        return F.max(F.when((r >= F.col("cstart")) & (r < F.col("cend")), F.col("v")))

    return (
        hit.groupBy(*by, "name", "p", "pos", "lo", "hi")
        .agg(at("lo").alias("vlo"), at("hi").alias("vhi"))
        .select(
            *by,
            "name",
            "p",
            _between(),
        )
    )


def _between() -> Column:
    """The value at ``pos`` between two order statistics, rounded as ``percentile`` rounds it."""
    mixed = (F.col("hi") - F.col("pos")) * F.col("vlo") + (F.col("pos") - F.col("lo")) * F.col("vhi")
    return F.when((F.col("lo") == F.col("hi")) | (F.col("vlo") == F.col("vhi")), F.col("vlo")).otherwise(mixed).alias("value")


def running_totals(
    df: DataFrame,
    order: str,
    measures: list[str],
    by: list[str] | tuple = (),
    descending: bool = True,
    following: bool = False,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Inclusive cumulative sums over rows already unique per (by, order).

    ``following`` also adds ``next_`` columns with the measures of the row
    after; the last row of a bucket takes them from the next bucket's head.
    """
    by = list(by)
    n = df.count()

    def direction(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    if bucket_count(n, rows_per_bucket) == 1:  # the whole input is one bucket
        w = W.partitionBy(*(by or [F.lit(0)])).orderBy(direction(order))
        out = {f"cum_{m}": F.sum(m).over(w.rowsBetween(W.unboundedPreceding, 0)) for m in measures}
        if following:
            out |= {f"next_{m}": F.lead(m).over(w) for m in measures}
        return df.withColumns(out)
    work = with_range_buckets(df, [order], bucket_count(n, rows_per_bucket)).withColumnRenamed(order + "__b", "__b")
    head = F.max_by if descending else F.min_by
    totals = work.groupBy(*by, "__b").agg(
        *[F.sum(m).alias(f"__t_{m}") for m in measures],
        *[head(m, order).alias(f"__h_{m}") for m in measures if following],
    )
    w_off = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(direction("__b"))
    before = w_off.rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "__b",
        *[F.coalesce(F.sum(f"__t_{m}").over(before), F.lit(0)).alias(f"__o_{m}") for m in measures],
        *[F.lead(f"__h_{m}").over(w_off).alias(f"__h_{m}") for m in measures if following],
    )
    w_in = W.partitionBy(*by, "__b").orderBy(direction(order))
    cum = w_in.rowsBetween(W.unboundedPreceding, 0)
    inner = work.withColumns(
        {
            **{f"cum_{m}": F.sum(m).over(cum) for m in measures},
            **{f"next_{m}": F.lead(m).over(w_in) for m in measures if following},
        }
    )
    joined = inner.join(offsets, [*by, "__b"])
    return joined.withColumns(
        {
            **{f"cum_{m}": F.col(f"cum_{m}") + F.col(f"__o_{m}") for m in measures},
            **{f"next_{m}": F.coalesce(f"next_{m}", f"__h_{m}") for m in measures if following},
        }
    ).drop("__b", *[f"__o_{m}" for m in measures], *[f"__h_{m}" for m in measures])
