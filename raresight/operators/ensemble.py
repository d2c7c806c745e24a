"""Voting of every model subset in one pass over the predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import safe_divide
from ..session import truncate_lineage
from .ordering import bounded_broadcast, with_rank

#: Every subset of n members is reported, 2^n - 1 of them; callers that want more say so with ``most`` (30 fit the mask).
MOST_MEMBERS = 16


def vote_grid(start: float = 0.49, step: float = 0.01, stop: float = 2.0) -> list[float]:
    """Thresholds by repeated addition, as the search reaches them."""
    out = [start]
    while out[-1] <= stop:
        out.append(out[-1] + step)
    return out


def complete_combinations(predictions: DataFrame, total: int | None = None, key: str = "case_index") -> DataFrame:
    """Combinations with one prediction for every case."""
    n = total if total is not None else predictions.select(key).distinct().count()
    return (
        predictions.groupBy("combination_id")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("cases"))
        .where((F.col("rows") == n) & (F.col("cases") == n))
        .select("combination_id", "rows")
    )


def _check(members: list[int], most: int = 30) -> list[int]:
    if not 0 < len(members) <= min(most, 30):
        raise ValueError(f"{len(members)} combinations have 2^{len(members)} - 1 subsets; up to {min(most, 30)} are combined, see most")
    return sorted(members)


def _member_name(members: list[int], mask: Column) -> Column:
    names = F.array(*[F.lit(str(m)) for m in members])
    idx = F.array(*[F.lit(i) for i in range(len(members))])
    picked = F.filter(F.arrays_zip(names.alias("n"), idx.alias("i")), lambda s: (F.shiftright(mask, 0).bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(len(members))]), s["i"] + 1))) != 0)
    return F.array_join(F.transform(picked, lambda s: s["n"]), ",")


def per_case(predictions: DataFrame, members: list[int]) -> DataFrame:
    """One row per case: the label, a bit mask of positive votes and the
    scores in member order. A case predicted more than once by a model
    (repeated folds) is averaged first."""
    members = _check(members)
    rows = predictions.where(F.col("combination_id").isin(members))
    c = F.col("combination_id")
    cells = rows.groupBy("case_index").agg(
        F.max("actual").alias("actual"),
        *[F.avg(F.when(c == m, F.col("proba"))).alias(f"p{i}") for i, m in enumerate(members)],
        *[F.min(F.when(c == m, F.col("predicted"))).alias(f"v{i}") for i, m in enumerate(members)],
    )
    mask = sum((F.coalesce(F.col(f"v{i}"), F.lit(0)) * (1 << i) for i in range(len(members))), F.lit(0))
    return cells.select("case_index", "actual", mask.cast("int").alias("mask"), *[f"p{i}" for i in range(len(members))])


def and_subsets(predictions: DataFrame, members: list[int], most: int = MOST_MEMBERS) -> DataFrame:
    """Unanimous vote of each non-empty subset: tp, fp, fn, ppv, fnr.

    Cases collapse to (mask, label) counts, at most 2^(n+1) rows. A subset is
    positive where it is contained in the mask, so its counts are sums over all
    supersets: one transform of the 2^n counts in n steps, a step for each member.
    """
    members = _check(members, most)
    n = len(members)
    counts = per_case(predictions, members).groupBy("mask").agg(
        F.count_if(F.col("actual") == 1).alias("tp"), F.count_if(F.col("actual") == 0).alias("fp")
    )
    every = predictions.sparkSession.range(1 << n).select(F.col("id").cast("int").alias("mask"))
    dense = every.join(counts, "mask", "left").fillna(0, ["tp", "fp"])
    one = dense.agg(F.array_sort(F.collect_list(F.struct("mask", "tp", "fp"))).alias("c"))
    work = one.select(F.col("c.tp").alias("tp"), F.col("c.fp").alias("fp"))
    for i in range(n):
        work = work.withColumns({c: superset_step(F.col(c), i) for c in ("tp", "fp")})
    rows = work.select(F.posexplode(F.arrays_zip("tp", "fp")).alias("subset", "s"), F.element_at("tp", 1).alias("all_pos"))
    out = rows.where("subset > 0").select("subset", "s.tp", "s.fp", (F.col("all_pos") - F.col("s.tp")).alias("fn"))
    return out.select(
        F.col("subset").cast("int").alias("subset"),
        _member_name(members, F.col("subset")).alias("members"),
        F.bit_count("subset").cast("int").alias("model_count"),
        *[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")],
        safe_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("ppv"),
        safe_divide(F.col("fn"), F.col("tp") + F.col("fn")).alias("fnr"),
    )


def superset_step(counts: Column, bit: int) -> Column:
    """Each mask without ``bit`` takes in the count of the mask with it."""
    step = F.lit(1 << bit)
    return F.transform(counts, lambda v, m: F.when(m.bitwiseAND(step) == 0, v + F.get(counts, m.bitwiseOR(step))).otherwise(v))


def _voted(cases: DataFrame, n: int) -> DataFrame:
    """(subset, vote, actual, n) for every subset of a score row: the mean member
    score, added in member order.

    The subset number is exploded first and the score is plain arithmetic on
    it, so expansion, score and the filters after it are one generated loop.
    """
    s = F.col("subset")
    total = F.lit(0.0)
    for i in range(n):
        total = total + F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.col(f"p{i}")).otherwise(F.lit(0.0))
    wide = cases.withColumn("subset", F.explode(F.sequence(F.lit(1), F.lit((1 << n) - 1))))
    return wide.select("subset", "actual", "n", (total / F.bit_count(s)).alias("vote"))


def best_threshold(lowest: Column, grid: list[float]) -> Column:
    """Largest grid value that keeps every positive; the start if none does.

    Equal to raising the threshold step by step while no positive is missed.
    """
    cuts = F.array(*[F.lit(g) for g in grid])
    return F.coalesce(F.array_max(F.filter(cuts, lambda t: t <= lowest)), F.lit(grid[0]))


def top_scores(predictions: DataFrame, members: list[int]) -> dict[int, float]:
    rows = predictions.where(F.col("combination_id").isin(members)).groupBy("combination_id").agg(F.max("proba").alias("top"))
    return {r["combination_id"]: r["top"] for r in rows.collect()}


def normalised_cases(predictions: DataFrame, members: list[int], top: dict[int, float] | None = None) -> DataFrame:
    """``per_case`` with every model's scores divided by its largest one."""
    members = _check(members)
    top = top if top is not None else top_scores(predictions, members)
    cases = per_case(predictions, members)
    return cases.withColumns(
        {f"p{i}": F.col(f"p{i}") / F.lit(top.get(m) or 1.0) for i, m in enumerate(members)}
    )


def vote_subsets(predictions: DataFrame, members: list[int], grid: list[float] | None = None, most: int = MOST_MEMBERS) -> DataFrame:
    """Mean-score vote of each subset at its best threshold.

    Cases of equal scores and label are one row with their number. Pass 1 takes the
    lowest vote of the positives per subset. Pass 2 counts rows at or above the
    threshold; a negative whose every score is under the lowest threshold of all
    subsets can be positive for none and is not expanded.
    """
    members = _check(members, most)
    n = len(members)
    grid = grid or vote_grid()
    scores = [f"p{i}" for i in range(n)]
    cases = normalised_cases(predictions, members).groupBy("actual", *scores).agg(F.count(F.lit(1)).alias("n"))
    cases = truncate_lineage(cases)
    lows = _voted(cases.where("actual = 1"), n).groupBy("subset").agg(F.min("vote").alias("lowest"), F.sum("n").alias("all_pos"))
    # every subset has its row, also where no case is positive
    every = predictions.sparkSession.range(1, 1 << n).select(F.col("id").cast("int").alias("subset"))
    cuts = every.join(lows, "subset", "left").fillna(0, ["all_pos"])
    cuts = truncate_lineage(cuts.withColumn("threshold", best_threshold(F.col("lowest"), grid)))
    least = cuts.agg(F.min("threshold")).first()[0]
    best_score = F.greatest(*scores) if n > 1 else F.col("p0")
    # 1e-9 keeps rows whose mean could round up to the threshold
    live = cases.where((F.col("actual") == 1) | (best_score >= least - 1e-9))
    rows = _voted(live, n).where(F.col("vote") >= least)
    counted = (
        rows.join(bounded_broadcast(cuts.select("subset", "threshold"), 1 << n), "subset")
        .where(F.col("vote") >= F.col("threshold"))
        .groupBy("subset")
        .agg(*[F.coalesce(F.sum(F.when(F.col("actual") == a, F.col("n"))), F.lit(0)).alias(c) for c, a in (("tp", 1), ("fp", 0))])
    )
    out = cuts.join(counted, "subset", "left").fillna(0, ["tp", "fp"]).withColumn("fn", F.col("all_pos") - F.col("tp"))
    return out.select(
        F.col("subset").cast("int").alias("subset"),
        _member_name(members, F.col("subset")).alias("members"),
        F.bit_count("subset").cast("int").alias("model_count"),
        *[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")],
        safe_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("ppv"),
        safe_divide(F.col("fn"), F.col("tp") + F.col("fn")).alias("fnr"),
        "threshold",
    )


def threshold_search(df: DataFrame, by: list[str], score: str = "proba", actual: str = "actual", grid: list[float] | None = None) -> DataFrame:
    """The threshold step alone, for one score column per group."""
    grid = grid or vote_grid()
    low = df.groupBy(*by).agg(F.min(F.when(F.col(actual) == 1, F.col(score))).alias("lowest"))
    return low.select(*by, best_threshold(F.col("lowest"), grid).alias("threshold"))


def max_by_size(subsets: DataFrame, columns: list[str]) -> DataFrame:
    """Column-wise maxima per subset size (not one row of the subset)."""
    return subsets.groupBy("model_count").agg(*[F.max(c).alias(c) for c in columns])


def best_rows_by_size(subsets: DataFrame) -> DataFrame:
    """The subset with the best ppv per size, as a whole row."""
    cols = [c for c in subsets.columns if c != "model_count"]
    pick = F.max_by(F.struct(*cols), F.struct(F.col("ppv"), -F.col("fnr"), -F.col("subset"))).alias("r")
    return subsets.groupBy("model_count").agg(pick).select("model_count", "r.*")


def _in_order(votes: str) -> Column:
    """Scores added up in member order, so that a rank never depends on partitions."""
    return F.aggregate(votes, F.lit(0.0), lambda total, v: total + v["proba"])


def agreement(predictions: DataFrame, exclude: list[int] = (), truth: int | None = None) -> DataFrame:
    """Positive predictions as long rows with the case's total agreement.

    total is scaled to 0.5 .. 1 by the largest total; ``true_positive`` marks
    the cases the reference combination got right.
    """
    kept = predictions.where((F.col("predicted") == 1) & ~F.col("combination_id").isin(list(exclude) or [-1]))
    right = (F.col("actual") == 1) & (F.lit(True) if truth is None else F.col("combination_id") == truth)
    # a case has at most one entry per combination, so its list is short
    cases = truncate_lineage(
        kept.groupBy("case_index").agg(
            F.max(right.cast("int")).alias("true_positive"),
            F.array_sort(F.collect_list(F.struct("combination_id", "proba"))).alias("votes"),
        ).withColumn("total", _in_order("votes"))
    )
    top = cases.agg(F.max("total")).scalar()
    return cases.select("case_index", "true_positive", "total", F.explode("votes").alias("v")).select(
        "v.combination_id",
        "case_index",
        "v.proba",
        (F.col("total") / top / F.lit(2.0) + F.lit(0.5)).alias("agreement"),
        "true_positive",
    )


def order_cases(predictions: DataFrame, **options) -> DataFrame:
    """Cases by total score of their positive predictions, exact ranks."""
    votes = F.array_sort(F.collect_list(F.struct("combination_id", "proba"))).alias("votes")
    totals = predictions.where("predicted = 1").groupBy("case_index").agg(votes).select("case_index", _in_order("votes").alias("total"))
    return with_rank(totals, "total", "case_index", descending=True, **options)


def order_combinations(predictions: DataFrame) -> DataFrame:
    """Combinations by the number of cases they leave out."""
    pos = predictions.where("predicted = 1")
    cases = pos.agg(F.count_distinct("case_index")).scalar()
    return pos.groupBy("combination_id").agg(F.count_distinct("case_index").alias("__n")).select(
        "combination_id", (cases - F.col("__n")).alias("null_count")
    )
