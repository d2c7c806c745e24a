"""Mixing sources to target weights by capped water-filling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from raresight.llm.common import cut, own, range_rank, shuffled, word_count

MAX_EPOCHS = 3
WEIGHTS = (5, 2, 1)
#: Hash digits a level resolves: 4096 bins at most per source; three levels make 36 bits.
DIGIT, LEVELS = 4096, 3
SALTS = 32
#: Rows of the salted plan that are broadcast; its file is some hundred times smaller than its rows.
SENT = 1 << 17


def sampling_hash(key: Column, seed: int, text: Column) -> Column:
    """36 seeded bits of a row's key and text; a rerun draws the same."""
    told = F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(told), 1, 9), 16, 10).cast("long")


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> adds target: weight shares of all sizes, none above ``max_epochs`` sizes.

    Sources are ordered by code point, null last, and weighed in turn. A level is
    raised until no unclamped source is above its cap; each pass is one aggregate
    and clamps at least one source more, so it ends.
    """
    ranked = range_rank(sizes, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    src = cut(ranked.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * max_epochs).alias("cap")))
    total, all_weight = src.agg(F.sum("source_size"), F.sum("weight")).first()
    level, clamped = (total / all_weight if all_weight else 0.0), -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("cap")
        n, held, free = src.agg(F.count_if(over), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == clamped or not free:
            break
        clamped, level = n, (total - (held or 0)) / free
    target = F.when(over, F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level))
    return src.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, below): rows whose hash is under ``below`` are taken once more.

    The fraction is met by a prefix of the source in hash order, to within half a
    row. It is found digit by digit from sums per (source, digit), so no source is
    ever sorted or windowed whole.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    state = cut(targets.withColumn("whole", F.floor(ratio)).select(
        "source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("left"),
        F.lit(0).cast("long").alias("prefix")))
    for level in range(LEVELS):
        width = DIGIT ** (LEVELS - level)
        digits = rows.select("source", "size", F.floor(F.col("h") / F.lit(width)).alias("prefix"), F.floor((F.col("h") % width) / F.lit(width // DIGIT)).alias("d"))
        open_ = state.select(F.col("source").alias("__s"), F.col("prefix").alias("__p"))
        if level:
            digits = digits.join(open_, digits.source.eqNullSafe(open_["__s"]) & (digits.prefix == open_["__p"]), "left_semi")
        sums = digits.groupBy("source", "d").agg(F.sum("size").alias("sum"))
        upto = sums.withColumn("upto", F.sum("sum").over(W.partitionBy("source").orderBy("d")))
        sums = upto.withColumnRenamed("source", "__s")
        hit = state.join(sums, state.source.eqNullSafe(sums["__s"]) & (F.col("upto") >= F.col("left")))
        first = hit.groupBy("source").agg(F.min(F.struct("d", "sum", "upto")).alias("x")).withColumnRenamed("source", "__s")
        joined = state.join(first, state.source.eqNullSafe(first["__s"]), "left").drop("__s")
        # past the last digit (a rounding of the fraction upwards) everything is taken
        digit = F.coalesce(F.col("x.d"), F.lit(DIGIT - 1))
        unit = F.coalesce(F.col("x.sum"), F.lit(0))
        before = F.coalesce(F.col("x.upto") - F.col("x.sum"), F.lit(0))
        state = cut(joined.select("source", "source_size", "target", "whole", (F.col("left") - before).alias("left"),
                                  (F.col("prefix") * DIGIT + digit).alias("prefix"), unit.alias("unit")))
    below = F.col("prefix") + (2 * F.col("left") >= F.col("unit")).cast("long")
    return state.select("source", "source_size", "target", "whole", below.alias("below"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 1,
        weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``docs`` with size, source_size, target and copies (0 to ``max_epochs``).

    Size counts words; a null text has none. A source without words has target 0.
    Only rows that share key and text draw alike, so many null keys are no unit.
    Rows of all sources, the null source included, are kept; copies 0 means left
    out of the mix. Columns named size, source_size, target or copies are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    sized = docs.withColumns({"size": word_count(F.col(text)), "__h": sampling_hash(F.col(key), seed, F.col(text))})
    rows = cut(sized.select(F.col(source).alias("source"), "size", F.col("__h").alias("h")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = thresholds(rows, water_fill(sizes, weights, max_epochs))
    plan = plan.select(F.col("source").alias("__s"), F.struct("source_size", "target", "whole", "below").alias("__plan"))
    plan = cut(plan.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    plan = shuffled(plan) if plan.count() > SENT else plan
    salted = sized.withColumn("__salt", (F.col("__h") % SALTS).cast("int"))
    joined = salted.join(plan, salted[source].eqNullSafe(plan["__s"]) & (F.col("__salt") == F.col("__salt2")))
    extra = (F.col("__h") < F.col("__plan.below")).cast("int")
    copies = F.least(F.col("__plan.whole").cast("int") + extra, F.lit(max_epochs))
    return joined.select(*own(docs), "size", "__plan.source_size", "__plan.target", copies.alias("copies"))


def repeat(mixed: DataFrame) -> DataFrame:
    """A row per copy; rows without one go."""
    return mixed.where("copies > 0").withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("__c")
