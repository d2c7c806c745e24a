"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType

from raresight.llm.common import carried, cut, own, shuffled, small_batches
from raresight.llm.graph import components

BITS = 64
SEED = 42
HASHES_AT_ONCE = 1 << 16


def simhash(text: str | None, shingle: int) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if set in over half the shingle hashes.

    A-Z is lowered; shorter texts are one shingle; no word gives 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    ones = np.zeros(BITS, np.int64)
    one_hash = xxhash.xxh64_intdigest
    for at in range(0, n, HASHES_AT_ONCE):
        cuts = zip(starts[at : at + HASHES_AT_ONCE].tolist(), last[at : at + HASHES_AT_ONCE].tolist())
        hashes = np.array([one_hash(joined[s:e], SEED) for s, e in cuts], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int) -> Column:
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return F.pandas_udf(each, LongType())(text)


def segments(distance: int) -> list[tuple[int, int]]:
    """(offset, width): so few that ``distance`` bits leave one segment with at most one."""
    k = distance // 2 + 1
    edges = [BITS * i // k for i in range(k + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def variants(fps: DataFrame, distance: int) -> DataFrame:
    """A row per fingerprint and wildcard bit: ``v`` names the bit, ``rest`` is its segment without it."""
    fp = F.col("fp")
    rows = []
    for lo, width in segments(distance):
        mask = (1 << width) - 1
        part = F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit(_signed(mask)))
        for bit in range(width):
            rows.append(F.struct(F.lit(lo + bit).alias("v"), part.bitwiseAND(F.lit(_signed(mask & ~(1 << bit)))).alias("rest")))
    # a fingerprint becomes 64 rows: they are dealt out before, not after
    dealt = fps.repartition("fp")
    return dealt.withColumn("__x", F.explode(F.array(*rows))).select(*fps.columns, "__x.v", "__x.rest")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def link(fps: DataFrame, distance: int) -> DataFrame:
    """Distinct fingerprints (fp) -> (fp, root): fingerprints joined by links of at most ``distance`` bits.

    Two rounds that keep every connection but not every pair. First each signature
    bucket links its members to its smallest fingerprint where they are near. Then
    only buckets that still hold several components are self-joined, and only for
    near pairs of different components, so a large group of near copies costs its
    members, not their pairs. Fingerprints without a link are their own root.
    """
    every = variants(fps.select("fp"), distance)
    hubs = every.groupBy("v", "rest").agg(F.min("fp").alias("hub"), F.max("fp").alias("far")).where("hub != far").drop("far")
    first = every.join(shuffled(hubs), ["v", "rest"]).where(_near(F.col("fp"), F.col("hub"), distance) & (F.col("fp") != F.col("hub")))
    stars = components(first.select(F.col("fp").alias("a"), F.col("hub").alias("b")))
    labels = fps.select("fp").join(stars.withColumnRenamed("node", "fp"), "fp", "left")
    labels = cut(labels.select("fp", F.coalesce("root", "fp").alias("root")))
    marked = variants(labels, distance)
    bucket = W.partitionBy("v", "rest")
    left = marked.withColumns({"lo": F.min("root").over(bucket), "hi": F.max("root").over(bucket)}).where("lo != hi").drop("lo", "hi")
    right = left.select("v", "rest", F.col("fp").alias("fp2"), F.col("root").alias("root2"))
    apart = (left.v == right.v) & (left.rest == right.rest) & (left.root < right.root2) & _near(left.fp, right.fp2, distance)
    bridges = left.join(shuffled(right), apart).select(F.col("root").alias("a"), F.col("root2").alias("b"))
    joined = components(bridges).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return labels.join(joined, "root", "left").select("fp", F.coalesce("top", "root").alias("root"))


def _linked(docs: DataFrame, key: str, text: str, shingle: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """(key, fp) of all rows, and the (fp, root) of their fingerprints."""
    small_batches(docs.sparkSession)
    prints = cut(docs.select(F.col(key).alias("key"), fingerprint(F.col(text), shingle).alias("fp")))
    return prints, cut(link(prints.select("fp").distinct(), distance))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """(key, fp, component): near-duplicate groups of all rows.

    ``component`` is the smallest key reachable over links of at most ``distance``
    differing bits. Null and wordless texts have fingerprint 0 and link like any
    other; repeated rows share their fingerprint; null keys are grouped too but
    name no component unless all of it is null. Other columns are left out.
    """
    prints, roots = _linked(docs, key, text, shingle, distance)
    firsts = prints.groupBy("fp").agg(F.min("key").alias("first"))
    named = firsts.join(shuffled(roots), "fp").groupBy("root").agg(F.min("first").alias("component"))
    return prints.join(roots.join(named, "root").drop("root"), "fp").select(F.col("key").alias(key), "fp", "component")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row of each near-duplicate group: the smallest key, null keys first, one copy of repeated rows."""
    small_batches(docs.sparkSession)
    # a text and its fingerprint are written once: the join below would make it again for its filters
    marked = cut(docs.withColumn("__fp1", fingerprint(F.col(text), shingle)))
    prints = marked.select(F.col(key).alias("key"), F.col("__fp1").alias("fp"))
    roots = cut(link(prints.select("fp").distinct(), distance))
    # by root: the component is null for every group whose keys are all null
    firsts = prints.groupBy("fp").agg(F.min(F.struct("key")).alias("first")).join(shuffled(roots), "fp")
    keep = firsts.groupBy("root").agg(F.min(F.struct("first.key", "fp")).alias("__k")).select(F.col("__k.key").alias("__key"), F.col("__k.fp").alias("__fp"))
    kept = marked.join(keep, marked[key].eqNullSafe(keep["__key"]) & (marked["__fp1"] == keep["__fp"]), "left_semi")
    return kept.dropDuplicates([key, "__fp1"]).select(*own(docs))


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


carried(__name__)
