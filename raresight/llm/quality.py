"""Text quality by supervised subword embeddings: hashed word and character n-gram vectors, averaged, softmax."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from raresight.llm.common import TURN, carried, mixed, run_hashes, small_batches

#: The fit sees at most so many labelled rows, of smallest seeded hash, and so many different features of each.
MAX_ROWS, MAX_FEATURES = 6_000, 4_096
BUCKETS, WIDTH = 1 << 18, 16
GRAMS = (3, 4, 5)
EPOCHS, RATE = 8, 0.5
ACCEPT = 0.3
#: Code points taken at once; a longer text is cut at white space.
SLICE = 1 << 20
BASE = 0x9FB21C651E98DF25
#: The bucket of a word that repeats the one before it: word pairs of equal words share it.
REPEAT = BUCKETS
SPACES = np.array([9, 10, 11, 12, 13, 32], np.uint32)
GAP = re.compile(r"[\x09-\x0D ]")


def pieces(texts) -> list[tuple[int, str]]:
    """(number of the text, piece): whole texts, long ones cut at white space."""
    out = []
    for i, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            gap = GAP.search(text, at + SLICE) if len(text) - at > SLICE else None
            out.append((i, text[at : gap.start() if gap else len(text)]))
            at += len(out[-1][1])
    return out


class Features:
    """Buckets of the words and character n-grams of pieces: ``groups`` of (owner, bucket) arrays."""

    def __init__(self, owners: list[int], texts: list[str], before: tuple[int, int] | None = None):
        codes = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) + 1 for t in texts])
        owner = np.repeat(np.array(owners), sizes)
        blank = np.zeros(len(codes), bool)
        low = codes <= 32
        blank[low] = np.isin(codes[low], SPACES)
        edge = np.diff((~blank).view(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        words = run_hashes(codes, starts, ends, BASE)
        # the blank after a text stands for the one before the next
        whose = owner[np.minimum(starts - 1, len(owner) - 1)]
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (whose[1:] == whose[:-1])
        if before and len(words):
            same[0] = before == (int(whose[0]), int(words[0]))
        self.last = (int(whose[-1]), int(words[-1])) if len(words) else before
        self.groups = [(whose, (words >> np.uint64(46)).astype(np.int64)), (whose[same], np.full(int(same.sum()), REPEAT))]
        code = np.where(blank, 32, codes).astype(np.uint64)
        gaps = np.concatenate(([0], np.cumsum(blank)))
        key = code.copy()
        for n in range(2, max(GRAMS) + 1):
            key = key[:-1] * TURN + code[n - 1 :] if len(key) > 1 else key[:0]
            if n in GRAMS and len(key):
                # blanks stand at the ends alone
                at = np.flatnonzero((gaps[n - 1 : n - 1 + len(key)] == gaps[1 : 1 + len(key)]))
                self.groups.append((owner[np.minimum(at, len(owner) - 1)], (mixed(key[at] + np.uint64(n)) >> np.uint64(46)).astype(np.int64)))


def features_of(texts):
    """Features of a batch of texts, about ``SLICE`` code points at a time."""
    owners, some, held, before = [], [], 0, None
    for i, piece in pieces(texts):
        owners.append(i)
        some.append(piece)
        held += len(piece)
        if held >= SLICE:
            made = Features(owners, some, before)
            yield made
            owners, some, held, before = [], [], 0, made.last
    if some:
        yield Features(owners, some, before)


class Model:
    """P(label 1) = softmax of the averaged feature vectors times ``output`` plus ``bias``."""

    def __init__(self, vectors: np.ndarray, output: np.ndarray, bias: np.ndarray):
        self.vectors, self.output, self.bias = vectors, output, bias

    def scorer(self) -> Scorer:
        """The same model with each bucket's vector taken to its share of the margin, which is all that scoring needs."""
        return Scorer(self.vectors @ (self.output[:, 1] - self.output[:, 0]), float(self.bias[1] - self.bias[0]))


class Scorer:
    def __init__(self, gain: np.ndarray, bias: float):
        self.gain, self.bias = gain.astype(np.float32), bias

    def score(self, texts) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for made in features_of(texts):
            for owner, bucket in made.groups:
                total += np.bincount(owner, self.gain[bucket], len(texts))
                count += np.bincount(owner, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -500, 500)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 13, width: int = WIDTH, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Stochastic gradient descent on the softmax loss, a document at a step, the rate falling to nothing."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / width, 1 / width, (BUCKETS + 1, width)).astype(np.float32)
    output, bias = np.zeros((width, 2), np.float32), np.zeros(2, np.float32)
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            bucket, share = rows[i]
            now = np.float32(rate * (1 - step / steps))
            step += 1
            mean = share @ vectors[bucket]
            margin = mean @ output + bias
            p = np.exp(margin - margin.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = output @ p
            output -= now * np.outer(mean, p)
            bias -= now * p
            vectors[bucket] -= now * share[:, None] * back[None, :] * np.float32(len(bucket) ** 0.5)
    return Model(vectors, output, bias)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", seed: int = 17) -> Model:
    """Model from labelled documents.

    At most ``MAX_ROWS`` pairs of a document and its label, of smallest seeded hash,
    enter the fit, with at most ``MAX_FEATURES`` different features each; of a key
    labelled twice the smaller label counts, exact copies of a text under one key
    count once. Null keys, labels and texts are left out. Without rows of both
    labels every text scores the share of label 1 among them, one half without any.
    """
    spark = docs.sparkSession
    small_batches(spark)
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__k")).agg((F.min(label) > 0).alias("good"))
    few = marked.orderBy(F.xxhash64("__k", F.lit(seed)), "__k").limit(MAX_ROWS)
    texts = docs.select(F.col(key).alias("__k"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    chosen = texts.join(F.broadcast(few), "__k").withColumn("h", F.xxhash64("__k", "text", F.lit(seed)))

    def shares(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found = [b for made in features_of([t]) for _, b in made.groups]
            bucket, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
            share = n / max(1, n.sum())
            if len(bucket) > MAX_FEATURES:
                some = np.sort(np.argsort(mixed(bucket.astype(np.uint64)))[:MAX_FEATURES])
                bucket, share = bucket[some], share[some] / share[some].sum()
            out.append(bucket.astype("<i4").tobytes() + share.astype("<f4").tobytes())
        return pd.Series(out)

    made = chosen.select("h", "good", F.pandas_udf(shares, "binary")("text").alias("x")).dropDuplicates(["h"])
    # columns of one Arrow table: the driver holds the sample once
    found = made.orderBy("h").limit(MAX_ROWS).toArrow()
    found = found.take(np.argsort(found["h"].to_numpy(), kind="stable"))
    rows = [np.frombuffer(x.as_buffer(), "<i4").reshape(2, -1) for x in found["x"]]
    y = found["good"].to_numpy().astype(np.int64)
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        return Model(np.zeros((BUCKETS + 1, 1), np.float32), np.zeros((1, 2), np.float32), np.array([0, np.log(share / (1 - share))]))
    return train([(x[0], x[1].view("<f4")) for x in rows], y)


def score(spark: SparkSession, model: Model, text: Column) -> Column:
    """P(label 1) of each whole text; null and empty texts have no feature and score by the bias."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model.scorer())

    def each(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()))

    return F.pandas_udf(each, "double")(text)


def held_out(key: Column) -> Column:
    """Rows whose labels are not learned from: crc32 of the key as text is divisible by 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


carried(__name__)
