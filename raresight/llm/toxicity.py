"""Toxicity by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from raresight.llm.common import carried, small_batches

#: The fit sees at most so many labelled rows, of smallest seeded hash, and so many words.
MAX_ROWS, MAX_WORDS = 20_000, 1_000
#: A word is tried as a feature if it is in this many toxic rows and this many times likelier there.
MIN_ROWS, MIN_RATIO = 3, 4.0
L1, ROUNDS = 1e-4, 600
GRADES = 3
REJECT = 0.5
SCHEMA = "severity double, p_toxic double, grade int"
#: Lengths of word beginnings that are features beside the words: inflected and compounded forms share them.
BEGINNINGS = (4, 5, 6)
TOKEN = re.compile(r"\w+")


def words(text: str | None) -> Counter:
    """Counts of a text's lower-cased words, and of their beginnings as ``begin*``."""
    found = Counter(TOKEN.findall(text.lower())) if text else Counter()
    begins: Counter = Counter()
    for word, n in found.items():
        for length in BEGINNINGS:
            if len(word) > length:
                begins[word[:length] + "*"] += n
    found.update(begins)
    return found


class Model:
    """P(grade >= g) = sigmoid(w . x - cut_g), x the logarithm of 1 + count of each word."""

    def __init__(self, weights: dict[str, float], cuts: list[float]):
        self.weights, self.cuts = weights, np.array(cuts)

    def above(self, text: str | None) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ...; zeros without a model or a word."""
        found = words(text) if self.weights else Counter()
        if not found:
            return np.zeros(GRADES - 1)
        score = sum(self.weights[w] * np.log1p(n) for w, n in found.items() if w in self.weights)
        return 1 / (1 + np.exp(np.clip(self.cuts - score, -500, 500)))


def train(rows: list[dict[str, int]], grades: list[int], vocabulary: list[str]) -> Model:
    """Accelerated proximal gradient on the ordinal likelihood with an L1 penalty on the shared weights."""
    place = {w: i for i, w in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, row in enumerate(rows):
        for w, n in row.items():
            x[i, place[w]] = np.log1p(n)
    y = np.array(grades)
    hit = (y[:, None] >= np.arange(1, GRADES)[None, :]).astype(np.float64)
    rates = np.clip(hit.mean(axis=0), 1e-4, 1 - 1e-4)
    cuts, w = -np.log(rates / (1 - rates)), np.zeros(len(vocabulary))
    step = 4 / ((GRADES - 1) * max(1e-9, float(np.einsum("ij,ij->i", x, x).mean()) + 1))
    vw, vc, momentum = w.copy(), cuts.copy(), 1.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(np.clip(vc[None, :] - (x @ vw.astype(np.float32))[:, None], -500, 500)))
        error = (p - hit) / len(y)
        new_w = vw - step * (x.T @ error.sum(axis=1).astype(np.float32))
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * L1, 0)
        new_c = np.maximum.accumulate(vc + step * error.sum(axis=0))  # the thresholds stay in order
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        vw, vc = new_w + (momentum - 1) / faster * (new_w - w), new_c + (momentum - 1) / faster * (new_c - cuts)
        w, cuts, momentum = new_w, new_c, faster
    return Model({word: float(w[i]) for word, i in place.items() if abs(w[i]) > 1e-6}, cuts.tolist())


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", seed: int = 5) -> Model:
    """Ordinal model from labelled documents.

    Grade 0 is not toxic; toxic rows are graded 1 or 2, split at the sample's median
    of how many toxic-marked words they hold. At most ``MAX_ROWS`` labelled rows of
    smallest seeded hash enter the fit; exact copies of a text enter once. Null
    labels, keys and texts are left out. Without toxic or other rows the model is
    empty and every text has severity 0.
    """
    small_batches(docs.sparkSession)
    marked = labels.where(F.col(key).isNotNull() & F.col(toxic).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.max(toxic).alias("toxic"))
    bounded = marked.orderBy(F.xxhash64("__k", F.lit(seed)), "__k").limit(MAX_ROWS)
    texts = docs.select(F.col(key).alias("__k"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    chosen = texts.join(F.broadcast(bounded), "__k")
    rows = chosen.groupBy(F.md5(F.col("text").cast("binary"))).agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text").cache()
    sizes = {t: n for t, n in rows.groupBy((F.col("toxic") > 0).alias("t")).count().collect()}
    if not sizes.get(True) or not sizes.get(False):
        rows.unpersist()
        return Model({}, [0.0] * (GRADES - 1))

    def vocabulary(texts: pd.Series) -> pd.Series:
        return pd.Series([list(words(t)) for t in texts])

    each = rows.select((F.col("toxic") > 0).alias("t"), F.explode(F.pandas_udf(vocabulary, "array<string>")("text")).alias("word"))
    seen = each.groupBy("word").agg(F.count_if("t").alias("in_toxic"), F.count_if(~F.col("t")).alias("elsewhere"))
    ratio = (F.col("in_toxic") + 0.5) / sizes[True] / ((F.col("elsewhere") + 0.5) / sizes[False])
    likely = seen.where((F.col("in_toxic") >= MIN_ROWS) & (ratio >= MIN_RATIO))
    top = [r[0] for r in likely.orderBy(F.desc("in_toxic"), "word").select("word").limit(MAX_WORDS).collect()]
    known = set(top)

    def sparse(toxics: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([{w: n for w, n in words(t).items() if w in known} for t in texts])

    data = rows.select("toxic", F.pandas_udf(sparse, "map<string,int>")("toxic", "text").alias("x")).collect()
    rows.unpersist()
    data = sorted(((int(t > 0), tuple(sorted(x.items()))) for t, x in data))
    amount = [sum(n for _, n in x) for _, x in data]
    middle = np.median([a for a, (t, _) in zip(amount, data) if t])
    return train([dict(x) for _, x in data], [t * (1 + (a > middle)) for a, (t, _) in zip(amount, data)], top)


def severity(spark: SparkSession, model: Model, text: Column) -> Column:
    """struct(severity, p_toxic, grade): expected grade, chance of any, most likely grade. Null and empty texts: 0."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def each(texts: pd.Series) -> pd.DataFrame:
        above = np.array([shared.value.above(t) for t in texts]).reshape(len(texts), GRADES - 1)
        chance = np.hstack((1 - above[:, :1], above[:, :-1] - above[:, 1:], above[:, -1:]))
        return pd.DataFrame({"severity": above.sum(axis=1), "p_toxic": above[:, 0], "grade": chance.argmax(axis=1).astype("int32")})

    return F.pandas_udf(each, SCHEMA)(text)


carried(__name__)
