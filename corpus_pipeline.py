"""Documents to training sequences: toxicity, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from raresight.llm import line_dedup, mixing, packing, simhash, toxicity
from raresight.llm.common import cut, own, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model trained on ``labels`` finds toxic go; null texts stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    judged = docs.withColumn("__p", toxicity.severity(spark, model, F.col("text"))["p_toxic"])
    return judged.where(F.col("__p") < toxicity.REJECT).drop("__p")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later near-duplicate lines go, and with them documents of which no word is left."""
    found = line_dedup.dedup(docs).where(~F.col("emptied"))
    length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).select(*own(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each SimHash group stays: 4-word shingles, 4 bits."""
    return simhash.keep_first(docs, shingle=4, distance=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, a row per copy."""
    return mixing.repeat(mixing.mix(docs)).select(*own(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 4096."""
    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages learn, link and tokenize: no SQL. Each is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
