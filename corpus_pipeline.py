"""The corpus pipeline: stages of khata.llm applied to documents, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from khata.llm.common import cut, table
from khata.llm.decontamination import drop_leaks
from khata.llm.minhash_dedup import keep_one
from khata.llm.mixing import mix
from khata.llm.suffix_array import strip_repeats
from khata.llm.toxicity import THRESHOLD, fit, held_out, reject, train_sample

#: Passages that repeat are cut from this many bytes on: about 35 words, so that any of over 50 words is caught.
PASSAGE_BYTES, PASSAGE_SEED = 200, 32


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that op5_toxicity doesn't predict toxic; it learns outside the held-out fold of the labels."""
    model = fit(train_sample(docs, table(spark, sf_dir, "labels"), "toxic", held_out("doc_id", 4, 2)))
    return reject(docs, model, THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    return keep_one(docs, shingle=5)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; of passages that occur more than once only the first occurrence stays."""
    return strip_repeats(docs, PASSAGE_BYTES, PASSAGE_SEED)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and the output shards."""
    return mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing", mixing),
]

#: No SQL: a trained classifier, random signatures and a random splitting tree cannot be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each one returns is written and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
