"""Documents made ready for training: judged, deduplicated, cut, decontaminated and packed.

STAGES has the stages in order. Each takes what the one before it kept, written as Parquet and read again,
and returns the columns of documents, the last the packed pieces. Rows with nulls, empty texts, repeated
rows and further columns pass through as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.llm import decontaminate, minhash, packing, quality, suffix
from flowmill.llm.common import free_names, settle, table

REJECT = 0.3  # a document of a lower quality score goes


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; its examples are documents of the stage's input."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = free_names(docs, "score")[0]
    return quality.score(docs, model, out=score).filter(F.col(score) >= REJECT).drop(score)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return minhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that also start earlier; what is emptied so goes."""
    return suffix.with_kept_text(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, within a tenth of its bytes in edits."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 1024 ids."""
    return packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")), 1024, 2)


STAGES = [
    ("quality classifier", judge),
    ("MinHash near-dedup", deduplicate),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", decontaminate_benchmark),
    ("best-fit packing", pack),
]

ORACLE_SQL = None  # a trained network and verified sampling are beyond SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
