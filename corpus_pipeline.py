"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, benchmark copies go, personal data is masked, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; its result is written and read again. All stages
keep repeated rows apart (none is judged by its id alone), give an empty table for an empty one, and leave columns they don't read as they
are, but for names that begin with two underscores, which are theirs. What they do with nulls is said at each. Before a stage,
executors give back the heap that the one before has grown, for the Python workers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loamgrid.llm import bpe, decontaminate, jaccard, pii, toxicity
from loamgrid.llm.common import shared_dir, table, trim
from loamgrid.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on their labels, does not reject. Null and empty texts stay; without labels nothing is rejected."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id where ids are unique. Texts without words are copies of nothing: all stay."""
    trim(spark)
    return jaccard.keep_one(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item, each judged by its own text. Null texts and items match nothing."""
    trim(spark)
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows. Null texts stay null."""
    trim(spark)
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, as digests and counts. Null texts are empty."""
    trim(spark)
    return bpe.digest_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("pii", mask_personal_data),
    ("bpe", encode),
]

#: SQL can't express the stages; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. The tables between them stay in the shared folder: the result reads the last one."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
