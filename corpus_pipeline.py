"""Corpus pipeline: quality classifier, near duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, further
columns with any names included.  Each works on whole texts of any length; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from radspark.llm import classifier, decontamination, jaccard, mixing, sharding
from radspark.plans.storage import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.3 or more). Null and empty texts score what the model's bias gives; repeated rows are judged one by one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classifier.accepted(docs, labels)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of five-word shingles: that of the smallest doc_id (nulls
    last; ties: text hash), once if the row is repeated. Texts without words, null ones too, all stay."""
    return jaccard.deduplicated(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, verbatim or re-parameterised. Null and empty texts and items match nothing."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Epochs of each source up to its exact budget of words. A null source is one of its own; texts without words, null ones too,
    give no rows; repeated rows count one by one, ties go by the text's md5."""
    return mixing.mixed_documents(docs)


def shard_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot; the other columns are kept, with underscores before names of results. Rows of equal ids
    and texts are placed one by one."""
    return sharding.shard(docs, keep=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources", mix_sources),
    ("sharding", shard_rows),
]

#: The first stage's model can't be expressed in SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
