"""From raw documents to token blocks: five stages, each on all that the one before kept.

1. toxicity: documents that score 0.5 or more by a model of the labels (those not held out) go.
2. near-dedup: of each group of documents that pairs connect whose five-word shingles are 0.8 or more alike (Jaccard), one stays.
3. decontamination: documents that share 13 words in a row with a benchmark item go, and those with 5 % or more of their words in shorter items.
4. mixing: sources are taken near their target shares; a document comes as often as the mix takes it.
5. token blocks: what is left is encoded, written and read back; a row for each document with its place, length and checksum.

All but the last return the columns of documents. Nulls, empty tables and repeated rows: see the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.minhash import near_copies
from tessera.llm.mixing import mixed_documents
from tessera.llm.rans import vocabulary, write_and_read
from tessera.llm.shared import stage
from tessera.llm.simhash import first_of_each
from tessera.llm.toxic import held_out, untoxic_documents
from tessera.llm.winnow import clean_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return untoxic_documents(docs, labels.where(~held_out(F.col("doc_id"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return first_of_each(docs, near_copies)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return write_and_read(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_blocks", token_blocks)]
#: Stages that draw hashes and train models are not SQL. tests/llm checks each operator by brute force; of the chain it checks that every stage keeps a part of what it got.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
