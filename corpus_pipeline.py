"""From raw documents to packed training sequences, in five stages.

Each stage gets all that its predecessor kept, decides, and returns the columns of
`documents`; the last returns the pieces of the packed sequences. Between stages
the documents are written as Parquet and read again, so a lost executor costs no
more than a part of one stage. The session's Arrow batches are small from the first
stage on, since an executor serves all stages in turn.
"""

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from prefboard.llm import decontaminate, minhash, packing, quality, secret_scan
from prefboard.session import TEXT_BATCHES, materialise


def in_small_batches(stage):
    """The stage, in a session whose Arrow batches are small; its result may be written later."""

    @wraps(stage)
    def run(spark, docs, sf_dir):
        spark.conf.set(*TEXT_BATCHES)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir) -> DataFrame:
    """Documents the quality classifier accepts; it learns from the labels of these."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return minhash.drop_near_duplicates(docs)


@in_small_batches
def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir) -> DataFrame:
    """Documents of which less than a twentieth stands in benchmark items, without the
    spans of 13 and more words that do."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@in_small_batches
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir) -> DataFrame:
    """All documents; secrets in their texts are replaced by a mark."""
    return secret_scan.redact_secrets(docs)


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmarks),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: The stages learn, hash and pack; none of it can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
