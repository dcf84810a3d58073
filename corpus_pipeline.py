"""A pipeline from raw documents to token ids; each stage is one operator of tallyworks.llm.

Every stage takes (spark, docs, sf_dir), works on all rows of docs, and all but the last return the
columns of docs: language identification drops texts without a language, exact and near
deduplication leave one row of each group, the mix repeats rows or leaves them out, and the last
stage gives each row's tokens.

Null and empty texts and those without a letter go in the first stage. Rows without an id stay like
others; where ids order rows, a null comes last. Rows that repeat are copies of one another. No
documents give no rows in any stage; other columns of docs, whatever their names, are carried along
up to the mix. Texts are worked on whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm import bpe, exact_dedup, language, mixing, near_dedup
from tallyworks.llm.common import checkpointed, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose text has a language; the filters are learned from docs."""
    return language.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of similar texts."""
    return near_dedup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the sha256 of what they decode to of every row."""
    return bpe.tokenised(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language id", identify), ("exact dedup", exact), ("n-gram jaccard join", near), ("source mix", mixed), ("bpe", tokens)]
#: SQL can't express the filters' hashes, nor the encoder; tests hold all stages against brute force and the tokenizers library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage returns is written to the shared folder before the next one."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
