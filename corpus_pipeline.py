"""A training-corpus pipeline over ``documents``: five stages, each written as
Parquet and reread as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterwise.llm import byte_bpe, mixing, quality, simhash, suffixes
from meterwise.llm.common import staged, table


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects; it learns from the labelled rows of ``docs``."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each SimHash component."""
    return simhash.one_of_each(docs)


#: A passage of 50 words has 200 bytes or more, unless its words have less than three on average.
PASSAGE_BYTES = 200


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every byte of a repeated string of PASSAGE_BYTES out of the texts; n_chars follows the text that is left."""
    left = suffixes.dedup(docs, returns="rows", length=PASSAGE_BYTES)
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every document as often as the mix of sources asks for."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document that is left, checked by decoding: their number and digests."""
    return byte_bpe.encode_documents(docs)


STAGES = [
    ("quality", accept_quality),
    ("simhash", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained scores, random rounding and byte-pair merges have no SQL form; tests/llm checks the rows stage by stage.
ORACLE_SQL = None
