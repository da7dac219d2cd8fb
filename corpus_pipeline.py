"""From raw documents to packed training sequences: STAGES, and run() over the table ``documents``.

In every stage null texts count as empty, whole texts are read however long they are, repeated rows and ties are settled by
a fixed rule, an empty table gives an empty one, and further columns, whatever their names, are handed on (by all but the last stage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from epistle.llm import exact_dedup, jaccard_join, mixing, packing, quality_rules
from epistle.llm.common import staged
from epistle.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality rules reject, and the others' lines that are common on their host.

    Empty texts have too few words and go; rows without a host are one host; repeated rows are judged alike.
    """
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts: the longest, then the smallest id, null last; one of repeated rows."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked at a similarity of 0.8 on five-word shingles, that of the smallest id; rows without an id stay."""
    return jaccard_join.keep_one(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources reach their target weights; null is a source of its own, documents without words go."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and their places in sequences; an empty text is its end mark alone, long ones are cut."""
    return packing.packed(docs, tokenizer_path())


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]

#: Random rounding and tokenisation have no SQL; tests/llm/test_pipeline.py holds run() against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
