"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes all that its predecessor kept, written as Parquet and read
again; the stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talus.llm.common import table, write_table
from talus.llm.decontaminate import drop_contaminated
from talus.llm.jaccard import keep_one_per_class
from talus.llm.packing import lengths, pack
from talus.llm.quality import keep_good
from talus.llm.substring import cut_repeated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return keep_one_per_class(spark, docs, sf_dir)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has."""
    return cut_repeated(spark, docs, sf_dir)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(spark, docs, sf_dir)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin, capacity and offset of every piece of every document."""
    return pack(lengths(docs))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot express the stages; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_table(docs, f"stage-{name}")
    return docs
