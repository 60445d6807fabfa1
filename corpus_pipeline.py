"""A corpus pipeline over the table documents: each stage is written as Parquet and reread as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from letterlens.llm.common import Scratch, table
from letterlens.llm.exact_dedup import keep_one_of_equal
from letterlens.llm.mixing import mixed_documents
from letterlens.llm.near_copies import keep_one_of_copies
from letterlens.llm.packing import packed_texts
from letterlens.llm.quality_fm import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents one stays."""
    return keep_one_of_equal(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, texts with a Jaccard similarity of 0.8 in shingles of five words, one stays."""
    return keep_one_of_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come in their target weights; what a mix takes twice is there twice."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its text and its place in a packed sequence; row tells copies of an id apart."""
    return packed_texts(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("packing", packing)]

#: SQL cannot express the classifier; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
