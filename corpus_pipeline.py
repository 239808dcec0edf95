"""Corpus pipeline: quality, exact copies, near copies, mixing and tokens over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.bpe import encode
from corpusloom.llm.common import persist_to_shared, table
from corpusloom.llm.exact_dedup import drop_duplicates
from corpusloom.llm.jaccard_join import keep_one
from corpusloom.llm.mixing import apply_mix
from corpusloom.llm.quality import keep_good

#: No SQL: classifier, rounding and merges are not SQL-expressible. Tests hold every stage against plain Python.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: sets of five-word shingles, Jaccard similarity 0.8."""
    return keep_one(docs, size=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every document of the mix."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids")


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each result is written to the shared folder and read as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persist_to_shared(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
