"""Corpus pipeline: quality, near duplicates, benchmark passages, source mix, token files.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept. The first
four return the columns of documents; the last writes the token files and returns one row for
each document in them.

A null or blank text is scored like any other, is nobody's duplicate and holds no item, but the mix
takes no words from it, so it is not in the files. Rows that share an id are one document for
duplicates and benchmark items, and rows of their own in the mix. Texts of any length are read
whole. Equal scores, sizes and ranks are decided by hashes and ids, so reruns agree. Further
columns are carried along to the mix, whatever their names, but for names in double
underscores, which the operators use. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chainweft.llm import decontaminate, mixing, neardup, quality, tokens
from chainweft.llm.text import table
from chainweft.session import materialise

QUALITY = 0.7
SIMILARITY = 85
CONTAINMENT = 0.8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.passing(docs, table(spark, sf_dir, "labels"), QUALITY)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id."""
    return neardup.deduplicated(docs, SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), CONTAINMENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    return mixing.repeated(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; a row for each document in them, repeats counted: doc_id, start, n_tokens, ids_crc32."""
    return tokens.digests(tokens.written(docs))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: A trained classifier, Newton steps and a tokenizer are beyond SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
