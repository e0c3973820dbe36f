"""From raw documents to packed training sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, whole rows with the columns of documents; the last
returns the pieces and their places. A missing text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.llm import langid, quality, simhash
from pulsegrid.llm.common import free_name
from pulsegrid.llm.queries import packed, table
from pulsegrid.session import cut_lineage, ship_package

#: Below this probability of its likeliest language a document is in none.
LEAST_LANGUAGE_SCORE = 0.4
LEAST_QUALITY = 0.5


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that their ``lang`` column teaches; without letters or any likely language they go."""
    ship_package(spark)
    net = langid.train(docs, usable=quality.remainder("doc_id", 4) != 2)
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    marked = langid.predict(docs, net, out=lang, score=score)
    return marked.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by the labels of documents still there, doesn't take for bad."""
    ship_package(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"), usable=quality.remainder("doc_id", 3) != 1)
    score = free_name(docs, "quality_score")
    return quality.score(docs, model, out=score).where(F.col(score) >= LEAST_QUALITY).select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    ship_package(spark)
    return simhash.keep_one(docs)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, placed in sequences."""
    ship_package(spark)
    return packed(docs)


STAGES = [("language", in_a_language), ("quality", of_quality), ("near_copies", without_near_copies), ("packing", into_sequences)]

#: Networks, compression and tokenizers are beyond SQL; the tests hold the pipeline against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
