"""A corpus pipeline: language, quality, near-duplicates, mixing, encoding.

``run(spark, sf_dir)`` applies the stages of ``STAGES`` to the table documents, each to what the one
before kept. A row travels through the classifying stages as one packed column, so documents may have
columns of any names. An empty table stays empty; what nulls, ties and repeated rows lead to is told in
each operator's module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm import bpe, language, mixing, quality, simhash
from rangeloom.llm.common import new_place, stored, table
from rangeloom.plans.lineage import remove


def _packed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without a letter, or of uncertain language, go."""
    found = language.identified(_packed(docs), language.fit(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= language.ACCEPT)).select("__row.*")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(_packed(docs), model).where("predicted = 1").select("__row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    return simhash.first_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, by output shard and in each shard's order: twice where a source repeats, cut where the drawn blocks end."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's tokens: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.digests(docs, bpe.default_path())


STAGES = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL has neither the trained models nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage before it is written as Parquet to the shared folder and read again, and then what it read is removed."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            place = new_place(spark)
            docs = stored(docs, place)
            if before:
                remove(spark, before)
            before = place
    return docs
