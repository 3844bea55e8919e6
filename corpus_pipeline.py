"""Training corpus from raw documents: quality, near copies, benchmark leaks, personal data, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a frame; all but the last keep the
columns of ``docs``. ``run`` writes each stage as Parquet below the cluster's shared folder and
reads it again for the next, so a lost executor costs no earlier stage.

Rows: a null text counts as empty and has no evidence of quality other than its metadata; repeated rows
are near copies of each other, one stays; null ids are carried; an empty table passes through
every stage. Extra columns go along up to packing, whose rows are pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from avisgrid.llm import decontamination, neardup, packing, pii, quality
from avisgrid.llm.common import table
from avisgrid.session import written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group."""
    return neardup.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item's question and answer."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    return packing.packed(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("near duplicates", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("personal data", mask_personal_data),
    ("best-fit packing", pack),
]

# Trained models, sketches and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
