"""From raw documents to packed token sequences, in five stages.

Each stage takes the documents that the one before kept and returns documents, all their
columns; the last returns pieces. Between stages the documents are Parquet files in the
shared folder. No stage reads a document's labels, language or source to decide on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.llm import language_id, quality
from linkforge.llm.exact_dedup import first_copies
from linkforge.llm.near_texts import near_texts
from linkforge.llm.packing import pack
from linkforge.llm.queries import table, vocabulary
from linkforge.llm.storage import discard, materialise

#: The upper grade's least probability, and the predicted language's.
LEAST_QUALITY, LEAST_LANGUAGE = 0.5, 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose probability of the upper grade is under LEAST_QUALITY."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.tail_probability(spark, model, 1.0)(F.col("text")) >= LEAST_QUALITY)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter, whose language is uncertain, or that are unlike all learned languages."""
    model = language_id.train(docs)
    floor = language_id.floors(docs, model)
    return docs.filter(language_id.certainty(spark, model, floor)(F.col("text")) >= LEAST_LANGUAGE)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each group of equal texts, that with the smallest id."""
    return first_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of texts alike in 0.8 of their five-word shingles, that with the smallest id; those without an id stay."""
    groups = near_texts(docs)
    kept = groups.filter("doc_id is null or doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, vocabulary())


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]

#: Classifiers, link components and packing have no SQL form; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs, path = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
