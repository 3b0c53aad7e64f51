"""The corpus pipeline: language ID, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), where docs has the columns of ``documents``, and works on all
that its predecessor kept. The models are fitted on the tables below ``sf_dir``, as the operators' own queries do.
Nulls, empty texts, repeated rows and empty tables go through as each operator defines; see there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id, near_duplicates, packing, toxicity
from tessera.llm.common import durable, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text goes if no language has at least this share of its letters.
LEAST_LANGUAGE = 0.3
#: Or if its labels' languages know less than this share of its trigrams (in the 0.1 GB table the least of any text with a letter is 0.70).
LEAST_FIT = 0.6


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language: those without a letter go, those in which no language has a fair share of the letters, and those whose trigrams are not of a learned language."""
    model = language_id.production_model(spark, sf_dir)
    found = language_id.with_language(docs.select(*COLUMNS), model)
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE) & (F.col("fit") >= LEAST_FIT)).select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that aren't predicted toxic."""
    model = toxicity.production_model(spark, sf_dir)
    return toxicity.with_toxicity(docs.select(*COLUMNS), model).filter("predicted = 0").select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class: one of the smallest id (of a class that has no id, any one)."""
    return near_duplicates.first_of_classes(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicate), ("packing", pack)]
#: No SQL: tokenisation and learned models can't be expressed.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = durable(docs, f"pipeline-{name}")
    return docs
