"""A training corpus from raw documents: five stages, each working on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm.common import materialise, read_table
from larkspur.llm.mixing import mixed_documents
from larkspur.llm.packing import packed, tokenizer_path
from larkspur.llm.quality import keep_good
from larkspur.llm.secrets import redact
from larkspur.llm.simhash import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the nearest labelled documents vote below 0.3; no row has a vote on its own text.

    Null texts are scored as empty ones; without labels every score is 0.5 and all stay; repeated rows stay together.
    """
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates.

    Null and empty texts are a group as any other; of rows alike in doc_id and text one stays; rows without doc_id all stay.
    """
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with secrets blanked out; null texts stay null, repeated rows stay."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws sources at their target weights: a row for each draw, dealt to shards by the splitting tree and shuffled.

    Null and empty texts have no words and are never drawn; a null source is a source of its own.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what was drawn into sequences: a row for each piece, with its ids; a null text is the end id alone."""
    return packed(docs, tokenizer_path(), ids=True)


STAGES = [("quality", quality), ("near-duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]
#: No stage but the last steps of mixing could be said in SQL; tests hold the whole against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`: a row for each piece of a sequence.

    Further columns, whatever their names, go through all stages but the last; an empty table gives no rows. Every stage
    but the last is written to the shared folder and read again.
    """
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
