"""A training corpus in four stages: language, quality, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; the first three return the
columns of documents, the last the packed pieces. Columns of docs beyond doc_id, text and lang are carried along untouched, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm.common import stored
from quarryline.llm.language_id import keep_languages
from quarryline.llm.ngram_jaccard import keep_one
from quarryline.llm.packing import best_fit_packing
from quarryline.llm.quality import keep_good


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents whose language can't be told go.

    Null, empty and letterless texts go; a null lang or doc_id is no reason to go; equal texts are judged alike; texts of any length are
    judged whole; with no labelled text to learn from, all go.
    """
    return keep_languages(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that are likelier bad than good go.

    A null text is judged as the empty one; labels that are null, repeated or of unknown documents do no harm; with labels of one
    value or none, all have 0.5 and stay; a null doc_id is no reason to go; equal texts are judged alike.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group the row of smallest doc_id stays (ties: the smaller hash of the text), once.

    Texts without words are linked with nothing and stay, each different (doc_id, text) once; rows that share a doc_id but not
    the text are documents of their own; rows without doc_id go, as packing can't name them.
    """
    return keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: every document's pieces with their sequence and offset.

    A null text is the empty one, which still packs its end id; rows without doc_id are left out; repeated rows are packed each;
    texts longer than a sequence are cut, none is dropped.
    """
    return best_fit_packing(docs)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("packing", packing)]

#: The stages can't be expressed in SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
