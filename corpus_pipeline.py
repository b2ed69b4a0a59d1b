"""A corpus pipeline of four operators: toxicity, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.
Filters return the columns of documents; the last stage returns the packed pieces.
The classifiers learn from the labels of the documents they are given, outside the
folds that their queries hold out, and reject what the queries would predict.

Null texts are empty texts; without labels of both kinds a classifier scores every
document alike, so it keeps all or none by the threshold. Very long texts are read whole.
Equal and similar texts leave the document of least id, and one row where rows repeat;
rows without an id come last. Empty tables go through every stage and give no pieces.
Columns that documents have besides their own pass through the filters, whatever their
names; the packed pieces have the columns of packing.pack_documents().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import packing, quality, simhash, toxicity
from plumbline.llm.common import stored, table

THRESHOLD = 0.3
#: Words of a shingle, and the Jaccard similarity of shingle sets from which on documents are near-duplicates.
SHINGLE, SIMILARITY = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; all columns, repeated rows included."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep_by_score(docs, model, lambda scores: scores < THRESHOLD)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; all columns, repeated rows included."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep_by_score(docs, model, lambda scores: scores >= THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate class; all columns.

    Rows without an id come after the others; of rows that repeat the kept id one stays.
    """
    return simhash.keep_representatives(docs, width=SHINGLE, similarity=SIMILARITY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The placed pieces of all documents."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_good),
    ("simhash near-dedup", drop_near_duplicates),
    ("best-fit packing", pack),
]

#: The learned stages can't be said in SQL; tests/llm/test_pipeline.py checks run() against its parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        docs = made if name == STAGES[-1][0] else stored(made)
    return docs
