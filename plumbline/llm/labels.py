"""Labelled rows for the classifiers: folds, and a bounded training sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_column: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's text falls in the fold; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, label, text) of at most `most` documents with a label, outside the held-out fold.

    Which ones depends only on a hash of the id. An id labelled more than once has
    the mean label, 0.5 counting as 1; null labels and ids are left out. Of several
    texts of an id the one of least hash teaches.
    """
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label).alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    own = own.where(~held_out("doc_id", folds, fold)).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    some = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return texts.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
