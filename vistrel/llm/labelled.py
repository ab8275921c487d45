"""What the two classifiers share: which labels may be learnt from, and the bounded training sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a classifier is trained on at most: the first ones in the order of a hash of their ids.
TRAINING_ROWS = 12_000


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``fold``; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int = TRAINING_ROWS) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents outside the held-out fold.

    Where labels repeat an id the larger label counts. The chosen ids are bounded by ``rows``, so they are broadcast.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
