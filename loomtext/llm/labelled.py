"""A bounded sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most: the bound that makes broadcasting them safe.
MAX_LABELLED = 4000


def sample(labels: DataFrame, columns: list[str], limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id and one 0/1 value per column for at most `limit` documents, chosen by a hash of doc_id.

    Repeated labels of a document are averaged and rounded up at one half; nulls are passed over.
    """
    means = [F.avg(F.col(c).cast("double")).alias(f"_{c}") for c in columns]
    one = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), *columns).groupBy("doc_id").agg(*means)
    one = one.dropna(subset=[f"_{c}" for c in columns]).select("doc_id", *[(F.col(f"_{c}") >= 0.5).cast("int").alias(c) for c in columns])
    return one.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(limit)
