"""Ordered keep-first dedup that keeps account of the losers, and the routing of rows to accepted and rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def pair_key(source: str = "mar", target: str = "bhb") -> Column:
    return F.concat(t.folded(t.text(F.col(source))), F.lit("|||"), t.folded(t.text(F.col(target))))


def keep_first(df: DataFrame, key: Column, order: list[str], mark: str = "is_duplicate") -> DataFrame:
    """Marks every row but the first of its key; a null key is a key of its own.

    The first place of each key is an aggregate over (key, place) alone that combines before the shuffle. Rows then meet
    the first places by their own place, which no two share, so neither a large key nor the work of making keys comes in
    again. `order` must tell rows apart: rows equal in it are alike.
    """
    return _marked(df, F.sha2(key, 256), order).withColumn(mark, F.col("_first").isNull()).drop("_first")


def _marked(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Adds `_first`: the row's place if it is the first of its key, else null."""
    place = F.struct(*order)
    first = df.select(F.coalesce(key, F.lit("")).alias("_key"), place.alias("_place")).groupBy("_key").agg(F.min("_place").alias("_first"))
    return df.join(first.select("_first"), place == F.col("_first"), "left")


def routed(df: DataFrame, order: list[str], source: str = "mar", target: str = "bhb", key: Column | None = None) -> DataFrame:
    """Of validated rows (with `reasons`): valid ones that repeat an earlier valid one get the reason duplicate.

    Accepted rows are those with no reason, so one frame serves both sinks. Rows that failed take no part in the dedup.
    """
    own = F.sha2(F.coalesce(pair_key(source, target) if key is None else key, F.lit("")), 256)
    # Failed rows share a key, whose first place marks none of the valid ones. (A filter would be pushed, with copies of
    # every rule, below the columns that the rules share.)
    found = _marked(df, F.when(F.size("reasons") == 0, own), order)
    late = (F.size("reasons") == 0) & F.col("_first").isNull()
    return found.withColumn("reasons", F.when(late, F.array(F.lit("duplicate"))).otherwise(F.col("reasons"))).drop("_first")


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.size("reasons") == 0).drop("reasons")


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.size("reasons") > 0).withColumnRenamed("reasons", "_rejection_reasons")
