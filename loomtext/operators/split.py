"""Seeded shuffles, splits and samples by hash order: repeatable on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def draw(seed: int, *keys: str) -> Column:
    """A row's place in the seeded order. The keys must tell rows apart."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def split_exact(df: DataFrame, size: int, keys: list[str], seed: int = 42) -> DataFrame:
    """Marks exactly `size` rows (all, if there are fewer) as test, the others as train.

    The bound is the size-th smallest place: found by a top-k that takes `size` places from each task, and then compared,
    so the rows themselves are neither sorted nor moved.
    """
    if size <= 0:
        return df.withColumn("split", F.lit("train"))
    places = df.select(draw(seed, *keys).alias("place")).orderBy("place").limit(size)
    bound = places.agg(F.max("place").alias("_bound"))
    return df.crossJoin(F.broadcast(bound)).withColumn("split", F.when(draw(seed, *keys) <= F.col("_bound"), "test").otherwise("train")).drop("_bound")


def split_fraction(df: DataFrame, fraction: float, keys: list[str], seed: int = 42) -> DataFrame:
    """Marks about this fraction as test, by hash; rows that share the keys are on one side, so keys can be a group's."""
    bucket = F.conv(F.left(draw(seed, *keys), F.lit(8)), 16, 10).cast("long")
    return df.withColumn("split", F.when(bucket < int(fraction * 2**32), "test").otherwise("train"))


def shuffled(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    return df.orderBy(draw(seed, *keys))


def sampled(df: DataFrame, n: int | None, keys: list[str], order: list[Column], seed: int = 42) -> DataFrame:
    """At most n rows without replacement, then in the given order; all rows as they are if there are no more than n.

    n = 0 or None stands for all. Whether to sample is seen from at most n + 1 rows.
    """
    if not n or len(df.limit(n + 1).select(F.lit(1)).collect()) <= n:
        return df
    return df.orderBy(draw(seed, *keys)).limit(n).orderBy(*order)


def oversampled(main: DataFrame, targeted: DataFrame, times: int = 3) -> DataFrame:
    """main and `times` copies of targeted; `copy` tells them apart (0 for main)."""
    copies = F.explode(F.sequence(F.lit(1), F.lit(times))) if times > 0 else F.lit(0)
    more = targeted.withColumn("copy", copies)
    return main.withColumn("copy", F.lit(0)).unionByName(more if times > 0 else more.limit(0), allowMissingColumns=True)
