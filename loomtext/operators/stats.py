"""Counts over validated and routed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def reason_histogram(df: DataFrame) -> DataFrame:
    """(reason, n): rows by reason, details left out."""
    return df.select(F.explode("reasons").alias("r")).groupBy(t.base_code(F.col("r")).alias("reason")).agg(F.count("*").alias("n"))


def clean_summary(df: DataFrame) -> DataFrame:
    """Rows in, kept, rejected, duplicate, and the percentage kept (null for no rows)."""
    kept = F.count_if(F.size("reasons") == 0)
    dup = F.count_if(F.array_contains("reasons", "duplicate"))
    return df.agg(F.count("*").alias("n_input"), kept.alias("n_clean"), (F.count("*") - kept).alias("n_rejected"), dup.alias("n_duplicate"), F.round(F.try_divide(kept * 100.0, F.count("*")), 4).alias("percent_kept"))


def length_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(side, n, min_words, max_words, total_words, avg_words) of each text column."""
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), t.n_words(t.text(F.col(c))).alias("w")) for c in columns])).alias("x")
    one = df.select(sides).select("x.*").groupBy("side")
    return one.agg(F.count("*").alias("n"), F.min("w").cast("long").alias("min_words"), F.max("w").cast("long").alias("max_words"), F.sum("w").alias("total_words"), F.round(F.sum("w") / F.count("*"), 4).alias("avg_words"))


def category_histogram(df: DataFrame, category: str = "category", missing: str = "unknown") -> DataFrame:
    """(category, n); a missing category counts as `missing`, an empty one as itself."""
    return df.groupBy(F.coalesce(F.col(category), F.lit(missing)).alias("category")).agg(F.count("*").alias("n"))
