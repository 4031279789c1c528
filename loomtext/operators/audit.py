"""Glossary audit: does each entry's rewriting move predictions towards the reference?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chrf import score_change


def edited(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.size("post_edits"), F.lit(0)) > 0)


def shares(df: DataFrame) -> DataFrame:
    """One row per edit of an edited row: its even share of the row's change in sentence chrF++."""
    scored = edited(df).withColumn("delta", score_change(F.col("prediction_raw"), F.col("prediction_final"), F.col("reference")))
    return scored.withColumn("share", F.col("delta") / F.size("post_edits")).withColumn("edit", F.explode("post_edits")).withColumns({"source_term": F.get("edit", 0), "target_term": F.get("edit", 1)}).drop("edit")


def glossary_audit(df: DataFrame, order: tuple[str, ...] = ("file_no", "example_idx"), by: tuple[str, ...] = (), band: float = 0.01) -> DataFrame:
    """A row for each entry that fired: times fired, helped, hurt and neither, net and mean change, and one example.

    The example is the last row that it hurt in scan order, else the first one. Sums are taken as decimals, so that they
    do not depend on the order of rows.
    """
    rows = shares(df).withColumn("_ord", F.struct(*order))
    example = F.struct(*[F.col(c) for c in ("example_file", "example_idx", "source", "prediction_raw", "prediction_final")])
    s = F.col("share")
    net = F.sum(s.cast("decimal(30,12)")).cast("double")
    got = rows.groupBy(*by, "source_term", "target_term").agg(
        F.count("*").alias("n_fired"), F.count_if(s > band).alias("n_helped"), F.count_if(s < -band).alias("n_hurt"), F.count_if((s <= band) & (s >= -band)).alias("n_neutral"), net.alias("net"),
        F.coalesce(F.max_by(F.when(s < 0, example), F.when(s < 0, F.col("_ord"))), F.min_by(example, "_ord")).alias("x"), F.min("_ord").alias("_first"),
    )
    return got.select(*by, "source_term", "target_term", "n_fired", "n_helped", "n_hurt", "n_neutral", F.round("net", 3).alias("net_chrf_delta"), F.round(F.col("net") / F.col("n_fired"), 4).alias("avg_chrf_delta"), F.col("x.example_file").alias("example_file"), F.col("x.example_idx").alias("example_idx"), F.col("x.source").alias("example_source"), F.col("x.prediction_raw").alias("example_raw"), F.col("x.prediction_final").alias("example_final"), "_first")


def worst_first(audit: DataFrame) -> DataFrame:
    return audit.orderBy("net_chrf_delta", "_first", "source_term", "target_term")


def extremes(audit: DataFrame, n: int = 10) -> DataFrame:
    """The n most harmful and the n most helpful entries, each with its rank at its end."""
    from pyspark.sql import Window

    keys = ["_first", "source_term", "target_term"]
    out = None
    for end, first in (("harmful", F.col("net_chrf_delta").asc()), ("helpful", F.col("net_chrf_delta").desc())):
        top = audit.orderBy(first, *keys).limit(n).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(end)).orderBy(first, *keys))).withColumn("end", F.lit(end))
        out = top if out is None else out.unionByName(top)
    return out


def audit_totals(df: DataFrame, *by: str) -> DataFrame:
    """Rows with edits and distinct entries that fired, over all rows or by direction and the like."""
    e = edited(df).select(*by, F.posexplode("post_edits").alias("at", "e"))
    return e.groupBy(*by).agg(F.count_if(F.col("at") == 0).alias("rows_with_edits"), F.count_distinct("e").alias("entries_fired"))
