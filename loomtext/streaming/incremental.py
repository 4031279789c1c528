"""Cleaning as files arrive: the row-wise part of the flow on a stream, with checkpointed progress instead of rewritten files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import validate
from ..operators.validate import Rules
from ..sources.io import PAIR


def checked_stream(spark: SparkSession, path: str, schema: str = PAIR, rules: Rules = Rules(), compose: bool = True) -> DataFrame:
    """New JSONL files under a path, normalized and with reasons. Dedup needs the whole corpus and is left to the batch flow."""
    rows = spark.readStream.schema(schema).json(path)
    return validate.validated(validate.normalized_pairs(rows, rules, compose), rules)


def start(rows: DataFrame, out: str, progress: str) -> StreamingQuery:
    """Appends what is there to Parquet and ends; a restart goes on where it stopped."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start()
