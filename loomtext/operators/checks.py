"""Corpus checks: keys, duplicates, misalignment, gaps, imbalance and leakage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def shared_ids(df: DataFrame, key: str = "id", columns: list[str] | None = None) -> DataFrame:
    """(id, n_rows, n_distinct) of ids that stand for several different rows."""
    content = F.sha2(F.to_json(F.struct(*(columns or [c for c in df.columns if c != key]))), 256)
    return df.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n_rows"), F.count_distinct(content).alias("n_distinct")).where("n_distinct > 1")


def distinct_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(n_rows, n_distinct) of whole rows."""
    cols = columns or df.columns
    return df.groupBy(F.sha2(F.to_json(F.struct(*cols)), 256).alias("h")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct"))


def in_both(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a that b holds too, null equal to null; rows meet by a digest, so wide texts are not moved twice."""
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    return a.withColumn("_d", digest).join(b.select(digest.alias("_d")).distinct(), "_d", "left_semi").drop("_d")


def off_band(df: DataFrame, source: str, target: str, low: float = 0.4, high: float = 2.5) -> DataFrame:
    """Rows whose word ratio lies outside the band, with the ratio; rows without words on the source side are left out."""
    ratio = F.try_divide(t.n_words(t.text(F.col(target))), t.n_words(t.text(F.col(source))))
    return df.withColumn("word_ratio", ratio).where(~F.col("word_ratio").between(low, high))


def missing_rates(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """(column, n_rows, n_missing, rate): blank and null count as missing."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (t.strip(t.text(F.col(c).cast("string"))) == "").cast("long").alias("gap")) for c in columns])).alias("x")
    one = df.select(*by, cells).select(*by, "x.*").groupBy(*by, "column")
    return one.agg(F.count("*").alias("n_rows"), F.sum("gap").alias("n_missing")).withColumn("rate", F.round(F.col("n_missing") / F.col("n_rows"), 6))


def imbalance(df: DataFrame, category: str = "category") -> DataFrame:
    """(category, n, share, times_smallest)."""
    one = df.groupBy(F.coalesce(F.col(category), F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))
    whole = one.agg(F.sum("n").alias("_all"), F.min("n").alias("_least"))
    return one.crossJoin(F.broadcast(whole)).select("category", "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"), F.round(F.col("n") / F.col("_least"), 6).alias("times_smallest"))


def leaked_exact(train: DataFrame, held: DataFrame, column: str = "text") -> DataFrame:
    """Rows of the training side whose text stands on the held-out side."""
    return in_both(train, held, [column])


def leaked_group(train: DataFrame, held: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the training side whose group is on the held-out side too."""
    return train.join(held.select(key).distinct(), key, "left_semi")


#: Characters of items that one pass over the documents looks for (some 300 MB as an automaton, in each worker).
PASS_CHARS = 5_000_000


def leaked_within(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id) where an item's text stands within a document's; blank items are left out.

    Items go to the tasks as an Aho-Corasick automaton, in blocks of bounded size: a document is read once per block,
    in time that grows with its length and not with the number of items. The plan has one branch for each block, so this
    is for held-out sets of up to some hundred million characters.
    """
    held, size, blocks = {}, 0, []
    for row in items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where(F.trim("t") != "").toLocalIterator():
        held.setdefault(row.t, []).append(row.i)
        size += len(row.t)
        if size >= PASS_CHARS:
            blocks, held, size = [*blocks, _scan(docs, held, doc_id, text)], {}, 0
    blocks.append(_scan(docs, held, doc_id, text))
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out


def _scan(docs: DataFrame, held: dict[str, list[int]], doc_id: str, text: str) -> DataFrame:
    terms = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        find = ahocorasick.Automaton()
        for t, ids in terms.value.items():
            find.add_word(t, ids)
        find.make_automaton()
        for batch in batches:
            rows = [(d, i) for d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if t and len(find) for i in sorted({i for _, ids in find.iter(t) for i in ids})]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["doc_id", "item_id"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, item_id long")
