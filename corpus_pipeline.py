"""The corpus pipeline: toxic documents go, one of each group of near duplicates stays, benchmark leaks go, personal data
is masked, and what is left is packed into sequences. Each stage takes (spark, docs, sf_dir) and works on what the one
before it kept; all but the last hand on every column of the documents.

Defined cases, of every stage: null and empty texts are documents like others (they are not toxic, have no copies and no
leaks, and pack as their end alone). A document without id can't be named, so neither the copies nor the leaks stage
drops it. Ids that are there more than once: see `near`. An empty table gives an empty one. Ties go to the smaller id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomtext.llm.common import near_ids, read, saved, without
from loomtext.llm.decontamination import contaminated
from loomtext.llm.near_dedup import near_duplicates
from loomtext.llm.packing import pack
from loomtext.llm.pii import mask_pii
from loomtext.llm.queries import CHAIN
from loomtext.llm.toxicity import drop_toxic


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, by a chain fitted on the labels; without labels all stay. Repeated rows fare alike."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"), CHAIN)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by 0.8 or more of its runs of five words: that of the smallest id.

    Rows that repeat both id and text are one document; different texts of one id go or stay together.
    """
    left = without(docs, saved(near_duplicates(docs).where("not kept").select("doc_id")))
    again = saved(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return left
    left = saved(left)
    return without(left, again).unionByName(near_ids(left, again).join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, not even with a fifth of its words changed."""
    return without(docs, saved(contaminated(docs, read(spark, sf_dir, "benchmark")).select("doc_id")))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts masked."""
    return mask_pii(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequences and places; repeated rows are packed once each."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxic), ("near_dedup", near), ("decontamination", leaks), ("pii", private), ("packing", packed)]
#: Fitted models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not k else saved(docs), sf_dir)
    return docs
