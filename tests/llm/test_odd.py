"""Odd input for every operator: nulls in any column, empty and very long texts, repeated rows, clashing columns, nothing at all."""

import random
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomtext.llm import common, cotraining, decontamination, licenses, lm_scoring, near_dedup, packing, pii, quality_rules, suffix_dedup, toxicity

from .test_exact import TOKENIZER

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, key long, n long, kind int, part long, band long, y int, model int, edits string, value double, item_id string, license_id string, digest string, held_out string"
CHAIN = {"low_quality": "1 - quality", "toxic": "toxic"}


def rows():
    r = random.Random(31)
    v = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(200)]
    long = " ".join(r.choice(v) for _ in range(60_000))  # some 300,000 characters
    texts = [" ".join(r.choice(v) for _ in range(r.randint(5, 60))) for _ in range(40)] + [None, "", " \n", long, "ab " * 60_000, "7 " * 20_000, "x" * 100_000]
    own = [*enumerate(texts), (None, texts[5]), (None, None), (None, texts[5])]
    out = [(i, t, "s" if k % 2 else None, "en" if k % 3 else None, len(t) if t and k % 5 else None, *[None if k % 4 else 1] * 3, None, *[1] * 3, "e", 0.5, "i", "l", "d", "h") for k, (i, t) in enumerate(own)]
    return [*out, out[3], out[3], out[43]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    odd = [(None, 1, 0, "a"), (3, None, 1, "b"), (4, 0, None, None), (5, 1, 1, "c"), (5, 0, 1, "c"), (5, 1, 1, "c"), (9999, 0, 1, "d")]
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0), "t") for i in range(6, 40)] + odd, "doc_id long, quality int, toxic int, text string")


def items(spark):
    own = rows()
    return spark.createDataFrame([(1, " ".join(own[7][1].split()[:20]), "t"), (2, "ab " * 100, None), (3, None, "u"), (4, "", "u"), (1, " ".join(own[7][1].split()[:20]), "t"), (None, own[8][1], None)], "item_id long, text string, doc_id string")


OPERATORS = {
    "cotraining": lambda s, d, y: cotraining.co_train(d, y),
    "quality_rules": lambda s, d, y: quality_rules.quality_rules(d, y),
    "near_duplicates": lambda s, d, y: near_dedup.near_duplicates(d),
    "licenses": lambda s, d, y: licenses.scan_licenses(d),
    "pii": lambda s, d, y: pii.find_pii(d),
    "lm_scores": lambda s, d, y: lm_scoring.lm_scores(d),
    "suffix_dedup": lambda s, d, y: suffix_dedup.remove_repeats(d),
    "toxicity": lambda s, d, y: toxicity.toxicity(d, y, CHAIN),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_document(spark, docs, labels, name):
    """Every row of the table has one, rows that repeat one another have equal ones, and no table has none."""
    found = [tuple(r) for r in OPERATORS[name](spark, docs, labels).collect()]
    assert sorted(r[0] is None for r in found) == sorted(r[0] is None for r in rows())
    assert sorted(r[0] for r in found if r[0] is not None) == sorted(r[0] for r in rows() if r[0] is not None)
    same = {r for r in found if r[0] == 3} | {r for r in found if r[0] == 43}
    if name in ("lm_scores", "cotraining", "quality_rules", "toxicity"):  # sums of equal numbers in another order
        same = {tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in same}
    assert len(same) == 2
    assert OPERATORS[name](spark, docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["cotraining", "quality_rules", "toxicity"])
def test_without_labels(spark, docs, labels, name):
    one_kind = labels.where("quality = 1 and toxic = 0")
    for some in (labels.limit(0), one_kind):
        assert OPERATORS[name](spark, docs.where("doc_id < 45"), some).count() == 48


def test_packing(docs):
    got = packing.pack(docs, TOKENIZER, capacity=512).collect()
    ends = [r for r in got if r.start + r.length < 512 or r.piece]
    assert len({(r.doc_id, r.ids_crc32) for r in ends if r.doc_id is None}) == 2 and sum(r.doc_id == 3 and not r.piece for r in got) == 3
    assert sum(r.length for r in got if r.doc_id == 43) % 2 == 0  # twice the same ids
    assert all(0 < r.length <= 512 for r in got)


def test_decontamination(spark, docs):
    got = decontamination.contaminated(docs, items(spark)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got if r.doc_id in (7, 8, 44) and r.item_id is not None) == [(7, 1), (7, 1), (44, 2)]
    assert (8, None, 0) in {(r.doc_id, r.item_id, r.edits) for r in got} and not {r.item_id for r in got} & {3, 4}
    assert decontamination.contaminated(docs.limit(0), items(spark)).count() == 0 and decontamination.contaminated(docs, items(spark).limit(0)).count() == 0


def test_pipeline_stages(spark, docs, labels, tmp_path):
    """All columns are handed on, nothing crashes, repeated rows count once, and no table gives none."""
    d = str(tmp_path)
    labels.write.parquet(f"{d}/labels.parquet")
    items(spark).write.parquet(f"{d}/benchmark.parquet")
    for table in (docs, docs.limit(0)):
        own = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            own = stage(spark, own, d)
            if k < 4:
                assert own.schema == docs.schema
            own = common.saved(own)
        assert bool(own.count()) == bool(table.count())
    left = corpus_pipeline.near(spark, docs, d).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in left if r.doc_id in (3, None)} == {3: 1, None: 3}
    private = {r.doc_id: r.text for r in corpus_pipeline.private(spark, docs, d).collect()}
    assert private[40] is None and private[41] == ""


def test_shared_folder(spark):
    """Without a shared folder a cluster is told so; tables can be cleared."""
    path = common.saved(spark.range(3)).inputFiles()[0].removeprefix("file://")
    assert re.match("/tmp/checkpoints/", path)
    common.clear(spark)
    with pytest.raises(FileNotFoundError):
        open(path)
    session = lambda master, folder: SimpleNamespace(conf={"spark.checkpoint.dir": folder}, sparkContext=SimpleNamespace(master=master, getConf=dict))
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        assert common.shared_dir(session(master, "hdfs:///x")) == "hdfs:///x"
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            common.shared_dir(session(master, None))
    assert common.shared_dir(session("local[4]", None)).startswith("file:///tmp/checkpoints/")


def test_filter_grows_with_its_ids(spark, monkeypatch):
    monkeypatch.setattr(common, "BLOOM_BITS", (8, 14))
    few, many = (common.bloom(spark.range(n)) for n in (5, 500))
    assert 64 * len(few) == 256 and 64 * len(many) == 8192 and 64 * len(common.bloom(spark.range(5000))) == 1 << 14
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    assert common.near_ids(docs, spark.range(500)).count() in range(500, 560) and common.without(docs, spark.range(500)).count() == 1500
