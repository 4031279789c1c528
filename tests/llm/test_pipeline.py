"""The pipeline: each stage's decisions take effect, clean documents stay, and all are packed once."""

import random

import corpus_pipeline
from loomtext.llm.common import without


def test_without(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "doc_id long, text string")
    assert sorted(r.text for r in without(docs, spark.createDataFrame([(2,)], "doc_id long")).collect()) == ["a", "c"]
    assert without(docs, spark.createDataFrame([], "doc_id long")).count() == 4


def test_stages(spark, tmp_path):
    r = random.Random(8)
    v = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(600)]
    text = lambda: [r.choice(v) for _ in range(80)]
    docs, labels = [], []
    for i in range(200):
        w = text()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                w[r.randrange(80)] = r.choice(["scum", "moron"])
        docs.append((i, " ".join(w), "s", "en", 1))
        if i < 150:
            labels.append((i, 1, int(toxic)))
    item = text()[:30]
    docs += [(300, docs[1][1], "s", "en", 1), (301, docs[1][1] + " end", "s", "en", 1), (302, " ".join(text() + item + text()), "s", "en", 1), (303, " ".join(text()) + " a.b@c.example.com", "s", "en", 1), (304, None, None, None, None)]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    own = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, own, d)
        if k < 4:
            assert out.columns == own.columns
            out.write.parquet(f"{d}/out{k}")
            own = spark.read.parquet(f"{d}/out{k}")
            kept[name] = {x.doc_id: x.text for x in own.collect()}
    toxic = {i for i in range(200) if i % 4 == 0}
    assert not toxic & set(kept["toxicity"]) and len(kept["toxicity"]) == len(docs) - 50
    assert set(kept["toxicity"]) - set(kept["near_dedup"]) == {300, 301}
    assert set(kept["near_dedup"]) - set(kept["decontamination"]) == {302}
    assert kept["pii"][303].endswith(" [email]") and kept["pii"].keys() == kept["decontamination"].keys()
    assert {x.doc_id for x in out.collect()} == set(kept["pii"])
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).drop("sequence_id", "offset").collect())) == sorted(map(tuple, out.drop("sequence_id", "offset").collect()))
