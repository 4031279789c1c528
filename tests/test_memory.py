"""What Python workers hold: one worker a task where one can do the work, stretches of bounded size, no pandas."""

import pickle
import re
import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa

from loomtext.functions import batches, chrf, terms, text
from loomtext.operators import audit, glossary, translate


def python_steps(df):
    return len(re.findall(r"\bArrowEvalPython\b", df._jdf.queryExecution().executedPlan().toString()))


def edited_rows(spark):
    df = spark.createDataFrame([(0, i, "f", "a", "बोंड पीक", "बोंड पीक बोंडाला", "कवठ पीक") for i in range(3)], "file_no int, example_idx int, example_file string, category string, source string, prediction_raw string, reference string")
    return glossary.post_edited(df, spark.createDataFrame([("बोंड", "कवठ"), ("पीक", "पीक")], "src string, tgt string"), prediction="prediction_raw")


def test_each_row_is_edited_once(spark):
    rows = edited_rows(spark)
    assert {(r.prediction_final, str(r.post_edits)) for r in rows.collect()} == {("कवठ पीक कवठाला", "[['बोंड', 'कवठ']]")}
    got = audit.glossary_audit(rows)
    assert python_steps(got) == 2 and [(r.source_term, r.n_fired, r.n_helped) for r in got.collect()] == [("बोंड", 3, 3)]


def test_review_and_its_sample_edit_each_row_once(spark):
    got = translate.review_rows(edited_rows(spark), 2)
    assert python_steps(got) == 1 and [(r.num_edits, r.changed_by_postedit) for r in got.collect()] == [(1, "yes")] * 2


def test_totals_edit_each_row_once(spark):
    got = audit.audit_totals(edited_rows(spark), "category")
    assert python_steps(got) == 1 and [tuple(r) for r in got.collect()] == [("a", 3, 1)]


def test_extremes_edit_each_row_once_at_each_end(spark):
    got = audit.extremes(audit.glossary_audit(edited_rows(spark)), 1)
    assert python_steps(got) <= 4 and [r.end for r in got.collect()] == ["harmful", "helpful"]


def test_glossaries_sent_and_joined_edit_alike(spark):
    df = spark.createDataFrame([(0, "बोंड पीक", "बोंड पीक"), (1, None, None), (2, "x", "बोंड")], "i int, source string, prediction string")
    g = spark.createDataFrame([("बोंड", "कवठ"), ("पीक", "फल")], "src string, tgt string")
    both = [{r.i: tuple(r) for r in f(df, g, prediction="prediction", sent=sent).drop("source", "prediction").collect()} for f in (glossary.post_edited, glossary.with_metrics) for sent in (True, False)]
    assert both[0] == both[1] == {0: (0, "कवठ फल", [["बोंड", "कवठ"], ["पीक", "फल"]]), 1: (1, "", []), 2: (2, "बोंड", [])}
    assert both[2] == both[3] == {0: (0, 0, 2, 0, 2), 1: (1, 0, 0, 0, 0), 2: (2, 0, 0, 0, 0)}


def test_matcher_keeps_nothing_of_what_it_met():
    m = terms.Matcher({f"अ{chr(0x915 + i)}": "क" for i in range(20)})
    before = len(pickle.dumps(m))
    assert sum(len(m.rewrite(t, f"{t}ला {t}अळी")[1]) for t in m.terms) == 20
    assert len(pickle.dumps(m)) == before
    assert terms.Matcher({"aa": "b"}, letters="x").rewrite("aa", "aaa aaaa")[0] == "ba bb"


def test_stretches_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(batches, "PART_ROWS", 3)
    monkeypatch.setattr(batches, "PART_BYTES", 10)
    a, b = pa.array(["x" * 4, None, "é", "y" * 50, "", "z", "z", "z", "z"]), pa.array([[], None, [["p", "q"]], *[[]] * 6])
    parts = list(batches.stretches(a, b))
    assert pa.concat_arrays([p[0] for p in parts]).equals(a) and pa.concat_arrays([p[1] for p in parts]).equals(b)
    assert [len(p[0]) for p in parts] == [2, 1, 1, 3, 2]
    assert batches.worked(lambda xs: xs, batches.strings, a).equals(a) and len(batches.worked(lambda xs: xs, batches.doubles, a[:0])) == 0
    assert batches.doubles([1.5, None]).to_pylist() == [1.5, None] and batches.structs(n=batches.ints, s=batches.lists(batches.strings))([(1, ["a", None])]).to_pylist() == [{"n": 1, "s": ["a", None]}]

def test_arrays_are_made_without_pandas():
    code = """
import sys, pyarrow as pa
from loomtext.functions import batches as b, chrf, text, terms
made = b.strings(["a", None, "e\\u0301"])
for x in (b.worked(lambda xs: xs, b.strings, made), text.nfc.func(made), text.similarity.func(made, made), text.top_share.func(made), chrf.sentence_score.func(made, made), chrf.chrf_counters.func(made, made)):
    print(len(x), end=" ")
print("pandas" in sys.modules)
"""
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split() == [*["3"] * 6, "False"]


def test_normal_form_copies_only_what_it_changes(monkeypatch):
    monkeypatch.setattr(batches, "PART_ROWS", 2)
    plain, mixed = pa.array(["a", None, "\u00e9", "", "\u0915\u093c"]), pa.array(["a", None, "e\u0301", "x", "\u0958", None])
    assert text.nfc.func(plain) is plain and len(text.nfc.func(plain[:0])) == 0
    assert text.nfc.func(mixed).to_pylist() == ["a", None, "\u00e9", "x", "\u0915\u093c", None]


def test_similarity_and_shares_over_stretches(monkeypatch):
    monkeypatch.setattr(batches, "PART_ROWS", 2)
    a, b = pa.array(["ab", "", None, "x", "क"]), pa.array(["ac", None, "", None, "क"])
    assert text.similarity.func(a, b).to_pylist() == [0.5, None, None, 0.0, 1.0]
    assert text.top_share.func(pa.array(["a a b b", None, " ", "x", "y y z"])).to_pylist() == [0.5, None, None, 1.0, 2 / 3]
    assert len(list(batches.stretches(a, b))) == 3


def peak_mb(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def chrf_texts(rows):
    words = ["".join(map(chr, 97 + np.random.default_rng(i).integers(0, 26, 6))) for i in range(300)]
    return pa.array([" ".join(words[(i * 7 + k * k) % 300] for k in range(60)) for i in range(rows)])


def test_counters_of_a_batch_are_bounded():
    own = chrf_texts(3000)
    assert peak_mb(lambda: chrf.batch_counters([own.to_pylist()], own.to_pylist())) < 40
    assert chrf.chrf_counters.func(own[:600], own[1:601]).to_pylist() == chrf.batch_counters([own[:600].to_pylist()], own[1:601].to_pylist())[0].tolist()


def test_scores_of_a_batch_are_bounded():
    own = chrf_texts(3000)
    assert peak_mb(lambda: chrf.sentence_score.func(own, own)) < 40 and set(chrf.sentence_score.func(own[:5], own[:5]).to_pylist()) == {100.0}


def test_normal_form_holds_a_stretch_at_a_time():
    own = pa.array(["\u00e9" * 5000] * 4000)
    assert peak_mb(lambda: text.nfc.func(own)) < 10
