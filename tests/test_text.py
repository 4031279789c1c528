"""Text functions against Python's own behaviour."""

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.functions import text as t
from loomtext.functions.chrf import batch_counters, counters, f_score
from loomtext.functions.terms import Matcher, fold, greedy, spans

Z = "\u200d"
ALPHABET = "ab1 \t\n\u00a0\u2003\"\u201c.का\uff0c/,"


def col(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalized_cases(spark):
    got = col(spark, [f"क{Z}ष", "\u201ca\uff0cb\uff1f\u201d", "a.....b", "a..b", " ' x", ' "abc" ', None, "\u0915\u093c", "a\r\n b"], t.normalized)
    assert got == ["कष", "a,b?", "a...b", "a..b", "' x", '"abc"', "", "\u0915\u093c", "a b"]


def test_ws_is_pythons(spark):
    space = [chr(c) for c in range(0x10000) if chr(c).isspace()]
    assert col(spark, space, lambda c: t.strip(c)) == [""] * len(space)
    assert col(spark, ["\u200b", "a"], lambda c: t.strip(c)) == ["\u200b", "a"]


@settings(max_examples=5, deadline=None)
@given(values=st.lists(st.text(ALPHABET, max_size=25), min_size=40, max_size=60))
def test_random_texts(spark, values):
    assert col(spark, values, t.n_words) == [len(v.split()) for v in values]
    assert col(spark, values, t.folded) == [re.sub(r"\s+", "", v.lower()) for v in values]
    once = col(spark, values, t.normalized)
    assert all(x == unicodedata.normalize("NFC", x) for x in once)
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(values, values[1:], strict=False))], "i int, a string, b string")
    same = [r.n for r in pairs.select("i", t.similarity("a", "b").alias("n")).orderBy("i").collect()]
    assert same == [sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b)) if a or b else None for a, b in zip(values, values[1:], strict=False)]


def test_variants(spark):
    assert col(spark, ["A / B", "ab, cd", "a, bc", " x ", "ab, cd, e", "/x", ","], t.first_variant) == ["A", "ab", "a, bc", "x", "ab, cd, e", "", ","]


def test_top_share_and_labels(spark):
    assert col(spark, ["a a a a b c", "a a a a a"], t.top_share) == [4 / 6, 1.0]
    assert col(spark, ["x (17 chars)", "y"], t.base_code) == ["x", "y"]
    assert col(spark, ["ckp_19000", "final"], t.checkpoint_of) == [19000, None]


# ---- terms
G = {"बोंड": "कवठ", "कापूस पीक": "x", "कापूस": "y", "शेतकरी": "z", "same": "Same"}


def by_hand(text, keys, letters):
    out, at = [], 0
    inside = lambda i: 0 <= i < len(text) and re.match(f"[{letters}]", text[i])
    while at < len(text):
        for k in sorted(keys, key=len, reverse=True):
            if text.startswith(k, at) and not inside(at - 1) and not inside(at + len(k)):
                out.append((k, keys[k]))
                at += len(k)
                break
        else:
            at += 1
    return out


def test_term_cases():
    m = Matcher(G)
    assert m.find("कापूस पीक") == [("कापूस पीक", "x")]
    assert m.find("शेतकरी।") == [] and m.find("शेतकरी .") == [("शेतकरी", "z")]
    assert m.rewrite("बोंड", "बोंडअळी")[0] == "बोंडअळी"
    assert Matcher(G, "lenient").rewrite("बोंड", "बोंडअळी")[0] == "कवठअळी"
    for boundary in ("lenient", "suffix"):
        assert Matcher(G, boundary).rewrite("बोंड", "बोंडाला") == ("कवठाला", [["बोंड", "कवठ"]])
    assert m.rewrite("बोंड", "बोंड कवठ") == ("बोंड कवठ", [])
    assert m.rewrite("same", "same") == ("same", [])
    assert m.metrics("same बोंड", "Same कवठ") == (2, 2, 1, 1)
    assert m.metrics(None, None) == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        Matcher({}, "other")


@settings(max_examples=300, deadline=None)
@given(text=st.text("abc कख", max_size=30), keys=st.lists(st.text("abc कख", min_size=1, max_size=4), max_size=8))
def test_find_by_hand(text, keys):
    g = {k: k.upper() for k in keys}
    want = by_hand(text, g, "\u0900-\u097f")
    assert Matcher(g).find(text) == want
    longest = max(map(len, keys), default=0)
    assert greedy([(at, s, g[s]) for at, s in spans(text, longest) if s in g]) == want
    assert Matcher({}).rewrite(text, text) == (text, [])


def test_fold():
    assert fold("A \u00a0b\n") == "ab"


def test_suffixes_cover_the_published_list():
    """The shorter list of inflections allows what the whole published one does."""
    # The inflections as published.
    published = ["ांच्या", "ांची", "ांचा", "ांचे", "ांना", "ातील", "ासाठी", "ामध्ये", "ाकडे", "ाहून", "ापर्यंत", "ाप्रमाणे", "ाला", "ाना", "ाने", "ाशी", "ावर", "ात", "ाचा", "ाची", "ाचे", "साठी", "मध्ये", "कडे", "हून", "पर्यंत", "प्रमाणे", "च्या", "ची", "चा", "चे", "ला", "ना", "ने", "शी", "तील", "ां", "त", "ो", "ी", "े", "ा"]
    m = Matcher({"बोंड": "कवठ"})
    for s in published:
        assert m.rewrite("बोंड", f"बोंड{s}")[0] == f"कवठ{s}", s


# ---- chrF
def test_chrf_by_hand():
    c = counters("the cat.", "the cat.")
    assert f_score(c) == pytest.approx(100) and len(c) == 24
    assert f_score(counters("abc", "xyz")) == 0.0
    assert f_score(counters("", "xyz")) == 0.0
    c = counters("ab", "abc")
    assert c[:9] == [2, 3, 2, 1, 2, 1, 0, 1, 0] and c[18:21] == [1, 1, 0]
    p, r = (1 + 1 + 0) / 3, (2 / 3 + 1 / 2 + 0) / 3
    assert f_score(c) == pytest.approx(500 * p * r / (4 * p + r))
    assert counters("cat.", "x")[18] == 2  # the mark is a word of its own


def by_table(hypothesis, reference):
    """The 24 numbers from a table of n-grams for each order."""
    from collections import Counter
    from string import punctuation as marks

    def units(t):
        words = []
        for w in (t or "").split():
            words += [w[:-1], w[-1]] if len(w) > 1 and w[-1] in marks else [w[0], w[1:]] if len(w) > 1 and w[0] in marks else [w]
        return "".join((t or "").split()), words

    out = []
    for k, orders in ((0, range(1, 7)), (1, range(1, 3))):
        for n in orders:
            a, b = (Counter(tuple(u[k][i : i + n]) for i in range(len(u[k]) - n + 1)) for u in (units(hypothesis), units(reference)))
            out += [a.total(), b.total(), (a & b).total()]
    return out


@settings(max_examples=60, deadline=None)
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.text("ab .,क\u4e00\U0001f600", max_size=30)), st.one_of(st.none(), st.text("ab .,क", max_size=30))), max_size=12), wide=st.booleans())
def test_batch_counters(rows, wide):
    if wide:  # so many letters that n-grams are numbered by ranks
        rows = [*rows, ("".join(map(chr, range(0x4E00, 0x6200))), "".join(map(chr, range(0x5000, 0x5200))))]
    hypotheses, reference = [h for h, _ in rows], [r for _, r in rows]
    own, same = batch_counters([hypotheses, reference], reference)
    assert own.tolist() == [by_table(h, r) for h, r in rows] and (same[:, 0::3] == same[:, 2::3]).all()
