"""Fitted operators against plain Python versions of the whole method, on tiny tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import cotraining, toxicity
from loomtext.llm.common import U64, rolled
from loomtext.llm.linear import folds, logistic

sigmoid = lambda z: 1 / (1 + math.exp(-z))


# ---- co-training
def _odds(counts, prior, width):
    whole = [sum(counts[k].values()) for k in (0, 1)]
    return lambda f: math.log((counts[1][f] + prior) / (whole[1] + prior * width)) - math.log((counts[0][f] + prior) / (whole[0] + prior * width))


def plain_co_training(docs, labels, held_out, rounds, sure):
    """docs: (id, text, source, lang, n_chars); labels: id -> 0 or 1; held_out: ids that calibrate. Probabilities by id."""
    number = lambda s: int(rolled(np.array([ord(c) for c in s], U64), 3)[0] >> U64(64 - cotraining.TEXT_BITS))
    triples = {d[0]: [number(d[1][i : i + 3]) for i in range(len(d[1] or "") - 2)] for d in docs}
    meta = {d[0]: [("source", d[2]), ("lang", d[3]), ("size", math.floor(math.log2(max(d[4], 1))))] for d in docs}
    seed = ([Counter(), Counter()], [Counter(), Counter()])
    for i, y in labels.items():
        if i not in held_out:
            seed[0][y].update(triples[i])
            seed[1][y].update(meta[i])
    trial = sorted(i for i in labels if i in held_out)
    y = np.array([labels[i] for i in trial], float)
    half = folds(np.array(trial), 2)

    def fitted(counts):
        text, other = _odds(counts[0], cotraining.TEXT_PRIOR, 1 << cotraining.TEXT_BITS), _odds(counts[1], cotraining.META_PRIOR, 1 << cotraining.META_BITS)
        views = [lambda i: sum(map(text, triples[i])) / max(len(triples[i]), 1), lambda i: sum(map(other, meta[i]))]
        margins = [np.array([v(i) for i in trial]) for v in views]
        both = []
        for m in margins:
            z = np.empty(len(m))
            for k in (0, 1):
                a, b = logistic(m[half != k][:, None], y[half != k])
                z[half == k] = a * m[half == k] + b
            both.append(z)
        return views, [logistic(m[:, None], y) for m in margins], logistic(np.column_stack(both), y)

    views, platt, both = fitted(seed)
    for _ in range(rounds):
        more = ([Counter(c) for c in seed[0]], [Counter(c) for c in seed[1]])
        for d in docs:
            if d[0] in labels:
                continue
            p = [sigmoid(a * v(d[0]) + b) for v, (a, b) in zip(views, platt, strict=True)]
            said = [1 if q >= sure else 0 if q <= 1 - sure else None for q in p]
            if said[1] is not None:
                more[0][said[1]].update(triples[d[0]])
            if said[0] is not None:
                more[1][said[0]].update(meta[d[0]])
        views, platt, both = fitted(more)
    out = {}
    for d in docs:
        z = [a * v(d[0]) + b for v, (a, b) in zip(views, platt, strict=True)]
        out[d[0]] = (sigmoid(z[0]), sigmoid(z[1]), sigmoid(both[0] * z[0] + both[1] * z[1] + both[2]))
    return out


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_co_training(spark, rounds):
    r = random.Random(12)
    docs, labels = [], {}
    for i in range(160):
        good = r.random() < 0.5
        text = "".join(r.choice("aabc " if good else "abbc #") for _ in range(r.randint(0, 60)))
        docs.append((i, text, f"s{r.choice([0, 1] if good else [1, 2])}", r.choice(["en", "fr"]), max(1, 2 * len(text) if good else len(text))))
        if i < 90:
            labels[i] = int(good)
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long")
    held_out = {x.doc_id for x in frame.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) == 0).collect()}
    want = plain_co_training(docs, labels, held_out, rounds, 0.9)
    got = cotraining.co_train(frame, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), rounds=rounds, sure=0.9).collect()
    assert len(got) == 160
    for x in got:
        assert (x.text_prob, x.meta_prob, x.quality_prob) == pytest.approx(want[x.doc_id], abs=1e-6) and x.kept == (x.quality_prob >= 0.5)


# ---- classifier chains
def _features(text):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = {("word", w) for w in words} | {("pair", *p) for p in zip(words, words[1:], strict=False)}
    for size in toxicity.STEMS:
        for stem, n in Counter(w.encode()[:size] for w in words if len(w.encode()) >= size).items():
            out |= {("stem", size, least, stem) for least in toxicity.STEM_TIMES if n >= least}
    return out


def _fit(rows, y, extra):
    """Weights of telling features, of the extra columns, and the bias, by full-batch Adam; rows: sets of features."""
    n, up = len(y), sum(y)
    if len(set(y)) < 2:
        share = min(max(up / n, 1e-3), 1 - 1e-3)
        return {}, [0.0] * len(extra[0]), math.log(share / (1 - share))
    have, good = Counter(f for x in rows for f in x), Counter(f for x, k in zip(rows, y, strict=True) if k for f in x)
    telling = {}
    for f, c in have.items():
        a, up1, n1 = good[f], up + 1, n + 2
        ratio = math.log((a + 0.5) / (up1 - a + 0.5)) - math.log((c - a + 0.5) / (n1 - up1 - (c - a) + 0.5))
        error = math.sqrt(1 / (a + 0.5) + 1 / (c - a + 0.5) + 1 / (up1 - a + 0.5) + 1 / (n1 - up1 - c + a + 0.5))
        if c >= toxicity.LEAST_TEXTS and abs(ratio) > toxicity.LEAST_Z * error:
            telling[f] = len(telling)
    own, k, width = [[telling[f] for f in x if f in telling] for x in rows], len(telling), len(extra[0])
    share = min(max(up / n, 1e-3), 1 - 1e-3)
    w = [0.0] * (k + width) + [math.log(share / (1 - share))]
    m, v = [0.0] * len(w), [0.0] * len(w)
    for t in range(1, 201):
        g = [0.3 * x / n for x in w[:-1]] + [0.0]
        for f, e, goal in zip(own, extra, y, strict=True):
            miss = (sigmoid(sum(w[i] for i in f) + sum(a * b for a, b in zip(e, w[k:], strict=False)) + w[-1]) - goal) / n
            for i in f:
                g[i] += miss
            for j, a in enumerate(e):
                g[k + j] += miss * a
            g[-1] += miss
        for i, x in enumerate(g):
            m[i], v[i] = 0.9 * m[i] + 0.1 * x, 0.99 * v[i] + 0.01 * x * x
            w[i] -= 0.1 * (m[i] / (1 - 0.9**t)) / (math.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    return {f: w[i] for f, i in telling.items()}, w[k : k + width], w[-1]


def plain_chain(train, labels, docs):
    """train: id -> text; labels: id -> tuple; docs: id -> text. Each document's probability of each category."""
    ids = sorted(labels)
    rows, all_rows = [_features(train[i]) for i in ids], {i: _features(t) for i, t in docs.items()}
    margin = lambda model, x, e: sum(model[0].get(f, 0.0) for f in x) + sum(a * b for a, b in zip(e, model[1], strict=True)) + model[2]
    fold, earlier, out = folds(np.array(ids), 3).tolist(), [[] for _ in ids], {i: [] for i in docs}
    for k in range(len(labels[ids[0]])):
        y = [labels[i][k] for i in ids]
        model = _fit(rows, y, earlier)
        z = [margin(model, x, e) for x, e in zip(rows, earlier, strict=True)]
        for f in range(3):
            inside = [j for j in range(len(ids)) if fold[j] != f]
            part = _fit([rows[j] for j in inside], [y[j] for j in inside], [earlier[j] for j in inside])
            for j in range(len(ids)):
                if fold[j] == f:
                    z[j] = margin(part, rows[j], earlier[j])
        slope, shift = logistic(np.array(z)[:, None], np.array(y, float))
        for i, x in all_rows.items():
            out[i] = [*out[i], sigmoid(slope * margin(model, x, out[i]) + shift)]
        earlier = [[*e, sigmoid(slope * q + shift)] for e, q in zip(earlier, z, strict=True)]
    return out


def test_toxicity_chain(spark):
    r = random.Random(21)
    v = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 9))) for _ in range(60)]
    docs, labels = {}, {}
    for i in range(130):
        bad = r.random() < 0.5
        toxic = r.random() < (0.8 if bad else 0.1)
        w = [r.choice(v) for _ in range(20)] + (["Zugzwang", "meh"] if bad and r.random() < 0.9 else []) + (["scumming"] * r.randint(1, 4) if toxic and r.random() < 0.9 else [])
        r.shuffle(w)
        docs[i] = ", ".join(w)
        if i < 100:
            labels[i] = (int(bad), int(toxic))
    docs |= {200: None, 201: ""}
    want = plain_chain(docs, labels, docs)
    got = toxicity.toxicity(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([(i, *y) for i, y in labels.items()], "doc_id long, bad int, toxic int"), {"bad": "bad", "toxic": "toxic"}).collect()
    assert len(got) == len(docs)
    for x in got:
        assert (x.p_bad, x.p_toxic) == pytest.approx(want[x.doc_id], abs=1e-4) and x.toxic == (x.p_toxic >= 0.5) and x.kept != x.toxic
    assert sum(x.toxic for x in got) > 20
