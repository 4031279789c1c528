"""Operators with fitted models: exact parts against plain versions, models by held-out accuracy and by brute force."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from loomtext.llm import common, cotraining, decontamination, labelled, licenses, linear, lm_scoring, pii, quality_rules, toxicity

from . import brute

TOXIC = ["scum", "moron", "worthless"]


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents with a mark for bad quality and words for toxicity, and their labels."""
    r = random.Random(1)
    v = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 6))) for _ in range(300)]
    docs, labels = [], []
    for i in range(420):
        w = [r.choice(v) for _ in range(60)]
        bad, toxic = r.random() < 0.3, r.random() < 0.25
        if bad:
            w = [x + r.choice(["###", "$$$"]) for x in w]
        if toxic:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(TOXIC)
        docs.append((i, " ".join(w), f"s{i % 3}", "en" if i % 7 else None, len(" ".join(w)), 0))
        labels.append((i, int(not bad), int(toxic)))
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long, quality int")
    return frame, spark.createDataFrame(labels[:300] + labels[:5] + [(None, 1, 1), (999, None, None)], "doc_id long, quality int, toxic int"), labels


def test_quality_rules(spark, corpus):
    rows = brute.rows()
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    got = quality_rules.quality_rules(docs, corpus[1].limit(0)).collect()
    want = {r[0]: brute.rules(r[1]) for r in rows}
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:7] == want[r.doc_id] and r.kept == (not r.base_failed) and r.quality_prob is None
    docs, labels, truth = corpus
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    held = [(got[i].kept, q) for i, q, _ in truth[300:]]
    assert sum(k == bool(q) for k, q in held) >= 0.97 * len(held)


def test_quality_rules_use_all_labelled_rows():
    """Fitted on as many labelled rows as the other operators."""
    import inspect

    for f in (quality_rules.train, quality_rules.quality_rules):
        assert inspect.signature(f).parameters["limit"].default == labelled.MAX_LABELLED == 4000


def test_fit_in_bounded_memory(monkeypatch):
    """Working arrays of a fit stay under the size of its features, and blocks change no weight."""
    rng = np.random.default_rng(5)
    size = rng.integers(0, 8000, 1000)
    at = np.concatenate([[0], np.cumsum(size)])
    rows = linear.Rows(at, rng.integers(0, 5000, at[-1]).astype(np.int32), rng.random(at[-1], np.float32))
    y = (rng.random(1000) < 0.5).astype(float)
    tracemalloc.start()
    w, _, b = linear.fit(rows, y, 5000, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * (rows.idx.nbytes + rows.val.nbytes)
    monkeypatch.setattr(linear, "BLOCK", 10_000)
    other = linear.fit(rows, y, 5000, rounds=2)
    assert np.allclose(w, other[0], atol=1e-6) and abs(b - other[2]) < 1e-6


def test_quality_sample_moves_as_texts(spark, corpus):
    before = len(common._TABLES)
    assert quality_rules.train(common.documents(corpus[0]), corpus[1]) is not None
    assert [spark.read.parquet(p).columns for p in common._TABLES[before:]] == [["doc_id", "y", "text"]]


def test_cotraining(corpus):
    docs, labels, truth = corpus
    got = {r.doc_id: r for r in cotraining.co_train(docs, labels).collect()}
    held = [(got[i].kept, q) for i, q, _ in truth[300:]]
    assert len(got) == 420 and sum(k == bool(q) for k, q in held) >= 0.95 * len(held)
    assert all(r.kept and r.quality_prob is None for r in cotraining.co_train(docs.limit(5), labels.limit(0)).collect())


def test_toxicity(corpus):
    docs, labels, truth = corpus
    chain = {"low_quality": "1 - quality", "toxic": "toxic"}
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels, chain).collect()}
    held = [(got[i].toxic, t) for i, _, t in truth[300:]]
    assert sum(k == bool(t) for k, t in held) >= 0.97 * len(held)
    left = toxicity.drop_toxic(docs, labels, chain)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, r in got.items() if r.kept}
    assert toxicity.toxicity(docs.limit(3), labels.limit(0), chain).where("kept").count() == 3


def test_chain_feeds_forward():
    """A second category that is the first one's opposite is learned from its probability."""
    r = np.random.default_rng(0)
    y = r.integers(0, 2, 300)
    words = [np.unique(np.concatenate([r.integers(10, 500, 20), [1] if t else [2]])) for t in y]
    rows = toxicity.Rows(np.concatenate([[0], np.cumsum([len(w) for w in words])]), np.concatenate(words), np.ones(sum(map(len, words))))
    chain = toxicity.train_chain(rows, np.arange(300), np.column_stack([y, 1 - y, y]))
    p = toxicity.chain_probabilities(chain, rows.idx, rows.at)
    assert ((p[:, 0] > 0.5) == y).all() and ((p[:, 1] > 0.5) != y).all() and len(chain[2][1]) == 2


def test_pii_base():
    r = random.Random(3)
    for _ in range(4000):
        t = "".join(r.choice("019@.+-( )a% ") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(t) == brute.personal(t), t


def test_pii_model(spark):
    w = pii.train(pii.generated())
    hit = total = wrong = 0
    for text, gold in pii.generated(99, 400):
        got = pii.all_spans(text, w, pii.base_spans(text))
        total += bool(gold)
        hit += bool(gold) and gold[0] in got
        wrong += not gold and bool(got)
    assert hit >= 0.97 * total and wrong <= 0.03 * (400 - total)
    rows = [(1, "mail a.b@c.example.com, +1 (017) 555-7713."), (2, None), (3, ""), (None, "10.0.0.1")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert (got[1].n_email, got[1].n_phone, got[1].spans) == (1, 1, "email:5:22,phone:24:41") and got[2].spans == "" and got[None].n_ip == 1
    masked = {r.doc_id: r.text for r in pii.mask_pii(docs).collect()}
    assert masked == {1: "mail [email], [phone].", 2: None, 3: "", None: "[ip]"}


def test_pii_lines_by_hand():
    """Lines that no template made."""
    w = pii.train(pii.generated())
    lines = [
        ("Call me on (212) 555-0187 after six.", "(212) 555-0187"), ("Office: 212-555-0187 ext 4", "212-555-0187"), ("Fax 212.555.0188, weekdays", "212.555.0188"), ("my cell is 1-800-555-0199!", "1-800-555-0199"), ("reach us: +44 (20) 7946 0958", "+44 (20) 7946 0958"),
        ("Write to john.smith at example dot com today", "john.smith at example dot com"), ("contact: anna [at] uni-mail [dot] org", "anna [at] uni-mail [dot] org"), ("bob(at)mail(dot)net or later", "bob(at)mail(dot)net"), ("kim @ example.org works", "kim @ example.org"),
        ("card 4111.1111.1111.1111 was charged", "4111.1111.1111.1111"), ("pay with 5500/0000/0000/0004 now", "5500/0000/0000/0004"), ("Visa 4111 1111 1111 1111.", "4111 1111 1111 1111"),
        *((x, "") for x in ("The meeting at noon. Bring lunch", "order 2021-03-15 shipped", "pages 100 200 300 400 500", "ISBN 978 3 16 148410 0", "version 1.22.333444", "zip 12345-6789 here", "scores: 12 15 18 21 24 27", "room 4021.5566", "look at table dot one", "in 1999/12/31 23 he left", "she works at google. Then left", "account 1234 5678 9012 3456 closed", "ratio 300.400.500.600", "serial 00412345678")),
    ]
    right = sum([text[a:b] for a, _, b in pii.all_spans(text, w, pii.base_spans(text))] == [x] * bool(x) for text, x in lines)
    assert right >= 0.9 * len(lines)


def test_pii_long_stretches():
    """A long run of numbers on one line is one stretch, so none of them is cut in two; nor is a long spelt address."""
    w = pii.train(pii.generated())
    text = "call " + " ".join(f"(555) 123-{4567 + i}" for i in range(60))
    assert pii.all_spans(text, w, pii.base_spans(text)) == [(5 + 15 * i, 3, 19 + 15 * i) for i in range(60)]
    text = "jane [at] " + " [dot] ".join(["x" * 60] * 9)
    (s,) = pii.stretches(text)
    assert (s.spans[0][0], s.spans[-1][1]) == (0, len(text))


def test_pii_spelt_marks():
    """An address is a candidate whatever else the text holds."""
    for own in ("jane at example.com", "jane@example .com", "jane (AT) example.com", "jane [at]example dot com"):
        for rest in ("", " and a dot b"):
            assert [own] == [own[s.spans[0][0] : s.spans[-1][1]] for s in pii.stretches(own + ";" + rest)]


def test_pii_dynamic_programme_is_best():
    """The chosen segmentation scores as high as any."""
    w = pii.train(pii.generated(5, 200), rounds=5)

    def best(s, at):
        if at == len(s.tokens):
            return 0.0
        return max(sum(w.get(f, 0.0) for f in x[3]) + best(s, x[1]) for x in s.segments if x[0] == at)

    for text, _ in pii.generated(6, 150):
        for s in pii.stretches(text):
            if len(s.tokens) > 12:
                continue
            taken = {(a, k, e) for a, k, e in s.best(w)}
            covered, score = set(), 0.0
            for i, e, k, f in s.segments:
                if k >= 0 and (s.spans[i][0], k, s.spans[e - 1][1]) in taken:
                    covered |= set(range(i, e))
                    score += sum(w.get(x, 0.0) for x in f)
            score += sum(sum(w.get(x, 0.0) for x in f) for i, _, k, f in s.segments if k < 0 and i not in covered)
            assert score == pytest.approx(best(s, 0))


def test_context_tree_by_hand():
    """The built tree against block probabilities: P(next | past) = P(past, next) / P(past)."""
    r = random.Random(2)
    text = bytes(r.choice(b"ab") for _ in range(60))

    def block(pairs):
        """log probability of (context, byte) pairs by direct recursion over contexts and bits."""

        def kt(bits):
            n, s = [0, 0], 0.0
            for b in bits:
                s += math.log((n[b] + 0.5) / (sum(n) + 1))
                n[b] += 1
            return s

        def weighted(rows, depth):
            own = kt([b for _, b in rows])
            if depth == lm_scoring.DEPTH:
                return own
            groups = {}
            for c, b in rows:
                groups.setdefault(c[lm_scoring.DEPTH - 1 - depth], []).append((c, b))
            deeper = sum(weighted(g, depth + 1) for g in groups.values())
            return math.log(0.5) + max(own, deeper) + math.log1p(math.exp(-abs(own - deeper)))

        total, nodes = 0.0, {}
        for c, byte in pairs:
            node = 1
            for k in range(7, -1, -1):
                bit = byte >> k & 1
                nodes.setdefault(node, []).append((c, bit))
                node = node * 2 + bit
        for rows in nodes.values():
            total += weighted(rows, 0)
        return total

    depth = lm_scoring.DEPTH
    pairs = [(text[i : i + depth], text[i + depth]) for i in range(len(text) - depth)]
    key = lambda c, b: int.from_bytes(c[::-1] + bytes([b]), "big")
    runs, n = np.unique([key(*x) for x in pairs], return_counts=True)
    strange = [key(b"ababa"[:depth], b) for b in range(256)]
    both = np.unique(np.concatenate([runs, strange]))
    times = np.zeros(len(both), np.int64)
    times[np.searchsorted(both, runs)] = n
    value = dict(zip(both.tolist(), lm_scoring.log10_of(both, times, lm_scoring.top_of(both, times, [x[3:] for x in lm_scoring.deep_nodes(both, times)])), strict=True))
    for run in runs.tolist():
        whole = run.to_bytes(depth + 1, "big")
        c, b = whole[:-1][::-1], whole[-1]
        assert value[run] * math.log(10) == pytest.approx(block([*pairs, (c, b)]) - block(pairs), abs=1e-9)
    assert sum(10 ** value[x] for x in strange) == pytest.approx(1)
    none = np.zeros(0, np.int64)
    top = lm_scoring.build_top(none, none, none, none, none, none.astype(float))
    assert lm_scoring.log10_of(np.array([5]), np.array([0]), top)[0] == pytest.approx(-8 * math.log10(2))


def test_whole_contexts_are_kept_together(monkeypatch):
    """Parts of sorted runs do not divide a three-byte context, and hold every row once."""
    monkeypatch.setattr(lm_scoring, "PART_ROWS", 10)
    key = np.sort(np.random.default_rng(3).integers(0, 40 << 8 * (lm_scoring.DEPTH - lm_scoring.TOP), 300))
    batches = [pa.RecordBatch.from_arrays([pa.array(x), pa.array(x)], names=["key", "n"]) for x in np.array_split(key, 50)]
    parts = [k for k, _ in lm_scoring._whole_contexts(batches)]
    kinds = [set((k >> 8 * (lm_scoring.DEPTH - lm_scoring.TOP)).tolist()) for k in parts]
    assert np.concatenate(parts).tolist() == key.tolist() and len(parts) > 5 and sum(map(len, kinds)) == len(set.union(*kinds))


def test_table_of_values():
    """What found a slot is found again with its value, and nothing else is."""
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(-(2**62), 2**62, 3000))
    rng.shuffle(keys)
    table = lm_scoring.Table(keys, np.arange(len(keys)) * 0.5, 12)
    value, hit = table(keys)
    assert (value[hit] == np.flatnonzero(hit) * 0.5).all() and hit.mean() > 0.8 and hit[:50].all()
    assert not table(np.append(keys + 1, -1))[1].any() and not lm_scoring.Table(keys[:0], keys[:0], 4)(keys)[1].any()


def test_decontamination(spark):
    r = random.Random(4)
    v = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    items = [(k, " ".join(r.choice(v) for _ in range(n))) for k, n in enumerate([6, 12, 20, 35, 50] * 3)] + [(77, None), (78, " ")]
    docs, want = [], set()
    for i in range(60):
        w = [r.choice(v) for _ in range(150)]
        if i % 2:
            k = r.randrange(15)
            x = items[k][1].split()
            for _ in range(r.randint(0, len(x) // 4)):
                p, how = r.randrange(len(x)), r.random()
                x[p : p + 1] = [] if how < 0.3 else [r.choice(v)] if how < 0.7 else [x[p], r.choice(v)]
            w[50:50] = x
        docs.append((i, ", ".join(w).title() if i % 3 else " ".join(w)))
    docs += [(100, None), (101, ""), (102, items[3][1])]
    for d, t in docs:
        own = (t or "").lower().replace(",", "").split()
        for k, x in items:
            x = (x or "").split()
            if x:
                row = [0] * (len(own) + 1)
                for i, a in enumerate(x):
                    new = [i + 1]
                    for j, b in enumerate(own):
                        new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (a != b)))
                    row = new
                if 5 * min(row) <= len(x):
                    want.add((d, k, min(row)))
    got = decontamination.contaminated(spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(x.doc_id, x.item_id, x.edits) for x in got.collect()}
    assert found <= want and len(found) >= 0.97 * len(want) and len(want) > 20
    assert decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontamination_of_long_items():
    """Items of 100 to 400 words with a fifth of them left out: every one is found, with the edits of the plain programme."""
    rng = np.random.default_rng(7)
    for n in (20, 100, 200, 400):
        for _ in range(8):
            item, text = (rng.integers(1, 1 << 63, k).astype(np.uint64) for k in (n, 300))
            text = np.insert(text, 150, np.delete(item, rng.choice(n, n // 5, replace=False)))
            row = [0] * (len(text) + 1)
            for i, a in enumerate(item.tolist()):
                new = [i + 1]
                for j, b in enumerate(text.tolist()):
                    new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (a != b)))
                row = new
            got = decontamination.matches(decontamination.build([0], [item], 80), text, np.array([0, len(text)]), 80)
            assert [x[:3] for x in got] == [(0, 0, min(row))]


@pytest.mark.parametrize("kind", ["insert", "delete", "change"])
def test_decontamination_at_the_limit(kind):
    """With exactly as many edits of a kind as are allowed, items of 10 to 200 words are found."""
    rng = np.random.default_rng(11)
    word = lambda k: rng.integers(1, 1 << 63, k).astype(np.uint64)
    for n in (10, 20, 50, 100, 200):
        found = 0
        for _ in range(20):
            item, k = word(n), n // 5
            at = rng.choice(n, k, replace=False)
            changed = np.delete(item, at) if kind == "delete" else np.insert(item, at, word(k)) if kind == "insert" else item.copy()
            if kind == "change":
                changed[at] = word(k)
            text = np.concatenate([word(80), changed, word(80)])
            found += bool(decontamination.matches(decontamination.build([0], [item], 80), text, np.array([0, len(text)]), 80))
        assert found >= 19


def test_decontamination_of_one_repeated_word():
    """Work and memory stay with the text's words, though each of its places goes with each of the item's."""
    import tracemalloc

    one = np.uint64(0x9E3779B97F4A7C15)
    text, other = np.full(60_000, one), np.arange(1, 30, dtype=np.uint64) * one
    index = decontamination.build([0, 1], [np.full(100, one), np.append(np.full(50, one), other)], 80)
    tracemalloc.start()
    got = decontamination.matches(index, np.concatenate([text, other]), np.array([0, len(text), len(text) + len(other)]), 80)
    assert got == [(0, 0, 0, 0)] and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_windows_in_parts(monkeypatch):
    """However few pairs are held at a time, the same windows come out."""
    rng = np.random.default_rng(2)
    text = rng.integers(1, 6, 600).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    index = decontamination.build([0, 1, 2], [text[50:90], text[300:312], text[400:480]], 80)
    before = np.array([0, 200, 200, 600])
    want = [g.tolist() for g in decontamination._windows(index, text, before, 80)]
    monkeypatch.setattr(decontamination, "PART_PAIRS", 50)
    got = [g.tolist() for g in decontamination._windows(index, text, before, 80)]
    assert sorted(want) == sorted(got) and {g[0][0] for g in want} == {0, 1, 2}


def test_embedding_keeps_few_edits_near():
    r = np.random.default_rng(1)
    far, close = [], []
    for seed in range(20):
        x = r.integers(0, 2**63, 40).astype(np.uint64)
        y = x.copy()
        y[13] = 5
        a, b, c = decontamination.walk([x, y, r.integers(0, 2**63, 40).astype(np.uint64)], seed, 80)
        close.append((a != b).mean())
        far.append((a != c).mean())
    assert np.mean(close) < 0.35 < 0.9 < np.mean(far)


def test_licenses(spark):
    import duckdb

    mit = licenses.TEXTS["MIT"]
    rows = [(1, "Copyright (c) 2020 A\n(C) B\n\n" + mit.upper().replace(",", " ,")), (2, mit + " more"), (3, None), (4, "x\nReleased under the MIT Licence!\ny\n  licensed under CC BY-NC 4.0\n"), (5, licenses.TEXTS["ISC"].replace("\n", "\r\n").replace('"', "“")), (6, "MIT License\n\nCopyright (c) 2021 X\n\n" + mit), (None, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, digest int")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert [got[i].license_id for i in (1, 2, 3, 4, 5, 6, None)] == ["MIT", None, None, None, "ISC", "MIT", None]
    assert got[4].statements == "CC-BY-NC-4.0,MIT"
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    sql = {r[0]: r[1:] for r in con.sql(licenses.scan_sql()).fetchall() if r[0]}
    assert sql == {i: tuple(r)[1:] for i, r in got.items() if i}
    plan = licenses.scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licenses_of_whole_texts(spark):
    """Documents that are licences have their ids, wrapped otherwise, in capitals, with a title or other copyright lines; changed ones have none."""
    import textwrap
    from pathlib import Path

    texts = {k: t for k, t in licenses.TEXTS.items()}
    for name in ("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0", "CC0-1.0"):
        if (path := Path("/usr/share/common-licenses", name)).exists():
            texts[{"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0"}.get(name, name)] = path.read_text(encoding="utf-8")
    rows, want = [], {}
    for k, t in texts.items():
        paragraphs = [" ".join(p.split()) for p in t.split("\n\n")]
        if len(t) < 3000:
            paragraphs = [p for p in paragraphs if not p.lower().startswith("copyright")]
        forms = [t, t.upper().replace("\n", "\r\n"), "\n\n".join(textwrap.fill(p, 50) for p in paragraphs), "Copyright 2019-2024 Some One\n" + t.replace('"', "“").replace("license", "licence")]
        for f in forms if len(t) < 3000 else [forms[0], forms[1], forms[3]]:
            want[len(rows)] = k
            rows.append((len(rows), f))
        want[len(rows)] = None
        rows.append((len(rows), t + "\nBut not on Sundays."))
    own = "You may keep one copy, (a) unread or\n(c) read aloud."
    want |= {900: "Own-1.0", 901: None}
    rows += [(900, own.upper()), (901, own.replace("one", "two"))]
    more = spark.createDataFrame([("Own-2.0", own), ("Own-1.0", own), ("Empty", ""), ("Null", None), (None, "x y")], "license_id string, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), more=more).collect()}
    assert {i: got[i] for i in want if got[i] != want[i]} == {}


def test_licence_lists_are_no_copyright_lines(spark):
    """A (c) that begins a line after a (b) belongs to a list, so that wrapping does not change the digest."""
    texts = ["(a) one\n(b) two\n(c) three four\nfive", "(a) one (b) two\n(c) three\nfour five", "(C) Some One\nfive", "five"]
    got = [r.canonical_sha256 for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0] == got[1] and got[2] == got[3] and got[0] != got[2]


def test_empty_tables(spark, corpus):
    docs, labels, _ = corpus
    none, few = docs.limit(0), labels.limit(0)
    assert quality_rules.quality_rules(none, few).count() == 0 and cotraining.co_train(none, labels).count() == 0
    assert toxicity.toxicity(none, labels, {"toxic": "toxic"}).count() == 0 and pii.find_pii(none).count() == 0
    assert licenses.scan_licenses(none).count() == 0
