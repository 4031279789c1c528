"""Operators whose contracts are exact, against plain versions, on odd input and on none."""

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomtext.llm import common, lm_scoring, near_dedup, packing, suffix_dedup
from loomtext.llm.components import components

from . import brute

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(brute.rows(), brute.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def plain():
    return [(r[0], r[1]) for r in brute.rows()]


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(500 + i, 501 + i) for i in range(30)] + [(7, 7)]
    root = {v: v for e in edges for v in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: c for v, c in root.items() if v in got} and set(root) - set(got) <= {v for v in root if all(a == b for a, b in edges if v in (a, b))}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(docs, plain):
    want = brute.near(plain)
    got = near_dedup.near_duplicates(docs, size=4).collect()
    assert len(got) == len(plain)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_families(spark):
    """Many copies with many changes: most pairs lie just under or over the threshold, and chains link some."""
    import random

    r = random.Random(5)
    v = [f"w{i}" for i in range(3000)]
    base = [r.choice(v) for _ in range(150)]
    rows = []
    for i in range(160):
        x = list(base)
        for _ in range(r.randint(0, 8)):
            x[r.randrange(len(x))] = r.choice(v)
        rows.append((i * 3 % 160, " ".join(x)))
    want = brute.near(rows)
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()}
    assert got == {d: c for d, (_, c) in want.items()}


def test_estimate_is_close():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.95):
        found = []
        for _ in range(40):
            both = rng.integers(0, 2**63, int(600 * share)).astype(np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, int(300 * (1 - share))).astype(np.uint64)])) for _ in range(2))
            found.append(near_dedup.estimate(near_dedup.registers(a)[None], near_dedup.registers(b)[None])[0] - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(found)) < 0.03 and np.std(found) < 0.06


def test_suffix_order():
    rng = np.random.default_rng(4)
    for _ in range(300):
        t = rng.integers(0, 3, rng.integers(0, 70))
        assert suffix_dedup.suffix_order(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


@pytest.mark.parametrize(("many", "rows"), [(4000, 64), (2, 1)])
def test_remove_repeats(docs, plain, many, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY_KINDS", many)
    monkeypatch.setattr(suffix_dedup, "HOT_SAMPLE", 1 if rows == 1 else 16)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", rows)
    want = brute.repeats(plain)
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == len(plain)
    assert [(r.doc_id, tuple(r)[1:]) for r in got if tuple(r)[1:] != want[r.doc_id]] == []


@pytest.mark.parametrize("many", [40, 150])
def test_common_line_between_other_lines(spark, many, monkeypatch):
    """A line that is common among texts has kinds in proportion to the table; what meets because of it must not grow faster."""
    monkeypatch.setattr(suffix_dedup, "MANY_KINDS", many)
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefgh ") for _ in range(130))
    own = ["".join(rng.choice("ijklmnop ") for _ in range(90)) for _ in range(300)]
    rows = [(i, f"{own[i]}\n{line}\n{own[-i]}" if i % 3 else f"{own[i]} {line[:100]}{own[i % 60]}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).persist()
    before = len(common._TABLES)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == brute.repeats(rows)
    made = [spark.read.parquet(p) for p in common._TABLES[before:]]
    size = sum(t.select(F.sum(F.octet_length("part"))).first()[0] or 0 for t in made if "part" in t.columns)
    assert size <= 2 * sum(len(t) for _, t in rows)
    assert sum(t.count() for t in made) <= 60 * len(rows)


def test_filter_answers_alike(spark):
    ids = spark.range(-50, 3000, 7)
    table = common.bloom(ids)
    strange = spark.range(100000).select((F.xxhash64("id")).alias("id"))
    for rows in (ids, strange):
        got = rows.select("id", *common.spots("id", table)).toArrow().combine_chunks().to_batches()[0]
        assert (suffix_dedup._maybe_in(table, got.column(0).to_numpy()) == common.in_bloom(table, got)).all()


def test_long_text_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 1000)
    rows = [(1, "".join(map(str, range(1500)))), (2, "x" + "".join(map(str, range(1500)))[700:4000]), (3, None)]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.repeats(rows)


def test_packing(docs, plain):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = packing.pack(docs.repartition(40), TOKENIZER, capacity=64).collect()  # three rounds of merges
    want = []
    for d, t in plain:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(d, k, a, len(ids[a : a + 64]), zlib.crc32(struct.pack(f"<{len(ids[a : a + 64])}I", *ids[a : a + 64]))) for k, a in enumerate(range(0, len(ids), 64))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(bins) <= 1.02 * total / 64 + 1


def test_encoder_equals_tokenizer():
    own = packing.Encoder(TOKENIZER)
    for t in ("don't... İ. A.B <|endoftext|> x<|endoftext|>. é. É, ß; 12.5 \x1c a\x1cb", "", "ª. µ, ...!? 日本。 I'll 's.'s ,", "é. ñ,", "a b　c."):
        ids = own.tokenizer.encode(t, add_special_tokens=False).ids
        assert own(t) == struct.pack(f"<{len(ids)}I", *ids), t


def test_best_fit():
    bins, place, held = packing.best_fit(np.array([5, 7, 3, 2, 10, 1]), 10)
    assert sorted(held) == [8, 10, 10] or sorted(held) == [9, 9, 10]
    assert all(0 <= p < 10 for p in place) and sum(held) == 28 and len(set(bins.tolist())) == 3


@pytest.mark.parametrize("slots", [20, 5])
def test_lm_base(docs, plain, slots, monkeypatch):
    monkeypatch.setattr(lm_scoring, "WORD_SLOTS", slots)
    # the counts of a table include its repeated row
    want = {}
    tokens = brute.unigram(plain)
    for d, t in plain:
        want[d] = tokens[d]
    got = lm_scoring.lm_scores(docs).collect()
    assert len(got) == len(plain)
    for r in got:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_lm_joined_runs(docs, monkeypatch):
    """Runs beyond those that every task gets meet their values in a join: scores are as with all of them there."""
    want = {(r.doc_id, r.score, r.bits_per_byte) for r in lm_scoring.lm_scores(docs).collect()}
    want = {d: (s, b) for d, s, b in want}
    monkeypatch.setattr(lm_scoring, "RUN_SLOTS", 6)
    for r in lm_scoring.lm_scores(docs).collect():
        assert (r.score, r.bits_per_byte) == pytest.approx(want[r.doc_id], rel=1e-6)


def test_empty_tables(spark):
    none = spark.createDataFrame([], brute.SCHEMA)
    assert near_dedup.near_duplicates(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert packing.pack(none, TOKENIZER).count() == 0
    assert lm_scoring.lm_scores(none).count() == 0


def test_null_ids(spark):
    rows = spark.createDataFrame([(None, "a b c d e " * 30), (1, "a b c d e " * 30), (None, None)], "doc_id long, text string")
    near = near_dedup.near_duplicates(rows).where(F.col("doc_id").isNull()).collect()
    assert len(near) == 2 and all(r.kept and r.component_id is None for r in near)
    cut = suffix_dedup.remove_repeats(rows).where(F.col("doc_id").isNull()).collect()
    assert [r.n_removed for r in cut] == [0, 0]
    assert packing.pack(rows, TOKENIZER).count() == 3 and lm_scoring.lm_scores(rows).count() == 3
