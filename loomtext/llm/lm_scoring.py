"""Language-model scoring by context-tree weighting over bytes, beside a smoothed word-unigram score.

Method. Bytes (ASCII lower-cased, then an end symbol 0xFF that UTF-8 never has) are coded as eight binary decisions.
Each decision has a node in every context of the zero to DEPTH bytes before it. A node's Krichevsky-Trofimov estimate is
weighted against those of its longer contexts by how well each coded the training bytes, which gives a mixture over all
depths. The tree is built from the training counts and frozen; a decision whose longer context was never met is coded by
the shorter ones. Scores are log10 probabilities; bits_per_byte is the code length.

The tree is never in one place. One pass counts the different runs of DEPTH + 1 bytes, a table that grows with the
corpus and is dealt out by the last three bytes of context. A task holds whole three-byte contexts (each has at most
256^(DEPTH - 2) runs), so it works out all their deeper nodes; what these give the shorter contexts is summed in the
cluster. Contexts of zero to two bytes, at most 65,793, are built on the driver and sent back, and a second pass over the
runs gives each its log probability. A text's score is the sum over its runs: values of frequent runs, up to a table of
fixed size, go to the tasks, all others meet the texts' runs in a join. Word counts for the unigram score go the same way.

Defined cases: null text is empty and scores its end alone. With no training documents every byte has 1/256 and every
count is 0. An empty table gives an empty one. Rows that repeat a document each get its scores. A null doc_id is in
training. A very long text is one step of work, in proportion to its length. Other columns are not read, whatever their
names. Of equally frequent runs any may be in the table that tasks get; scores do not depend on it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, mix, saved, steps, text_bytes, word_hashes, words

END_BYTE, DEPTH = 0xFF, 5
#: Depth of the contexts that are built on the driver.
TOP = 2
#: log2 of the slots for words and for runs whose values every task gets; the others are joined.
WORD_SLOTS, RUN_SLOTS = 20, 21
#: Rows that are worked on at a time.
PART_ROWS, PART_CONTEXTS = 200_000, 4096
#: The end of a document as a word.
END_WORD = np.uint64(0xE4D0F0E4D0F0E4D1)


def _tokens(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts with an end after each; where each text's begin (n + 1)."""
    data, at = text_bytes(batch.column(column))
    data = LOWER[data]
    starts, ends, before = words(data, at)
    n = batch.num_rows
    out = np.full(len(starts) + n, END_WORD, U64)
    out[np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(before))] = word_hashes(data, starts, ends)
    return out.view(np.int64), before + np.arange(n + 1)


def _grams(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte (and end) of all texts with the DEPTH bytes before it as one number; where each text's begin (n + 1).

    The byte before is the highest place, the byte itself the lowest, so that runs in order are in order of context.
    """
    data, at = text_bytes(batch.column(column))
    n, sizes = batch.num_rows, np.diff(at)
    padded = np.full(len(data) + (DEPTH + 1) * n, END_BYTE, np.uint8)
    padded[np.arange(len(data)) + np.repeat((DEPTH + 1) * np.arange(n) + DEPTH, sizes)] = LOWER[data]
    use = np.ones(len(padded), bool)
    use[((at[:-1] + (DEPTH + 1) * np.arange(n))[:, None] + np.arange(DEPTH)).ravel()] = False
    place = np.flatnonzero(use)
    out = padded[place].astype(np.int64)
    for k in range(1, DEPTH + 1):
        out |= padded[place - k].astype(np.int64) << 8 * (DEPTH + 1 - k)
    return out, at + np.arange(n + 1)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def _counted(make, limit: int = 2_000_000):
    """How often a task's held-out and other texts have each word or run, summed over as many rows as fit the limit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = ([], []), ([], []), 0

        def rows() -> Iterator[pa.RecordBatch]:
            for held in (0, 1):
                if keys[held]:
                    key, n = _summed(keys[held], counts[held])
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(np.full(len(key), bool(held)))], names=["key", "n", "held_out"])

        for batch in steps(batches):
            own, before = make(batch, 0)
            held_out = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(bool), np.diff(before))
            for held in (0, 1):
                key, n = np.unique(own[held_out == bool(held)], return_counts=True)
                if len(key):
                    keys[held].append(key)
                    counts[held].append(n)
                    size += len(key)
            if size > limit:
                for held in (0, 1):
                    if keys[held]:
                        key, n = _summed(keys[held], counts[held])
                        keys[held][:], counts[held][:] = [key], [n]
                size = sum(len(k[0]) for k in keys if k)
                if size > limit // 2:
                    yield from rows()
                    keys, counts, size = ([], []), ([], []), 0
        yield from rows()

    return run


def counted(df: DataFrame, make) -> DataFrame:
    """(key, n, train): how often all texts, and those in training, have each word or run."""
    rows = df.select("text", "held_out").mapInArrow(_counted(make), "key long, n long, held_out boolean")
    return saved(rows.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("held_out"), 0).otherwise(F.col("n"))).alias("train")))


_HALVES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(4096) + 0.5))])
_WHOLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 8192)))])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, for x of 100 and more."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability that Krichevsky-Trofimov gives to a zeros and b ones."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    half = lambda k: np.where(k < len(_HALVES), _HALVES[np.minimum(k, len(_HALVES) - 1)], _log_gamma(np.maximum(k, 100) + 0.5) - 0.5 * np.log(np.pi))
    whole = lambda k: np.where(k < len(_WHOLE), _WHOLE[np.minimum(k, len(_WHOLE) - 1)], _log_gamma(np.maximum(k, 100) + 1.0))
    return half(a) + half(b) - whole(a + b)


def _mixed(own: np.ndarray, weight: np.ndarray, deeper: np.ndarray) -> np.ndarray:
    """A context's chance of a one, of its own estimate and what longer contexts say; -1 where a decision was never met."""
    return np.where(own < 0, deeper, np.where(deeper < 0, own, weight * own + (1 - weight) * deeper))


def deep_nodes(key: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Of runs in order, all those of their three-byte contexts, with training counts: for each of the eight decisions

    its node and bit and the chance of a one by the contexts of three bytes and more (of each run), and the two-byte
    context, node and log probability of each three-byte context's node.
    """
    byte, depths = key & 0xFF, []
    for depth in range(DEPTH, TOP, -1):
        context = key >> 8 * (DEPTH + 1 - depth)
        number = np.cumsum(np.concatenate([[0], context[1:] != context[:-1]]))
        depths.append((number, np.argsort((number << 8) | byte, kind="stable")))
    for k in range(8):
        node, bit = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1
        p, total, at = np.full(len(key), -1.0), None, None
        for number, order in depths:
            code = ((number << 8) | node)[order]
            new = np.concatenate([[True], code[1:] != code[:-1]])
            first, group = np.flatnonzero(new), np.empty(len(key), np.int64)
            group[order] = np.cumsum(new) - 1
            ones, both = np.add.reduceat((n * bit)[order], first), np.add.reduceat(n[order], first)
            score, own = log_kt(both - ones, ones), np.where(both > 0, (ones + 0.5) / (both + 1), -1.0)
            if total is None:
                total, p = score, own[group]
            else:
                total = np.logaddexp(score, np.bincount(group[at], total, len(first))) - np.log(2)
                p = _mixed(own[group], np.exp(score - np.log(2) - total)[group], p)
            at = order[first]
        yield node, bit, p, key[at] >> 8 * (DEPTH + 1 - TOP), node[at], total


@dataclass
class Level:
    """Contexts of one depth: their ids in order, and for each of their 256 decisions the chance of a one and the weight.

    A chance of -1 marks a decision never met. The weight is the estimate's own share against the longer contexts.
    """

    ids: np.ndarray
    chance: np.ndarray
    weight: np.ndarray

    def rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.ids):
            return np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return at, self.ids[at] == ids


def _decisions(row: np.ndarray, byte: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of the 256 decisions of each of `size` contexts, from counts of (context's place, byte)."""
    heap = np.zeros((size, 512))
    np.add.at(heap, (row, 256 + byte), n)
    for j in range(255, 0, -1):
        heap[:, j] = heap[:, 2 * j] + heap[:, 2 * j + 1]
    zeros, ones = np.zeros((size, 256)), np.zeros((size, 256))
    zeros[:, 1:], ones[:, 1:] = heap[:, 2:512:2], heap[:, 3:512:2]
    return zeros, ones


def build_top(context: np.ndarray, byte: np.ndarray, n: np.ndarray, parent: np.ndarray, node: np.ndarray, total: np.ndarray) -> list[Level]:
    """The levels of zero to two bytes, from counts of (two-byte context, byte) and from what the longer contexts give."""
    levels: list[Level] = []
    for depth in range(TOP, -1, -1):
        key = context >> 8 * (TOP - depth)
        own, row = np.unique(key, return_inverse=True)
        order = np.argsort(row, kind="stable")
        row, col, times = row[order], byte[order], n[order]
        chance, weight, given = np.empty((len(own), 256)), np.empty((len(own), 256)), []
        for a in range(0, len(own), PART_CONTEXTS):
            b = min(a + PART_CONTEXTS, len(own))
            some = slice(*np.searchsorted(row, (a, b)))
            zeros, ones = _decisions(row[some] - a, col[some], times[some], b - a)
            longer, place = np.zeros((b - a, 256)), np.searchsorted(own, parent)
            use = (place >= a) & (place < b)
            np.add.at(longer, (place[use] - a, node[use]), total[use])
            score = log_kt(zeros, ones)
            mixed = np.logaddexp(score, longer) - np.log(2)
            weight[a:b] = np.exp(score - np.log(2) - mixed)
            chance[a:b] = np.where(zeros + ones > 0, (ones + 0.5) / (zeros + ones + 1), -1)
            i, j = np.nonzero(mixed)
            given.append((own[a:b][i] >> 8, j, mixed[i, j]))
        levels.append(Level(own, chance, weight))
        parent, node, total = (np.concatenate(c) for c in zip(*given, strict=True)) if given else (parent, node, total)
    return levels[::-1]


def log10_of(key: np.ndarray, n: np.ndarray, top: list[Level]) -> np.ndarray:
    """log10 probability of each run's last byte after the others; runs as in `deep_nodes`."""
    places = [level.rows(key >> 8 * (DEPTH + 1 - depth) if depth else np.zeros(len(key), np.int64)) for depth, level in enumerate(top)]
    out = np.zeros(len(key))
    for node, bit, p, *_ in deep_nodes(key, n):
        for level, (at, known) in zip(top[::-1], places[::-1], strict=True):
            if len(level.ids):
                p = _mixed(np.where(known, level.chance[at, node], -1), level.weight[at, node], p)
        p = np.where(p < 0, 0.5, p)
        out += np.log10(np.where(bit == 1, p, 1 - p))
    return out


def top_of(key: np.ndarray, n: np.ndarray, totals: Iterable[tuple[np.ndarray, ...]]) -> list[Level]:
    parent, node, total = (np.concatenate(c) for c in zip(*totals, strict=True))
    return build_top(key >> 8 * (DEPTH + 1 - TOP), key & 0xFF, n, parent, node, total)


def _whole_contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Key and training count of sorted rows, in parts of about PART_ROWS that do not divide a three-byte context."""
    held, size, limit = [], 0, PART_ROWS
    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)])
        size += batch.num_rows
        if size >= limit:
            key, n = (np.concatenate(c) for c in zip(*held, strict=True))
            context = key >> 8 * (DEPTH - TOP)
            cut = int(np.searchsorted(context, context[-1]))
            if cut:
                yield [key[:cut], n[:cut]]
            held, size = [[key[cut:], n[cut:]]], len(key) - cut
            limit = max(PART_ROWS, 2 * size)
    if size:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the three-byte contexts give each decision of the two-byte ones."""
    for key, n in _whole_contexts(batches):
        for _, _, _, parent, node, total in deep_nodes(key, n):
            code = (parent << 8) | node
            kinds, at = np.unique(code, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds >> 8), pa.array(kinds & 0xFF), pa.array(np.bincount(at, total))], names=["parent", "node", "total"])


def _values(top):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _whole_contexts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(log10_of(key, n, top.value))], names=["key", "value"])

    return run


def run_values(runs: DataFrame) -> DataFrame:
    """(key, value): the log10 probability of each run of (key, n, train)."""
    dealt = runs.select("key", "train").repartition(F.shiftright("key", 8 * (DEPTH - TOP))).sortWithinPartitions("key")
    pairs = runs.groupBy(F.shiftright("key", 8 * (DEPTH + 1 - TOP)).alias("parent"), F.col("key").bitwiseAND(255).alias("byte")).agg(F.sum("train").alias("n")).where("n > 0").toArrow()
    totals = dealt.mapInArrow(_totals, "parent long, node long, total double").groupBy("parent", "node").agg(F.sum("total").alias("total")).where("total <> 0").toArrow()
    top = build_top(*(pairs[c].to_numpy() for c in ("parent", "byte", "n")), *(totals[c].to_numpy() for c in ("parent", "node", "total")))
    return saved(dealt.mapInArrow(_values(runs.sparkSession.sparkContext.broadcast(top)), "key long, value double"))


class Table:
    """Values by key in a table of fixed size. Each key may be in one of two slots; earlier keys go first, and some find none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int) -> None:
        self.bits, self.keys, self.values = bits, np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        for turn in (0, 1):
            slot = self._slot(keys, turn)
            one, first = np.unique(slot, return_index=True)
            first = first[self.keys[one] == -1]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            left = self.keys[slot] != keys
            keys, values = keys[left], values[left]

    def _slot(self, keys: np.ndarray, turn: int) -> np.ndarray:
        return ((keys.view(U64) * U64((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)[turn])) >> U64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of keys, and which of them are there."""
        slot = self._slot(keys, 0)
        out, hit = self.values[slot], self.keys[slot] == keys
        miss = np.flatnonzero(~hit)
        slot = self._slot(keys[miss], 1)
        out[miss], hit[miss] = self.values[slot], self.keys[slot] == keys[miss]
        return out, hit & (keys != -1)


def _frequent(rows: DataFrame, n: str, value: str, bits: int) -> Table:
    """A table of the most frequent keys: down to the power of two at which they would no longer fit."""
    size, least = 0, 62
    for row in rows.where(F.col(n) > 0).groupBy(F.floor(F.log2(n)).cast("int").alias("p")).count().orderBy(F.desc("p")).collect():
        if size + row["count"] > (1 << bits) * 3 // 4:
            break
        size, least = size + row["count"], row["p"]
    got = rows.where(F.col(n) >= F.lit(1 << least)).select("key", F.col(n).alias("n"), F.col(value).cast("double").alias("value")).toArrow()
    order = np.lexsort((got["key"].to_numpy(), -got["n"].to_numpy()))
    return Table(got["key"].to_numpy()[order], got["value"].to_numpy()[order], bits)


def _scored(known, total: float):
    """Each document's sums over the words and runs of the tasks' tables."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed = lambda v, e: np.diff(np.concatenate([[0], np.cumsum(v)])[e])
        for batch in steps(batches):
            tokens, before = _tokens(batch, 2)
            c, hit = known.value[0](tokens)
            gain = np.where(hit, np.log10((c + 1) / total), 0.0)
            runs, at = _grams(batch, 2)
            value, there = known.value[1](runs)
            score = np.add.reduceat(np.where(there, value, 0.0), at[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(np.diff(before)), pa.array(summed(hit & (c > 0), before)), pa.array(np.add.reduceat(gain, before[:-1])), pa.array(score), pa.array(np.diff(at))], names=["doc_id", "print", "held_out", "n_tokens", "known", "gain", "own_score", "symbols"])

    return run


def _others(known):
    """Each document's words (kind 0) and runs (kind 1) that tasks don't know, with how often it has them; `one` marks a row per document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            docs, kinds, keys = [], [], []
            for kind, make in enumerate((_tokens, _grams)):
                own, before = make(batch, 2)
                open_ = np.flatnonzero(~known.value[kind](own)[1])
                docs.append(np.searchsorted(before, open_, side="right") - 1)
                kinds.append(np.full(len(open_), kind, np.int32))
                keys.append(own[open_])
            doc, kind, key = (np.concatenate(c) for c in (docs, kinds, keys))
            order = np.lexsort((key, kind, doc))
            doc, kind, key = doc[order], kind[order], key[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(doc)))
            doc = doc[at]
            one = np.ones(len(doc), np.int32)
            one[1:] = doc[1:] != doc[:-1]
            pick = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(kind[at]), pa.array(key[at]), pa.array(times), pa.array(one)], names=["doc_id", "print", "kind", "key", "times", "one"])

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % folds == held_fold, F.lit(False))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("text"), held_out.alias("held_out"))
    vocabulary = counted(own.where(~F.col("held_out")), _tokens)
    n, v = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total = float(n + v + 1)
    runs = counted(own, _grams)
    values = run_values(runs)
    # how often a run is met decides whether tasks get it, so the counts are those of all texts
    tables = (_frequent(vocabulary, "n", "n", WORD_SLOTS), _frequent(runs.join(values, "key"), "n", "value", RUN_SLOTS))
    known = spark.sparkContext.broadcast(tables)
    scored = own.mapInArrow(_scored(known, total), "doc_id long, print long, held_out boolean, n_tokens long, known long, gain double, own_score double, symbols long")
    others = own.mapInArrow(_others(known), "doc_id long, print long, kind int, key long, times long, one int")
    listed = vocabulary.select(F.lit(0).alias("kind"), "key", F.log10((F.col("n") + 1) / F.lit(total)).alias("value")).unionByName(values.select(F.lit(1).alias("kind"), "key", "value"))
    met = others.join(listed, ["kind", "key"], "left")
    gain, word = F.col("times") * F.coalesce("value", F.lit(-float(np.log10(total)))), F.col("kind") == 0
    # rows that repeat a document put in its words and runs as often, hence the division
    more = met.groupBy("doc_id", "print").agg(F.sum(F.when(word, gain).otherwise(0.0)).alias("more"), F.sum(F.when(word, 0.0).otherwise(gain)).alias("deep"), F.sum(F.when(word & F.col("value").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"), F.sum("one").alias("copies"))
    more = more.select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"), (F.col("more") / F.col("copies")).alias("more"), (F.col("deep") / F.col("copies")).alias("deep"), F.expr("more_known div copies").alias("more_known"))
    out = scored.join(more, F.expr("print = _print and doc_id <=> _id"), "left")
    out = out.withColumn("score", F.col("own_score") + F.coalesce("deep", F.lit(0.0))).withColumn("bits_per_byte", -F.col("score") * F.lit(float(np.log2(10))) / F.col("symbols"))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("gain") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score", "bits_per_byte")
