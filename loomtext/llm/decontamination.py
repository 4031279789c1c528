"""Benchmark decontamination: CGK embedding of word windows, bit-sampling LSH, and exact edit verification.

Method. Texts and items are sequences of words (runs of letters and digits, ASCII case folded). A document is
contaminated by an item if some stretch of it lies within an edit distance (in words) of a fifth of the item's length.
The CGK random walk writes a sequence as a longer one: at each step the current word is put out, and a random bit that
depends on step and word says whether to move on. Few edits between two sequences then mean few differing places. Keys
sampled at random places of the walk are looked up in the index of items. What collides is verified by an exact dynamic
programme over the stretch, and after it every other stretch that could be nearer, so that no match hangs on a key.

Windows have the items' sizes and begin wherever they could match: a stretch within k edits of an item of n words shares
with it a run of floor(n / (k + 1)) words that no edit touches (rounded to the whole run lengths below), and of the
item's n - r + 1 runs of r words all but k * r. Windows with fewer in the right place are not within reach; all others
are embedded.

The index holds the benchmark in blocks of a million words, each broadcast on its own: documents are read once per block,
so a benchmark of b million words takes b passes (known benchmarks together have some tens).

Defined cases: null or blank text matches nothing, items without words match nothing; an empty table on either side gives
none. Repeated documents each get rows, repeated items are items of their own. Null ids stay null. Of several stretches
with as few edits the first is given. Work on a very long text, or one of one repeated word, grows with its words times
those of the items that it shares runs with, memory with its words. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, bases, documents, mix, rolled, steps, text_bytes, word_hashes, words
from .toxicity import OTHER

#: Words of all items in one block of the index (some 100 MB with its keys).
BLOCK_WORDS = 1_000_000
#: Pairs of a run's places in texts and items that are held at a time.
PART_PAIRS = 1_000_000
#: Walks, keys sampled from each, and places in a key.
WALKS, KEYS, PLACES = 6, 10, 2
#: Bits of the table that tells whether a run of words is in some item.
FILTER_BITS = 22


def _words(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    data, at = text_bytes(batch.column(column))
    data = LOWER[data]
    starts, ends, before = words(data, at, OTHER)
    return word_hashes(data, starts, ends), before


def allowed(n: int, percent: int = 80) -> int:
    """Edits allowed for an item of n words."""
    return n * (100 - percent) // 100


def walk(sequences: list[np.ndarray], seed: int, length: int) -> np.ndarray:
    """The CGK embeddings of sequences, each padded with 0 to `length` places."""
    width = max(map(len, sequences)) + 1
    table = np.zeros((len(sequences), width), U64)
    for i, s in enumerate(sequences):
        table[i, : len(s)] = s
    rows, at, out = np.arange(len(sequences)), np.zeros(len(sequences), np.int64), np.empty((len(sequences), length), U64)
    for j in range(length):
        now = table[rows, at]
        out[:, j] = now
        bit = (mix(now ^ U64((seed * 1_000_003 + j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> U64(63)).astype(np.int64)
        at = np.minimum(at + bit, width - 1)
    return out


def sampled_keys(sequences: list[np.ndarray], n: int) -> np.ndarray:
    """For each sequence, WALKS * KEYS keys; places are drawn from the part of the walk that an item of n words fills."""
    length, out = 2 * n + 2, []
    for w in range(WALKS):
        path = walk(sequences, w, length)
        draw = np.random.default_rng([w, n])
        for k in range(KEYS):
            places = draw.choice(min(length, max(PLACES, 2 * n)), size=min(PLACES, length), replace=False)
            key = np.full(len(sequences), w * KEYS + k + 1, U64)
            for p in sorted(places.tolist()):
                key = mix(key * U64(0x2545F4914F6CDD1D) ^ path[:, p])
            out.append(key)
    return np.column_stack(out)


def least_edits(item: np.ndarray, texts: list[np.ndarray], most: int) -> np.ndarray:
    """Least word edit distance of the item to any stretch of each text; most + 1 where it is more than that."""
    width, out = max(map(len, texts)), np.full(len(texts), most + 1)
    table = np.zeros((len(texts), width), U64)  # a padding word is as dear as leaving the item's word out
    for i, text in enumerate(texts):
        table[i, : len(text)] = text
    left, steps_ = np.arange(len(texts)), np.arange(width + 1)
    row = np.zeros((len(texts), width + 1), np.int64)
    for i, word in enumerate(item):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, :-1] + (table != word), row[:, 1:] + 1, out=new[:, 1:])
        row = np.minimum.accumulate(new - steps_, axis=1) + steps_
        if i % 8 == 7:
            near = row.min(axis=1) <= most
            if not near.all():
                left, row, table = left[near], row[near], table[near]
                if not len(left):
                    return out
    out[left] = np.minimum(row.min(axis=1), most + 1)
    return out


@dataclass
class Index:
    """A block of the benchmark: its items' words, the runs they hold, and their sampled keys."""

    ids: list
    items: list[np.ndarray]
    #: run length -> (sorted run hashes, item numbers, places in the item)
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    filters: dict[int, np.ndarray]
    keys: list[np.ndarray]


def _run_length(n: int, percent: int) -> int:
    k = allowed(n, percent)
    sure = -(-(n - k) // (k + 1))
    return max(r for r in (1, 2, 3, 4, 6, 8) if r <= max(sure, 1))


def build(ids: list, items: list[np.ndarray], percent: int) -> Index:
    by_length: dict[int, list[tuple]] = {}
    for i, item in enumerate(items):
        r = _run_length(len(item), percent)
        runs = rolled(item, r)
        by_length.setdefault(r, []).append((runs, np.full(len(runs), i), np.arange(len(runs))))
    runs, filters = {}, {}
    for r, parts in by_length.items():
        h, i, p = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        runs[r] = (h[order], i[order], p[order])
        filters[r] = np.zeros(1 << FILTER_BITS, bool)
        filters[r][(h >> U64(64 - FILTER_BITS)).astype(np.int64)] = True
    return Index(ids, items, runs, filters, [sampled_keys([x], len(x))[0] for x in items])


def _pairs(code: np.ndarray, occurrences: np.ndarray, first: np.ndarray, at: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """item << 40 | first word of the starts that (item << 40 | place) entries and their occurrences `at[first:]` give, and how often."""
    kinds, times = [], []
    whole = np.concatenate([[0], np.cumsum(occurrences)])
    for low in range(0, int(whole[-1]), PART_PAIRS):
        pair = np.arange(low, min(low + PART_PAIRS, int(whole[-1])))
        entry = np.searchsorted(whole, pair, side="right") - 1
        word = at[first[entry] + pair - whole[entry]]
        begin = before[np.searchsorted(before, word, side="right") - 1]
        one, n = np.unique((code[entry] >> 40 << 40) | np.maximum(word - (code[entry] & (1 << 40) - 1), begin), return_counts=True)
        kinds.append(one)
        times.append(n)
        if sum(map(len, kinds)) > 4 * PART_PAIRS:
            kinds, times = ([x] for x in _added(kinds, times))
    return _added(kinds, times)


def _added(kinds: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    kind, place = np.unique(np.concatenate(kinds), return_inverse=True)
    return kind, np.bincount(place, np.concatenate(times)).astype(np.int64)


def _windows(index: Index, hashes: np.ndarray, before: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """(item, text, first word, least edits) of the windows to embed, by item: those that share as many runs with the item as any in reach.

    Pairs of a run's places in the texts and in the items are taken PART_PAIRS at a time and summed, so that what is held
    grows with the texts' words, however often a run recurs.
    """
    for r, (known, item, place) in index.runs.items():
        own = rolled(hashes, r)
        at = np.flatnonzero(index.filters[r][(own >> U64(64 - FILTER_BITS)).astype(np.int64)])
        at = at[at + r <= before[np.searchsorted(before, at, side="right")]]
        at = at[np.argsort(own[at], kind="stable")]
        first = np.searchsorted(own[at], known)
        occurrences = np.searchsorted(own[at], known, side="right") - first
        hit = np.flatnonzero(occurrences)
        hit = hit[np.argsort(item[hit], kind="stable")]
        # whole items, as many as have about PART_PAIRS pairs
        edges = np.flatnonzero(np.diff(item[hit], prepend=-1))
        cut = [0]
        whole = np.concatenate([[0], np.cumsum(occurrences[hit])])
        for e in [*edges.tolist(), len(hit)]:
            if whole[e] - whole[cut[-1]] >= PART_PAIRS:
                cut.append(e)
        for low, high in zip(cut, [*cut[1:], len(hit)], strict=True):
            if low == high:
                continue
            some = hit[low:high]
            code, times = _pairs((item[some] << 40) | place[some], occurrences[some], first[some], at, before)
            which, start = code >> 40, code & (1 << 40) - 1
            size = np.array([len(index.items[i]) for i in which[np.flatnonzero(np.diff(which, prepend=-1))]])[np.cumsum(np.diff(which, prepend=-1) != 0) - 1]
            reach, text = size * (100 - percent) // 100, np.searchsorted(before, start, side="right") - 1
            # starts on one line, a pair's further from the next pair's than any reach
            pair = np.cumsum(np.concatenate([[0], (which[1:] != which[:-1]) | (text[1:] != text[:-1])]))
            line = pair * (int(before[-1]) + int(reach.max()) + 1) + start
            total = np.concatenate([[0], np.cumsum(times)])
            shared = total[np.searchsorted(line, line + reach, side="right")] - total[:-1]
            # an edit touches as many runs as a run has words; those left begin within as many words as edits are allowed
            least = np.maximum(0, -((shared - (size - r + 1)) // r))
            rows = np.column_stack([which, text, start, least])[least <= reach]
            yield from np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1) if len(rows) else []


def _shared_keys(index: Index, i: int, hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Whether the windows have a key of item i; equal windows are embedded once."""
    up, down = bases(len(hashes) + 1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(hashes * up[:-1])])
    content = mix((total[stops] - total[starts]) * down[starts] ^ mix((stops - starts).astype(U64)))
    _, one, back = np.unique(content, return_index=True, return_inverse=True)
    hits = [np.zeros(0, bool)]
    for part in np.array_split(one, -(-len(one) * (2 * len(index.items[i]) + 2) // 1_000_000)):
        keys = sampled_keys([hashes[a:b] for a, b in zip(starts[part].tolist(), stops[part].tolist(), strict=True)], len(index.items[i]))
        hits.append((keys == index.keys[i]).any(axis=1))
    return np.concatenate(hits)[back]


def matches(index: Index, hashes: np.ndarray, before: np.ndarray, percent: int) -> list[tuple[int, int, int, int]]:
    """(text, item, edits, first word of the searched stretch): each item's best verified stretch in each text.

    Starts of a text that lie within the edits allowed are verified in one stretch. What shares a key comes first; then
    every other stretch that could hold fewer edits than found so far, so that a missed key loses nothing.
    """
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for group in _windows(index, hashes, before, percent):
        i = int(group[0, 0])
        item, n, k = index.items[i], len(index.items[i]), allowed(len(index.items[i]), percent)
        stops = np.minimum(group[:, 2] + n, before[group[:, 1] + 1])
        hit = _shared_keys(index, i, hashes, group[:, 2], stops)
        new = np.flatnonzero(np.concatenate([[True], (group[1:, 1] != group[:-1, 1]) | (group[1:, 2] > group[:-1, 2] + k)]))
        text, last = group[new, 1], group[np.append(new[1:], len(group)) - 1, 2]
        low, high = np.maximum(group[new, 2] - 2 * k, before[text]), np.minimum(last + n + 2 * k, before[text + 1])
        least, keyed = np.minimum.reduceat(group[:, 3], new), np.logical_or.reduceat(hit, new)
        for turn in (True, False):
            reach = np.array([best.get((t, i), (k + 1, 0))[0] for t in text.tolist()])
            open_ = np.flatnonzero((keyed == turn) & (least < reach))
            open_ = open_[np.argsort((high - low)[open_], kind="stable")]
            while len(open_):
                # as many stretches as fill a table of about 200,000 words, or one that is longer
                fits = np.arange(1, len(open_) + 1) * (high - low)[open_] <= 200_000
                part, open_ = np.split(open_, [max(1, int(fits.sum()))])
                found = least_edits(item, [hashes[a:b] for a, b in zip(low[part].tolist(), high[part].tolist(), strict=True)], k)
                for t, a, edits in zip(text[part].tolist(), low[part].tolist(), found.tolist(), strict=True):
                    if edits <= k and (edits, a) < best.get((t, i), (k + 1, 0)):
                        best[t, i] = (edits, a)
    return [(t, i, e, a - int(before[t])) for (t, i), (e, a) in sorted(best.items())]


def _scan(index, percent: int):
    names = ["doc_id", "item_id", "edits", "item_words", "near_word"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            ids, block = batch.column(0).to_pylist(), index.value
            rows = [(ids[t], block.ids[i], e, len(block.items[i]), a) for t, i, e, a in matches(block, *_words(batch, 1), percent)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names=names)

    return run


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """The items' ids and words, in blocks of about BLOCK_WORDS words; one block is on the driver at a time."""
    ids, items, size = [], [], 0
    for row in benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        one, _ = _words(pa.RecordBatch.from_arrays([pa.array([row.t], pa.string())], names=["text"]), 0)
        if len(one):
            ids.append(row.i)
            items.append(one)
            size += len(one)
        if size >= BLOCK_WORDS:
            yield ids, items
            ids, items, size = [], [], 0
    if items:
        yield ids, items


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", percent: int = 80) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, edits, item_words, near_word (where to look)."""
    own, spark = documents(docs, id_col, text_col), docs.sparkSession
    schema, out = "doc_id long, item_id long, edits long, item_words long, near_word long", None
    for ids, items in blocks(benchmark, item_col, item_text):
        index = spark.sparkContext.broadcast(build(ids, items, percent))
        found = own.mapInArrow(_scan(index, percent), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)
