"""chrF and chrF++ as additive counters and a closed formula.

Conventions: characters 1-6 without white space and words 1-2 with a mark at a word's end or start split off; orders that
either side lacks are left out of the averages; beta 2, no smoothing. Counters of a sentence sum to those of a corpus.

A batch is counted as a whole: each n-gram is an exact number, so that sorted arrays take the place of a table per row.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .batches import doubles, lists, longs, worked

CHAR_ORDERS, WORD_ORDERS, BETA = 6, 2, 2
ORDERS = CHAR_ORDERS + WORD_ORDERS
MARKS = set(string.punctuation)
#: Rows that are counted at a time, and characters unless one row has more.
PART_ROWS, PART_CHARS = 512, 200_000


def _words(t: str) -> list[str]:
    out = []
    for w in t.split():
        if len(w) > 1 and w[-1] in MARKS:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in MARKS:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All parts as one array, and where each ends."""
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.cumsum([len(p) for p in parts], dtype=np.int64)


def _numbers(sides: list[list[np.ndarray]]) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Each side's units as small numbers and their ends, and the bits of a number."""
    joined = [_joined(s) for s in sides]
    kinds, place = np.unique(np.concatenate([u for u, _ in joined]), return_inverse=True)
    cuts = np.cumsum([len(u) for u, _ in joined])[:-1]
    return [(p, ends) for p, (_, ends) in zip(np.split(place.astype(np.int64), cuts), joined, strict=True)], max(1, (len(kinds) - 1).bit_length())


def _grams(sides: list[np.ndarray], bits: int, n: int, room: int) -> list[np.ndarray]:
    """Each side's n-grams as exact numbers of at most `room` bits; two ranks of shorter ones where the letters have too many."""
    if n * bits <= room:
        return [sum(u[i : len(u) - n + 1 + i] << (n - 1 - i) * bits for i in range(n)) if len(u) >= n else u[:0] for u in sides]
    half = (n + 1) // 2
    shorter = _grams(sides, bits, half, room)
    kinds, place = np.unique(np.concatenate(shorter), return_inverse=True)
    size = max(1, (len(kinds) - 1).bit_length())
    ranks = np.split(place.astype(np.int64), np.cumsum([len(g) for g in shorter])[:-1])
    return [(r[: max(len(u) - n + 1, 0)] << size) | r[n - half :] if len(u) >= n else u[:0] for r, u in zip(ranks, sides, strict=True)]


def _counted(grams: np.ndarray, ends: np.ndarray, n: int, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, n-gram) of n-grams that lie within a row, in order, and how often each is there."""
    at = np.arange(len(grams))
    row = np.searchsorted(ends, at, side="right")
    key = np.sort(((row << room) | grams)[at + n <= ends[row]]) if len(grams) else grams
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(np.append(first, len(key)))


def _part(hypotheses: Sequence[Sequence[str]], reference: Sequence[str]) -> list[np.ndarray]:
    texts, rows = [*hypotheses, reference], len(reference)
    names: dict[str, int] = {}
    chars = _numbers([[np.frombuffer("".join(t.split()).encode("utf-32-le", "surrogatepass"), np.uint32) for t in side] for side in texts])
    words = _numbers([[np.array([names.setdefault(w, len(names)) for w in _words(t)], np.int64) for t in side] for side in texts])
    out = [np.zeros((rows, 3 * ORDERS), np.int64) for _ in hypotheses]
    room = 62 - max(1, rows.bit_length())
    for order in range(ORDERS):
        (sides, bits), n = (chars, order + 1) if order < CHAR_ORDERS else (words, order + 1 - CHAR_ORDERS)
        grams = _grams([u for u, _ in sides], bits, n, room)
        totals = [np.maximum(np.diff(ends, prepend=0) - n + 1, 0) for _, ends in sides]
        known, times = _counted(grams[-1], sides[-1][1], n, room)
        for own, g, (_, ends), total in zip(out, grams, sides, totals, strict=False):
            key, k = _counted(g, ends, n, room)
            at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
            both = np.where(known[at] == key, np.minimum(k, times[at]), 0) if len(known) else np.zeros(len(key))
            own[:, 3 * order], own[:, 3 * order + 1], own[:, 3 * order + 2] = total, totals[-1], np.bincount(key >> room, both, rows)
    return out


def batch_counters(hypotheses: Sequence[Sequence[str | None]], reference: Sequence[str | None]) -> list[np.ndarray]:
    """For each list of hypotheses, a row of 24 numbers per reference: hypothesis n-grams, reference n-grams and matches of each order."""
    sides = [[t or "" for t in side] for side in (*hypotheses, reference)]
    size, cuts = np.cumsum([sum(map(len, row)) for row in zip(*sides, strict=True)]), [0]
    while cuts[-1] < len(sides[-1]):
        begun = size[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(min(max(cuts[-1] + 1, int(np.searchsorted(size, begun + PART_CHARS, side="right"))), cuts[-1] + PART_ROWS, len(sides[-1])))
    parts = [_part([s[a:b] for s in sides[:-1]], sides[-1][a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [np.concatenate(p) for p in zip(*parts, strict=True)] if parts else [np.zeros((0, 3 * ORDERS), np.int64) for _ in hypotheses]


def counters(hypothesis: str | None, reference: str | None) -> list[int]:
    """The 24 numbers of one pair."""
    return batch_counters([[hypothesis]], [reference])[0][0].tolist()


@arrow_udf(T.ArrayType(T.LongType()))
def chrf_counters(hypothesis: pa.Array, reference: pa.Array) -> pa.Array:
    return worked(lambda h, r: batch_counters([h], r)[0], lists(longs), hypothesis, reference)


def summed(c: str = "chrf") -> Column:
    """Sum of counter arrays over a group, place by place."""
    return F.array(*[F.coalesce(F.sum(F.get(F.col(c), i)), F.lit(0)) for i in range(3 * ORDERS)])


def score(c: Column) -> Column:
    """chrF++ in percent of 24 counters."""
    orders = F.filter(F.transform(F.sequence(F.lit(0), F.lit(ORDERS - 1)), lambda i: F.struct(F.get(c, 3 * i).alias("h"), F.get(c, 3 * i + 1).alias("r"), F.get(c, 3 * i + 2).alias("m"))), lambda o: (o["h"] > 0) & (o["r"] > 0))
    mean = lambda side: F.try_divide(F.aggregate(orders, F.lit(0.0), lambda s, o: s + o["m"] / o[side]), F.size(orders))
    p, r = mean("h"), mean("r")
    return F.coalesce(F.try_divide((1 + BETA**2) * p * r, BETA**2 * p + r), F.lit(0.0)) * 100


def f_scores(c: np.ndarray) -> np.ndarray:
    """chrF++ in percent of rows of 24 counters."""
    h, r, m = (c[:, i::3].astype(float) for i in range(3))
    use = (h > 0) & (r > 0)
    n = np.maximum(use.sum(axis=1), 1)
    p, q = ((np.where(use, m / np.where(use, side, 1), 0.0)).sum(axis=1) / n for side in (h, r))
    return np.where(p + q > 0, (1 + BETA**2) * p * q / np.where(p + q > 0, BETA**2 * p + q, 1), 0.0) * 100


def f_score(c: list[int]) -> float:
    return float(f_scores(np.array([c]))[0])


def _sentence_scores(hypotheses: Sequence[Sequence[str | None]], reference: Sequence[str | None]) -> list[np.ndarray]:
    """chrF++ of each sentence; a blank hypothesis scores 0."""
    return [np.where([bool(h and h.strip()) for h in own], f_scores(c), 0.0) for own, c in zip(hypotheses, batch_counters(hypotheses, reference), strict=True)]


@arrow_udf(T.DoubleType())
def sentence_score(hypothesis: pa.Array, reference: pa.Array) -> pa.Array:
    return worked(lambda h, r: _sentence_scores([h], r)[0], doubles, hypothesis, reference)


@arrow_udf(T.DoubleType())
def score_change(before: pa.Array, after: pa.Array, reference: pa.Array) -> pa.Array:
    """What a change of the hypothesis adds to its sentence's chrF++; the reference is counted once."""

    def one(b: list, a: list, r: list) -> np.ndarray:
        old, new = _sentence_scores([b, a], r)
        return new - old

    return worked(one, doubles, before, after, reference)
