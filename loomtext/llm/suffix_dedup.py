"""Removal of repeated byte passages, by difference-cover suffix sorting of what a lossless collapse leaves.

Method. A byte goes if a string of 100 bytes over it also starts earlier (smaller doc_id, or same document and earlier
start). Sorting every suffix of a corpus in the cluster would move each of its bytes as a record of some 20 bytes in each
sort of each recursion; so equal strings are collapsed first, without loss:

1. Each 100-byte string picks the least hashed 24-byte run within it, its anchor. Neighbouring strings mostly share one,
   so a text is cut into stretches of strings with the same anchor. Equal strings have equal anchors.
2. Stretches meet by anchor. Where the whole stretch is equal, the first one speaks for all and the others go. Anchors
   with one kind of stretch are settled by that.
3. Anchors with several kinds of stretch (the edges of passages) send the bytes of each kind, once. A task lines up
   those of its anchors and sorts their suffixes by the difference-cover algorithm: sort sampled triples, recurse on
   their names, merge the other suffixes, then compare adjacent prefixes over 100 bytes.

The stretches of an anchor with very many kinds are cut further, into pieces of at most FINE strings by how far these lie
before the anchor; a piece's key is a digest of the bytes that all strings so placed share. Pieces meet like stretches do,
only by digests at first: keys with one kind are settled, those with several go on as in 3. A key that still has very many
is cut into single strings, which meet by digest too, so no step sends each string's bytes. Anchors that hold very many
stretches, and all pieces, are met by content, so that none fills a task. Whole stretches are matched by two hashes of 64
bits, pieces by two digests of 64 bits, what is sorted by its bytes. Difference-cover sorting itself is done within tasks,
each for the anchors dealt to it.

Defined cases: null text is empty; texts under 100 bytes stay as they are. An empty table gives an empty one. Rows that
share a doc_id are one document: none is earlier than the other, and equal starts in them are one. A null doc_id has no
place in the order: its text stays whole and removes nothing. A very long text is cut into steps of bounded size. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, STEP_BYTES, U64, bases, bloom, documents, in_bloom, mix, near_ids, saved, spots, steps, text_bytes

SPAN, GRAM = 100, 24
#: One document in so many is looked at for anchors that hold very many stretches, and how many they must hold there:
#: this number and this share of all. They are dealt out in smaller parts, which changes no result.
HOT_SAMPLE, HOT_ROWS, HOT_SHARE = 16, 64, 1e-5
#: Kinds of stretch above which an anchor is cut further, strings of a piece then, and bytes that one sort takes in.
MANY_KINDS, FINE, SORT_BYTES = 4000, 8, 800_000
BYTE_HASH = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each string of all texts: its start and its anchor's; and the hash of each run of bytes."""
    n = len(data)
    sizes = np.diff(at)
    long = np.flatnonzero(sizes >= SPAN)
    if not len(long):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    # (arrays of the texts' length are dropped or written over as soon as they can be: a worker holds few of them at once)
    h, width = BYTE_HASH[data], 1
    made = {}
    while width * 2 <= GRAM:
        more = h[: len(h) - width] * U64(pow(BASE, width, 1 << 64))
        more += h[width:]
        h, width = more, width * 2
        if GRAM & width:
            made[width] = h
    rest = GRAM - width
    while rest:
        part = 1 << (rest.bit_length() - 1)
        size = n - width - part + 1
        more = h[:size] * U64(pow(BASE, part, 1 << 64))
        more += (made[part] if part > 1 else BYTE_HASH[data])[width : width + size]
        h, width = more, width + part
        rest -= part
    del made, more
    h = mix(h)
    least = h & U64(0xFFFFFFFF00000000)
    least |= U64(0xFFFFFFFF) - np.arange(len(h), dtype=U64)
    window = SPAN - GRAM + 1
    width = 1
    while width * 2 <= window:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[: n - SPAN + 1], least[window - width : window - width + n - SPAN + 1])
    inside = np.zeros(n + 1, np.int8)
    np.add.at(inside, at[long], 1)
    np.add.at(inside, at[long + 1] - SPAN + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside, dtype=np.int8)[: n - SPAN + 1])
    least = least[starts]
    least &= U64(0xFFFFFFFF)
    return starts, np.subtract(U64(0xFFFFFFFF), least, out=least).view(np.int64), h


def stretches(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all texts: text number, first and last start of the strings with one anchor, anchor hash, content hash."""
    n = len(data)
    starts, anchor, h = anchors(data, at)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64))
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    edge = np.flatnonzero(new)
    first, last, anchor, h = starts[edge], starts[np.append(edge[1:], len(starts)) - 1], anchor[edge], h[anchor[edge]]
    del starts, new
    up, down = bases(n + 1)
    total = np.zeros(n + 1, U64)
    total[1:] = BYTE_HASH[data]
    total[1:] *= up[:n]
    np.cumsum(total, out=total)
    content = (total[last + SPAN] - total[first]) * down[first]
    content = mix(content ^ mix((anchor - first).astype(U64) << U64(32) | (last - first).astype(U64)))
    return np.searchsorted(at, first, side="right") - 1, first, last, h, content


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of intervals of each document, as few intervals."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    edges = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1])
    number = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, len(doc))))
    room = int(end.max()) + 1
    reach = np.maximum.accumulate(end + number * room) - number * room
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], reach[np.append(at[1:], len(doc)) - 1]


_STRETCH = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("wide", pa.int32()), ("part", pa.int64())])


def _cut(hot=None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _firsts(batches):
            anchor, content = (batch.column(i).to_numpy() for i in range(2))
            part = np.where(_among(hot.value, anchor), content | 1, 0) if hot else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], schema=_STRETCH)

    return run


def _among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), max(len(known) - 1, 0))
    return known[at] == values if len(known) else np.zeros(len(values), bool)


def _firsts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches that come first in their batch; those that don't are settled: wide -1, content the end of what goes."""
    for batch in steps(batches):
        batch = batch.filter(pa.array(np.array(batch.column(0).is_valid())))
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        data, at = text_bytes(batch.column(1))
        for a in range(0, max(len(data), 1), STEP_BYTES) if batch.num_rows == 1 else (0,):
            own = data[a : a + STEP_BYTES + SPAN - 1] if batch.num_rows == 1 else data
            text, first, last, anchor, content = stretches(own, at if batch.num_rows > 1 else np.array([0, len(own)]))
            doc, start = ids[text], first - (at[text] if batch.num_rows > 1 else 0) + a
            yield _own_firsts(anchor, content, doc, start, last - first)


def _own_firsts(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray, start: np.ndarray, wide: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((start, doc, content, anchor))
    doc, start, wide, anchor, content = doc[order], start[order], wide[order], anchor[order], content[order]
    new = np.ones(len(doc), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
    gone = (doc != doc[head]) | (start != start[head])
    gone_doc, gone_start, gone_end = _spans(doc[gone], start[gone], (start + wide + SPAN)[gone])
    columns = (np.append(anchor[new].view(np.int64), mix(gone_doc.astype(U64) ^ mix(gone_start.astype(U64))).view(np.int64)), np.append(content[new].view(np.int64), gone_end), np.append(doc[new], gone_doc), np.append(start[new], gone_start), np.append(wide[new], np.full(len(gone_doc), -1)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_STRETCH.names[:5])


def _settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, content, doc_id and start, in one pass with one row kept: what goes, and what is open.

    Of an anchor that is dealt out in parts (part is not 0) every first stretch is open, as the other parts are not seen here.
    """
    carry: list[np.ndarray] | None = None
    told = False  # the kept row was given out as open
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        ready = cols[4] < 0
        out = [(np.zeros(int(ready.sum()), np.int64), cols[2][ready], cols[3][ready], cols[1][ready], np.zeros(int(ready.sum()), bool))]
        rows = [c[~ready] for c in cols]
        if len(rows[0]):
            if carry is not None:
                rows = [np.append(k, c) for k, c in zip(carry, rows, strict=True)]
            anchor, content, doc, start, wide, part = rows
            new_anchor, new = np.ones(len(doc), bool), np.ones(len(doc), bool)
            new_anchor[1:] = anchor[1:] != anchor[:-1]
            new[1:] = new_anchor[1:] | (content[1:] != content[:-1])
            heads = np.flatnonzero(new)
            head = heads[np.cumsum(new) - 1]
            gone = (doc != doc[head]) | (start != start[head])
            out.append((np.zeros(int(gone.sum()), np.int64), doc[gone], start[gone], (start + wide + SPAN)[gone], np.zeros(int(gone.sum()), bool)))
            group = np.cumsum(new_anchor) - 1
            kinds = np.bincount(group[heads])
            is_open = (kinds[group[heads]] > 1) | (part[heads] != 0)
            if carry is not None and told:
                is_open[0] = False
            at = heads[is_open]
            out.append((anchor[at], doc[at], start[at], (start + wide + SPAN)[at], np.ones(len(at), bool)))
            told = bool(kinds[-1] > 1 or part[-1] != 0 or (told and carry is not None and group[-1] == 0))
            carry = [c[heads[-1:]] for c in rows]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["anchor", "doc_id", "start", "stop", "open"])


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of small non-negative numbers (below 2^21, as is the length), by difference cover modulo 3."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.concatenate([text.astype(np.int64) + 1, np.zeros(3, np.int64)])
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a closing one-sample where n mod 3 is 1
    sample = np.concatenate([ones, twos])
    key = (t[sample] << 42) | (t[sample + 1] << 21) | t[sample + 2]
    order = np.argsort(key)
    fresh = np.ones(len(order), bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    name = np.empty(len(order), np.int64)
    name[order] = np.cumsum(fresh)
    if not fresh.all():
        order = suffix_order(name)
        name[order] = np.arange(1, len(order) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = name
    zeros = np.arange(0, n, 3)
    zero_key = (t[zeros] << 22) | rank[zeros + 1]
    own = np.argsort(zero_key, kind="stable")
    zeros, zero_key = zeros[own], zero_key[own]
    in_order = sample[order]
    in_order = in_order[in_order < n]
    is_one = in_order % 3 == 1
    one, two = in_order[is_one], in_order[~is_one]
    below = np.searchsorted((t[one] << 22) | rank[one + 1], zero_key)
    wide = lambda i: (t[i] << 43) | (t[i + 1] << 22) | rank[i + 2]
    below = below + np.searchsorted(wide(two), wide(zeros))
    out = np.empty(n, np.int64)
    place = np.arange(len(zeros)) + below
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place] = zeros
    out[~taken] = in_order
    return out


def repeated(parts: list[bytes], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of each 100-byte string of the parts that also starts earlier in one of them."""
    sizes = np.array([len(p) for p in parts], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    raw = np.frombuffer(b"\0".join(parts) + b"\0" * 8, np.uint8)
    text = raw[: at[-1]].astype(np.int64) + len(parts)
    text[at[1:] - 1] = np.arange(len(parts))  # each part ends in a mark of its own
    order = suffix_order(text)
    part = np.searchsorted(at, order, side="right") - 1
    fits = order + SPAN < at[part + 1]
    order, part = order[fits], part[fits]
    eight = np.lib.stride_tricks.sliding_window_view(raw, 8)
    same = np.ones(max(len(order) - 1, 0), bool)
    for step in (*range(0, SPAN - 8, 8), SPAN - 8):
        left = np.flatnonzero(same)
        same[left] = (eight[order[left] + step] == eight[order[left + 1] + step]).all(axis=1)
    run = np.concatenate([[0], np.cumsum(~same)])[: len(order)]
    d, s = doc[part], start[part] + order - at[part]
    by = np.lexsort((s, d, run))
    run, d, s = run[by], d[by], s[by]
    head = np.ones(len(run), bool)
    head[1:] = run[1:] != run[:-1]
    first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(run) else np.zeros(0, np.int64)
    later = (d != d[first]) | (s != s[first])
    return d[later], s[later]


def _quote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of open stretches, and whether their anchor has very many kinds."""
    for batch in steps(batches):
        keys, ids, starts, parts, many = [], [], [], [], []
        for doc, text, opened in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            for x in opened:
                keys.append(x["anchor"])
                ids.append(doc)
                starts.append(x["start"])
                parts.append(text[x["start"] : x["stop"]])
                many.append(x["many"])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(parts, pa.binary()), pa.array(many, pa.bool_())], names=["key", "doc_id", "start", "part", "many"])


_PARTS = "key long, doc_id long, start long, part binary"
_CUTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def _digest(own: bytes, salt: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(own, digest_size=8, salt=salt).digest(), "little", signed=True)


def _pieces(width: int):
    """Parts cut into pieces of at most `width` strings, with a digest of what all strings in a piece's place share as key.

    A string's place is how far it lies before its anchor, by `width`: equal strings have equal places, and so equal keys.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "part"):
            data, at = text_bytes(batch.column(3))
            starts, anchor, _ = anchors(data, at)
            place = (anchor - starts) // width
            new = np.ones(len(starts), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
            edge = np.flatnonzero(new)
            first, end = starts[edge], starts[np.append(edge[1:], len(starts)) - 1] + SPAN if len(edge) else edge
            anchor, place = anchor[edge], place[edge]
            shared, until = anchor - place * width, anchor - np.minimum((place + 1) * width - 1, SPAN - GRAM) + SPAN
            raw = data.tobytes()
            key = [_digest(raw[a:b], b"key") for a, b in zip(shared.tolist(), until.tolist(), strict=True)]
            part = [raw[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)]
            row = np.searchsorted(at, first, side="right") - 1
            doc, start = (batch.column(i).to_numpy(zero_copy_only=False)[row] for i in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc), pa.array(start + first - at[row]), pa.array(part, pa.binary())], names=["key", "doc_id", "start", "part"])

    return run


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces as stretches with digests for their bytes, all of them dealt out by content; see `_firsts`."""
    for batch in batches:
        key, doc, start = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        parts = batch.column(3).to_pylist()
        content = np.array([_digest(p, b"content") for p in parts], np.int64)
        out = _own_firsts(key, content, doc, start, np.array([len(p) - SPAN for p in parts], np.int64))
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(out.column(1).to_numpy() | 1)], schema=_STRETCH)


def _sort(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, taken in whole keys and about SORT_BYTES at a time: what goes."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        d, s = repeated([r[3] for r in rows], np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in _spans(d, s, s + SPAN)], schema=_CUTS)

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if held and row[0] != held[-1][0] and size >= SORT_BYTES:
                yield flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3]) + 1
    if held:
        yield flush(held)


def _result(spans: bool, held=None):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not spans:
                batch = batch.filter(pa.array(~in_bloom(held.value, batch)))
            rows = []
            cuts = batch.column(2).to_pylist() if spans else [None] * batch.num_rows
            for doc, text, cut in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), cuts, strict=True):
                text = text or b""
                digest, removed, found, at = hashlib.sha256(), 0, 0, 0
                if cut:
                    pairs = np.array([(min(c["start"], len(text)), min(c["stop"], len(text))) for c in cut], np.int64)
                    _, starts, stops = _spans(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
                    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
                        digest.update(text[at:a])
                        removed, found, at = removed + b - a, found + (b > a), b
                digest.update(text[at:])
                rows.append((doc, len(text), removed, found, digest.hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=names)

    return run


def _hot_anchors(own: DataFrame) -> np.ndarray:
    """Anchors that hold very many stretches, in order; found on a part of the documents, at most 1 / HOT_SHARE of them."""
    some = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SAMPLE)) == 0).mapInArrow(_cut(), _CUT_ROWS).where("wide >= 0")
    times = saved(some.groupBy("anchor").count().where(F.col("count") >= HOT_ROWS // 4))
    whole = times.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    got = times.where(F.col("count") >= max(HOT_ROWS, whole * HOT_SHARE)).select("anchor").toArrow()
    return np.sort(got["anchor"].to_numpy())


_CUT_ROWS = "anchor long, content long, doc_id long, start long, wide int, part long"


def _met(cut: DataFrame) -> DataFrame:
    """Stretches that have met: what goes (not open), and the first ones of several kinds (open)."""
    dealt = cut.repartition("anchor", "part").sortWithinPartitions("anchor", "content", "doc_id", "start")
    return saved(dealt.mapInArrow(_settle, "anchor long, doc_id long, start long, stop long, open boolean"))


_PRIMES = [U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _maybe_in(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """What `in_bloom` answers, where the ids are made in the task: the hashes are those of Spark's xxhash64(id, k)."""
    p1, p2, p3, p4, p5 = _PRIMES
    turn = lambda x, n: (x << U64(n)) | (x >> U64(64 - n))

    def done(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> U64(33))) * p2
        x = (x ^ (x >> U64(29))) * p3
        return x ^ (x >> U64(32))

    hit = np.ones(len(ids), bool)
    with np.errstate(over="ignore"):
        own = (p5 + U64(42 + 8)) ^ (turn(ids.astype(U64) * p2, 31) * p1)
        own = done(turn(own, 27) * p1 + p4)
        for k in range(3):
            spot = done(turn((own + p5 + U64(4)) ^ (U64(k) * p1), 23) * p2 + p3) & U64(64 * len(table) - 1)
            hit &= (table[spot >> U64(6)] >> (spot & U64(63)).astype(np.int64) & 1).astype(bool)
    return hit


def _cut_further(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of parts whose keys have very many kinds: (doc_id, start, stop) of what goes, and smaller parts that are to be sorted."""
    met = _met(parts.mapInArrow(lambda batches: _digests(_pieces(FINE)(batches)), _CUT_ROWS))
    kinds = saved(met.where("open").groupBy("anchor").count().where("count > 1"))
    out = met.where("not open").select("doc_id", "start", "stop")
    tables = parts.sparkSession.sparkContext.broadcast([bloom(kinds.where(F.col("count") > n).select("anchor")) for n in (0, MANY_KINDS)])

    # (a stranger that a filter lets through is met or sorted as well, to no effect: all pieces of its key go the same way;
    # each stage has one mapInArrow, as each more would keep a further worker for every core)
    def chosen(batches: Iterable[pa.RecordBatch], most: bool) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(FINE)(batches):
            key = batch.column(0).to_numpy()
            yield batch.filter(pa.array(_maybe_in(tables.value[0], key) & (_maybe_in(tables.value[1], key) == most)))

    if not kinds.where(F.col("count") > MANY_KINDS).isEmpty():
        strings = _met(parts.mapInArrow(lambda batches: _digests(_pieces(1)(chosen(batches, True))), _CUT_ROWS))
        out = out.unionByName(strings.where("not open").select("doc_id", "start", "stop"))
    return out, parts.mapInArrow(lambda batches: chosen(batches, False), _PARTS)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, stop): byte ranges to remove; they may overlap."""
    own = documents(docs, id_col, text_col)
    hot = own.sparkSession.sparkContext.broadcast(_hot_anchors(own))
    met = _met(own.mapInArrow(_cut(hot), _CUT_ROWS))
    left = met.where("open").select("anchor", "doc_id", "start", "stop")
    # (a table of its own, so that its join can be split where one anchor holds very many)
    many = saved(left.groupBy("anchor").count().where(F.col("count") > MANY_KINDS).select("anchor", F.lit(True).alias("many")))
    by_doc = left.join(many, "anchor", "left").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "stop", F.coalesce("many", F.lit(False)).alias("many"))).alias("opened"))
    texts = near_ids(own, left.select("doc_id")).dropDuplicates(["doc_id"])
    parts = texts.join(by_doc, "doc_id").select("doc_id", "text", "opened").mapInArrow(_quote, _PARTS + ", many boolean")
    out = met.where("not open").select("doc_id", "start", "stop")
    if not many.isEmpty():
        parts = saved(parts)
        gone, smaller = _cut_further(parts.where("many").drop("many"))
        out, parts = out.unionByName(gone), parts.where("not many").drop("many").unionByName(smaller)
    sorted_parts = parts.select("key", "doc_id", "start", "part").repartition("key").sortWithinPartitions("key", "part", "doc_id", "start")
    return saved(out.unionByName(sorted_parts.mapInArrow(_sort, "doc_id long, start long, stop long")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the bytes that stay."""
    own = documents(docs, id_col, text_col)
    spans = repeated_spans(own)
    table = bloom(spans.select("doc_id"))
    held = own.sparkSession.sparkContext.broadcast(table)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    whole = own.select("*", *spots("doc_id", table)).mapInArrow(_result(False, held), schema)
    cuts = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))

    def hit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bloom(held.value, batch))).select(["doc_id", "text"])

    touched = own.select("*", *spots("doc_id", table)).mapInArrow(hit, own.schema).join(cuts, "doc_id", "left")
    return whole.unionByName(touched.select("doc_id", "text", "cuts").mapInArrow(_result(True), schema))


def repeats_sql(table: str = "documents") -> str:
    """The same rows in DuckDB's SQL, from every 100-byte string of the table: for small tables with each id once."""
    return f"""
WITH own AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM {table}),
strings AS (SELECT doc_id, s, md5(t[s + 1 : s + 100]) AS h FROM (SELECT doc_id, t, unnest(range(octet_length(t) - 99)) AS s FROM own)),
firsts AS (SELECT h, min((doc_id, s)) AS f FROM strings GROUP BY h HAVING count(*) > 1),
gone AS (SELECT doc_id, s, s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 AS apart FROM strings JOIN firsts USING (h) WHERE (doc_id, s) <> f),
numbered AS (SELECT doc_id, s, count(*) FILTER (apart) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM gone),
spans AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS z FROM numbered GROUP BY doc_id, k),
pieces AS (SELECT doc_id, hex(t[coalesce(lag(z) OVER w, 0) + 1 : a]) AS piece, a, z, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) = 1 AS final, hex(t[z + 1 :]) AS tail FROM spans JOIN own USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
kept AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(piece, '' ORDER BY a) || max(tail) FILTER (final) AS x FROM pieces GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(unhex(x), t)) AS kept_sha256 FROM own LEFT JOIN kept USING (doc_id)
"""
