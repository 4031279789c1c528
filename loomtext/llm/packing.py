"""Best-fit packing of token sequences by hierarchical residual packing.

Method. Each task tokenizes its documents and packs their pieces by best-fit decreasing. Bins that are nearly full are
final. The underfull ones become items, as large as what they hold, and meet those of other tasks in a tree of
repeated best-fit rounds until one task has seen all of them. A round's tasks each get a bounded number of bins; where
more are left than one task may hold, the rounds end once they no longer lower the count.

Defined cases: null text is empty and has the end id alone. Only documents longer than a sequence are cut, however long
they are. A null doc_id stays null. Repeated rows are packed once each. An empty table gives an empty one. Pieces of equal
length are interchangeable: which bin each lands in depends on the order of rows, lengths and counts do not. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, saved, steps

#: Pieces or bins that one task packs at a time.
TASK_ITEMS = 500_000
#: Entries of a worker's table of encoded words; it is emptied when full.
CACHE_WORDS = 400_000
FAN_IN = 8
#: Marks that may follow a word; no token spans a Latin letter or digit and one of them.
TAIL = ".,;:!?"


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of whole texts as little-endian bytes, equal to the tokenizer's own, with a table of words seen before.

    White space always separates tokens and is dropped, so a text's ids are those of its blank-separated parts in turn.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters, self.seen = self.tokenizer.model, _byte_letters(), {"": b""}

    def _whole(self, part: str) -> bytes:
        ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        core = part.rstrip(TAIL)
        if core and len(core) < len(part) and core[-1] < "Ā" and core[-1].isalnum():
            tail = part[len(core) :]
            for x in (core, tail):
                if x not in self.seen:
                    self.seen[x] = self._part(x)
            return self.seen[core] + self.seen[tail]
        if core == part and part.isalpha() and max(part) < "Ā" and len(part) < 200:
            found = self.model.tokenize("".join(map(self.letters.__getitem__, part.lower().encode())))
            return struct.pack(f"<{len(found)}I", *(t.id for t in found))
        return self._whole(part)

    def __call__(self, text: str) -> bytes:
        if len(self.seen) > CACHE_WORDS:
            self.seen = {"": b""}
        parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        seen = self.seen
        try:
            return b"".join([seen[p] for p in parts])
        except KeyError:
            for p in parts:
                if p not in seen:
                    seen[p] = self._part(p)
            return b"".join([seen[p] for p in parts])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: each item's bin and place there, and what each bin holds."""
    bin_of, offset, held = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has room for r
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            b, r = len(held), capacity
            held.append(0)
        bin_of[i], offset[i] = b, held[b]
        held[b] += s
        if r > s:
            room[r - s].append(b)
            mask |= 1 << (r - s)
    return bin_of, offset, held


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, held long"


def _leaves(path: str, end_id: int, capacity: int, with_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "place", "held", *["ids"] * with_ids]

    def pack(rows: list[tuple], first: int) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        bins, place, held = best_fit(np.array(cols[3], np.int64), capacity)
        fill = np.array(held, np.int64)[bins]
        arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5]), pa.array(bins + first), pa.array(place), pa.array(fill)]
        if with_ids:
            arrays.append(pa.array([np.frombuffer(x, np.uint32).astype(np.int32) for x in cols[5]], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), struct.pack("<I", end_id)
        task, packed, rows, width = TaskContext.get(), 0, [], 4 * capacity
        for batch in steps(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), width)):
                    own = ids[at : at + width]
                    rows.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own), own if with_ids else None))
            if len(rows) >= (TASK_ITEMS if not with_ids else 20_000):
                yield pack(rows, (task.partitionId() << 36) + packed)
                packed, rows = packed + len(rows), []
        if rows:
            yield pack(rows, (task.partitionId() << 36) + packed)

    return run


def _merge(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("held", "descending"), ("bin", "ascending")])
        sizes, ids = table["held"].to_numpy(), table["bin"].to_numpy()
        bins, place, held = best_fit(sizes, capacity)
        heads = np.zeros(len(held), np.int64)
        heads[bins[place == 0]] = ids[place == 0]
        return pa.table({"bin": ids, "into": heads[bins], "shift": place, "held": np.array(held, np.int64)[bins], "team": table["team"]})

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, nearly_full: float = 0.995) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for)."""
    schema = _PIECES + ", ids array<int>" * with_ids
    pieces = saved(documents(docs, id_col, text_col).mapInArrow(_leaves(tokenizer, end_id, capacity, with_ids), schema))
    least = int(nearly_full * capacity)
    open_bins = saved(pieces.where((F.col("place") == 0) & (F.col("held") < least)).select("bin", "held", F.shiftright("bin", 36).alias("team")))
    moves, turn = None, 0
    teams, left = (open_bins.agg(F.max("team"), F.count("*")).first())
    teams = (teams or 0) + 1
    while left > 1:
        fewest = -(-left // TASK_ITEMS)
        groups = max(-(-teams // FAN_IN), fewest)
        # a group of the next round takes FAN_IN neighbours of this one, or an even share where a task's bound asks for more
        # (another share each time, so that other bins meet)
        turn += 1
        own = F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(groups)) if groups > -(-teams // FAN_IN) else F.floor(F.col("team") / FAN_IN)
        done = saved(open_bins.withColumn("team", own.cast("long")).groupBy("team").applyInArrow(_merge(capacity), "bin long, into long, shift long, held long, team long"))
        step = done.where("bin <> into").select("bin", "into", "shift")
        if moves is None:
            moves = step
        else:
            later = step.select(F.col("bin").alias("into"), F.col("into").alias("then"), F.col("shift").alias("more"))
            moves = moves.join(later, "into", "left").select("bin", F.coalesce("then", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")).unionByName(step)
        moves = saved(moves)
        open_bins = saved(done.where((F.col("bin") == F.col("into")) & (F.col("held") < least)).select("bin", "held", "team"))
        teams, before, left = groups, left, open_bins.count()
        if groups == 1 or (groups == fewest and left > 0.99 * before):
            break
    if moves is None:
        moves = open_bins.select("bin", F.col("bin").alias("into"), F.lit(0).cast("long").alias("shift"))
    out = pieces.join(moves, "bin", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"), *["ids"] * with_ids)
