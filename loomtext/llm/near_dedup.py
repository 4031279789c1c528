"""Near-duplicate detection by HyperMinHash.

Method. A document's set holds the distinct runs of five (or as many as asked for) lower-cased words. One pass hashes each member to one of
160 buckets and keeps the smallest value of each bucket, compressed to a HyperMinHash register: the count of leading
zeros and ten mantissa bits. Bands of five registers are the LSH keys. Documents with one and the same set collapse
first, so groups of copies cost one row each. In each band bucket the smallest document is the centre, and every
member is compared with it: first by the registers' Jaccard estimate (corrected for chance collisions), then on the
full sets. Where a bucket still holds several components afterwards, its members are joined by their rarest runs, which
misses no link and makes no pairs within a component or in families of too much changed copies. So no link is lost to
the star shape, and no group is expanded into its pairs.

Defined cases: null or blank text has the empty set, is linked with nothing and is its own component. An empty table
gives an empty one. Rows that repeat a doc_id each get a row. A null doc_id has no component and is kept. Of equal texts
the smallest doc_id stands for all, so no tie depends on the order of rows. A very long text is hashed in one piece, in
memory that grows with its length. Rows in: any columns; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, documents, mix, near_ids, rolled, saved, steps, text_bytes, word_hashes, words
from .components import components

BUCKETS, ROWS, MANTISSA = 160, 5, 10
EMPTY = 0xFFFF
#: How far an estimate may lie from the truth before it is not trusted: over four standard deviations at 0.8.
MARGIN = 0.15
#: log2 of the slots of the table of run counts at most; less where there are fewer runs.
SLOT_BITS = 23
#: Chance that two full registers agree though their sets share nothing (HyperMinHash, section on collisions).
CHANCE = 0.1699 * 2.0**-MANTISSA


def shingle_sets(batch: pa.RecordBatch, column: str, size: int) -> list[np.ndarray]:
    """Each text's set of distinct word runs, as sorted 64-bit hashes."""
    data, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
    data = LOWER[data]
    starts, ends, before = words(data, at)
    hashes = word_hashes(data, starts, ends)
    runs = rolled(hashes, size)
    out = []
    for i in range(batch.num_rows):
        a, b = before[i], before[i + 1]
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(rolled(hashes[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def registers(members: np.ndarray) -> np.ndarray:
    """The compressed registers of one set."""
    least = np.full(BUCKETS, np.iinfo(np.uint64).max, U64)
    bucket = ((members >> U64(32)) * U64(BUCKETS) >> U64(32)).astype(np.int64)
    np.minimum.at(least, bucket, mix(members ^ U64(0xA0761D6478BD642F)))
    filled = np.zeros(BUCKETS, bool)
    filled[bucket] = True
    zeros = 63 - np.floor(np.log2(np.maximum(least.astype(np.float64), 1))).astype(np.int64)
    zeros = np.clip(zeros, 0, 62)
    rest = (least << (zeros + 1).astype(U64)) >> U64(64 - MANTISSA)
    return np.where(filled, (zeros << MANTISSA) | rest.astype(np.int64), EMPTY).astype(np.uint16)


def bands(signature: np.ndarray) -> list[int]:
    """A key for each band that has a full register."""
    rows = signature.reshape(-1, ROWS).astype(U64)
    key = np.arange(len(rows), dtype=U64) + U64(1)
    for j in range(ROWS):
        key = mix(key * U64(0x2545F4914F6CDD1D) ^ rows[:, j])
    return key[(rows != EMPTY).any(axis=1)].view(np.int64).tolist()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs of register rows, less the collisions to expect by chance."""
    used = (a != EMPTY) | (b != EMPTY)
    same = ((a == b) & used).sum(axis=1)
    n = np.maximum(used.sum(axis=1), 1)
    return np.maximum(0.0, same - CHANCE * n) / n


def _sketches(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = []
            for members in shingle_sets(batch, "text", size):
                if not len(members):
                    rows.append((0, 0, 0, [], b""))
                    continue
                sig = registers(members)
                with np.errstate(over="ignore"):
                    f1, f2 = int(members.sum().view(np.int64)), int(np.bitwise_xor.reduce(mix(members * U64(0x9E3779B97F4A7C15))).view(np.int64))
                rows.append((len(members), f1, f2, bands(sig), sig.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))], schema=schema)

    return run


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(estimate(a, b))], names=["a", "b", "est"])


def _exact(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[str | None, np.ndarray] = (None, np.zeros(0, U64))  # neighbouring rows often share their centre
        for batch in steps(batches, "text_a"):
            left = shingle_sets(batch, "text_a", size)
            inter, union = [], []
            for x, text in zip(left, batch.column(3).to_pylist(), strict=True):
                if text != kept[0]:
                    one = pa.RecordBatch.from_arrays([pa.array([text], pa.large_string())], names=["text"])
                    kept = (text, shingle_sets(one, "text", size)[0])
                common = len(np.intersect1d(x, kept[1], assume_unique=True))
                inter.append(common)
                union.append(len(x) + len(kept[1]) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(inter, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "inter", "uni"])

    return run


def _rarity(size: int, bits: int):
    """Counts, by hash slot, of the texts that hold a run; as many rows as there are slots at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int32)
        for batch in steps(batches):
            np.add.at(total, (np.concatenate(shingle_sets(batch, "text", size)) >> U64(64 - bits)).astype(np.int64), 1)
        for first in range(0, len(total), 1 << 20):
            full = first + np.flatnonzero(total[first : first + (1 << 20)])
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full].astype(np.int64))], names=["slot", "n"])

    return run


def _prefixes(size: int, percent: int, rare, bits: int):
    """Each text's rarest runs: as the smaller one of a pair (side 0), and as the larger (side 1) for each size class it may meet."""
    t = percent / 100
    classes = lambda n: np.floor(np.log(np.maximum(n, 1)) / np.log(1.06)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            out: list[tuple] = []
            for members, doc_id, comp in zip(shingle_sets(batch, "text", size), batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n = len(members)
                often = rare.value[(members >> U64(64 - bits)).astype(np.int64)]
                order = np.lexsort((members, often))
                longest = n - -(-n * percent // 100) + 1
                order = order[: min(n, longest + 1)]
                place = np.arange(1, len(order) + 1)
                shared = often[order] > 1
                run_of, place = members[order][shared].view(np.int64), place[shared]
                short = place <= n - int(2 * t / (1 + t) * n - 1e-9) + 1
                out.append((run_of[short], np.zeros(short.sum(), np.int32), np.full(short.sum(), classes(np.array(n))), np.full(short.sum(), doc_id), np.full(short.sum(), comp), np.full(short.sum(), n), place[short]))
                # a partner of m <= n runs that first meets this one at `place` needs (n + m) t / (1 + t) <= 1 + n - place
                most = np.minimum(n, (1 + n - place) * (1 + t) / t - n + 1e-6)
                lo, hi = classes(np.full(len(place), max(1.0, n * t - 1e-6))), classes(np.maximum(most, 1))
                times = np.where(most >= n * t - 1e-6, np.maximum(hi - lo + 1, 0), 0)
                which = np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum()) if len(place) else lo
                out.append((np.repeat(run_of, times), np.ones(times.sum(), np.int32), which, np.full(times.sum(), doc_id), np.full(times.sum(), comp), np.full(times.sum(), n), np.repeat(place, times)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["run", "side", "class", "id", "comp", "n", "place"])

    return run


def _linked_by_rare_runs(own: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of members in different components that can reach the threshold, by prefix and position filters.

    Ordered by rarity, two sets at the threshold share a run among the first of both, and early enough in each. In a
    family of copies that were each changed too much the first runs are each copy's own, so it makes no pairs: any
    order gives right results, rarity keeps them few. The counts, up to 255 of a slot, come from a table with four slots
    for each run up to 2^SLOT_BITS (8 MB to the tasks, 50 MB to the driver); with far more runs than slots rare and
    common ones are told apart less well, and the join meets more pairs, which the exact comparison then turns down.
    """
    texts = saved(near_ids(own, members.select("doc_id")).dropDuplicates(["doc_id"]).join(members.select("doc_id", "comp"), "doc_id"))
    bits = min(max((4 * members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).bit_length(), 12), SLOT_BITS)
    counted = texts.mapInArrow(_rarity(size, bits), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    got = counted.select("slot", F.least("n", F.lit(255)).cast("short").alias("n")).toArrow()
    table = np.zeros(1 << bits, np.uint8)
    table[got["slot"].to_numpy()] = got["n"].to_numpy()
    rare = own.sparkSession.sparkContext.broadcast(table)
    rows = saved(texts.mapInArrow(_prefixes(size, percent, rare, bits), "run long, side int, class long, id long, comp long, n long, place long"))
    x, y = rows.where("side = 1").alias("x"), rows.where("side = 0").alias("y")
    reach = f"{100 + percent} * (1 + least(x.n - x.place, y.n - y.place)) >= {percent} * (x.n + y.n)"
    pairs = x.join(y, F.expr(f"x.run = y.run and x.class = y.class and x.comp <> y.comp and (y.n < x.n or (y.n = x.n and y.id < x.id)) and 100 * y.n >= {percent} * x.n and {reach}"))
    return pairs.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest linked doc_id), kept (doc_id = component_id).

    Documents are linked where 100 * |intersection| >= percent * |union| of their sets of `size`-word runs.
    """
    own = documents(docs, id_col, text_col)
    sketched = saved(own.mapInArrow(_sketches(size), "doc_id long, n long, f1 long, f2 long, bands array<long>, sig binary"))
    full = sketched.where("n > 0 and doc_id is not null")
    # one row for each different set
    reps = saved(full.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("sig", "doc_id").alias("sig")))
    spread = reps.select("rep", "n", F.explode("bands").alias("band"))
    # (a table of its own: a join of plain rows can be split where one band holds very many, one on top of an aggregate can't)
    centres = saved(spread.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("c"), F.count("*").alias("k")).where("k > 1").select("band", F.col("c.rep").alias("c"), F.col("c.n").alias("nc")))
    links = saved(spread.join(centres, "band").where("rep <> c").select("band", "rep", "n", "c", "nc"))
    fits = F.expr(f"100 * least(n, nc) >= {percent} * greatest(n, nc)")

    def compared(pairs: DataFrame) -> DataFrame:
        """a, b, est, inter, uni of pairs (a, b); the counts only where the estimate comes near the threshold."""
        sig = reps.select("rep", "sig")
        both = pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
        guessed = saved(both.select("a", "b", "sig_a", "sig_b").mapInArrow(_estimates, "a long, b long, est double"))
        close = guessed.where(F.col("est") >= percent / 100 - MARGIN)
        ids = close.select(F.col("a").alias("doc_id")).union(close.select("b"))
        texts = saved(near_ids(own, ids).dropDuplicates(["doc_id"]))
        with_a = close.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        with_both = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        counts = with_both.select("a", "b", "text_a", "text_b").mapInArrow(_exact(size), "a long, b long, inter long, uni long")
        return saved(guessed.join(counts, ["a", "b"], "left"))

    linked = F.expr(f"inter is not null and 100 * inter >= {percent} * uni")

    def merged(found: DataFrame) -> DataFrame:
        return saved(components(found.where(linked)))

    def named(rows: DataFrame, comp: DataFrame, *names: str) -> DataFrame:
        for x in names:
            rows = rows.join(comp.select(F.col("id").alias(x), F.col("component").alias(f"comp_{x}")), x, "left").withColumn(f"comp_{x}", F.coalesce(f"comp_{x}", x))
        return rows

    # first each member's smallest centre, then the other centres of those that are still apart
    first = links.where(fits).groupBy(F.col("rep").alias("a")).agg(F.min("c").alias("b"))
    found = compared(first)
    comp = merged(found)
    others = named(links.where(fits).select(F.col("rep").alias("a"), F.col("c").alias("b")).distinct(), comp, "a", "b").where("comp_a <> comp_b").select("a", "b")
    others = saved(others.join(found.select("a", "b"), ["a", "b"], "left_anti"))
    if not others.isEmpty():
        found = saved(found.unionByName(compared(others)))
        comp = merged(found)
    # members of buckets that still hold several components: an exact join by rare runs finds what links them
    rows = named(links.select("band", "rep", "n", "c"), comp, "rep", "c")
    # (the centre itself has met all of them, so what counts are several components beside it)
    apart = saved(rows.groupBy("band").agg(F.min("comp_rep").alias("least"), F.max("comp_rep").alias("most")).where("least <> most").select("band"))
    members = saved(rows.join(apart, "band", "left_semi").select(F.col("rep").alias("doc_id"), F.col("comp_rep").alias("comp"), "n").distinct())
    if not members.isEmpty():
        across = saved(_linked_by_rare_runs(own, members, size, percent))
        if not across.isEmpty():
            found = found.unionByName(compared(across))
            comp = merged(found)
    classes = named(reps.select("rep", "f1", "f2", "n"), comp, "rep").select("f1", "f2", "n", F.col("comp_rep").alias("c"))
    out = sketched.select("doc_id", "n", "f1", "f2").join(classes, ["f1", "f2", "n"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("c"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_sql(table: str = "documents", size: int = 5, percent: int = 80) -> str:
    """The same rows in DuckDB's SQL, from all pairs that share a run: for small tables with an id in each row, and each id once."""
    return rf"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {table}),
sets AS (SELECT doc_id, CASE WHEN len(w) >= {size} THEN list_distinct(list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i : i + {size - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
runs AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM runs a JOIN runs b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS d, doc_id AS r FROM {table} UNION SELECT d, b FROM reach JOIN links ON r = a),
least AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON d = doc_id
"""
