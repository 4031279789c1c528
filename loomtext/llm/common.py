"""Shared pieces of the training-data operators: Arrow text access, vectorised word hashing, tables in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes that separate words: blank and TAB to CR.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 2_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that operators work on, whatever else the table holds or calls its columns."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where none is set (tests), one under /tmp/checkpoints until the end.

    Without one a cluster's executors would each write to their own disk, so that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(f"/tmp/checkpoints/{uuid.uuid4().hex}")
        atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
    return f"file://{_OWN_DIR[0]}"


#: Tables made by `saved` and not yet cleared.
_TABLES: list[str] = []


def saved(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/loomtext-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes the tables made by `saved` so far. Only what was written out may be used afterwards, as results read them."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _TABLES:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _clear_at_exit() -> None:
    """Clears at the program's end if the session is still there; else the tables are left for the cluster to remove."""
    with contextlib.suppress(Exception):
        if _TABLES and (spark := SparkSession.getActiveSession()) is not None:
            clear(spark)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and where each begins and ends (n + 1 offsets). Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, at - at[0]


def steps(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text, so that working arrays stay bounded."""
    for batch in batches:
        _, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([np.ones(1, U64), np.full(max(n, 4096), 0x9E3779B97F4A7C15 | 1, U64)]))
    return _POWERS[:n]


BASE = 0xD1342543DE82EF95
_UP = _DOWN = np.ones(1, U64)


def bases(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    global _UP, _DOWN
    if len(_UP) < n:
        one = np.ones(1, U64)
        _UP = np.cumprod(np.concatenate([one, np.full(n, BASE, U64)]))
        _DOWN = np.cumprod(np.concatenate([one, np.full(n, pow(BASE, -1, 1 << 64), U64)]))
    return _UP[:n], _DOWN[:n]


def words(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of all texts begin and end, and how many words stand before each text (n + 1 counts)."""
    solid = np.zeros(len(data) + 1, dtype=bool)
    np.logical_not(space[data], out=solid[:-1])
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edge = at[(at > 0) & (at < len(data))]
    begins[edge] = solid[edge]
    ends = np.zeros_like(solid)
    ends[1:] = solid[:-1] & (~solid[1:] | begins[1:])
    starts, ends = np.flatnonzero(begins[:-1]), np.flatnonzero(ends)
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, U64)
    sizes = ends - starts
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    own = data[np.repeat(starts, sizes) + place].astype(U64) + U64(1)
    own *= powers(int(sizes.max()))[place]
    return mix(np.add.reduceat(own, first) ^ sizes.astype(U64) * U64(0xD6E8FEB86659FD93))


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n neighbouring hashes (len - n + 1 of them)."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    total = np.zeros(len(hashes) - n + 1, U64)
    for i in range(n):
        total = total * U64(0xC2B2AE3D27D4EB4F) + hashes[i : len(hashes) - n + 1 + i]
    return mix(total ^ U64(n))


#: log2 of the bits of a filter at least and at most (128 kB and 32 MB).
BLOOM_BITS = (20, 28)


def bloom(ids: DataFrame) -> np.ndarray:
    """A bit set of the ids in the one long column: some sixteen bits an id, within BLOOM_BITS.

    A member always answers yes; others answer yes at times: one in 200 up to 16 million ids, and more often beyond
    (one in three with 100 million). It only saves traffic: whoever uses it must be right for any answer to a stranger.
    """
    (c,) = ids.columns
    n = ids.agg(F.approx_count_distinct(c)).first()[0]
    bits = 1 << min(max((16 * n).bit_length(), BLOOM_BITS[0]), BLOOM_BITS[1])
    spots = ids.select(F.explode(F.array(*[F.pmod(F.xxhash64(F.col(c), F.lit(k)), F.lit(bits)) for k in range(3)])).alias("spot"))
    rows = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("mask"))
    table = np.zeros(bits >> 6, np.int64)
    got = rows.toArrow()
    if got.num_rows:
        table[got["word"].to_numpy()] = got["mask"].to_numpy()
    return table


def spots(c: str, table: np.ndarray) -> list:
    """The columns that `in_bloom` reads, worked out by Spark's own hash."""
    return [F.pmod(F.xxhash64(F.col(c), F.lit(k)), F.lit(64 * len(table))).alias(f"_spot{k}") for k in range(3)]


def in_bloom(table: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    hit = np.ones(batch.num_rows, bool)
    for k in range(3):
        spot = batch.column(batch.schema.get_field_index(f"_spot{k}")).to_numpy(zero_copy_only=False)
        hit &= (table[spot >> 6] >> (spot & 63) & 1).astype(bool)
    return hit


def near_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id may be among ids (all that are, few others), found without moving any text."""
    held = docs.sparkSession.sparkContext.broadcast(bloom(ids))
    names = docs.columns

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bloom(held.value, batch))).select(names)

    return docs.select("*", *spots("doc_id", held.value)).mapInArrow(keep, docs.schema)


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of docs whose id is not among ids. Only rows that may be among them are moved; a null id stays."""
    held = docs.sparkSession.sparkContext.broadcast(bloom(ids))
    names = docs.columns

    def side(maybe: bool):
        def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = in_bloom(held.value, batch)
                yield batch.filter(pa.array(hit if maybe else ~hit)).select(names)

        return docs.select("*", *spots(id_col, held.value)).mapInArrow(keep, docs.schema)

    gone = ids.select(F.col(ids.columns[0]).alias("_gone")).distinct()
    return side(False).unionByName(side(True).join(gone, F.col(id_col) == F.col("_gone"), "left_anti"))
