"""Quality classification by co-training of a text view and a metadata view.

Method. The text view is a naive Bayes model of hashed character triples, the metadata view one of source, language and
size class. Both start from labelled documents. In each round both score every unlabelled document; what one view is
confident of joins the other's training counts under that pseudo-label. Counts add up, so a round is one pass over the
documents and one aggregate of bounded size. Labelled documents that no counts hold calibrate each view by Platt's
scaling, before each round and at the end, where a logistic regression combines the calibrated views to score all. It is
fitted on views calibrated out of fold, so that it meets margins that their calibration has not seen.

Defined cases: null or blank text has text evidence nought; null metadata is a value of its own. Without labels of both
kinds the probability is null and all is kept. Repeated rows and null ids are scored like others, and repeated rows count
as often in pseudo-labels; an empty table gives an empty one. A probability at the threshold is kept; of the labelled
documents those with the least hash of their id are used. A very long text is one step of work, in proportion to its
length. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, rolled, saved, steps, text_bytes
from .labelled import MAX_LABELLED, sample
from .linear import folds, logistic, sigmoid

TEXT_BITS, META_BITS = 16, 12
#: Smoothing of the two views' counts.
TEXT_PRIOR, META_PRIOR = 1.0, 2.0


@dataclass
class Views:
    """Log-odds of each feature under good against bad quality, and each view's Platt numbers."""

    text: np.ndarray
    meta: np.ndarray
    platt: tuple[np.ndarray, np.ndarray]
    both: np.ndarray


def _triples(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed character triples of all texts; where each text's begin and end."""
    data, at = text_bytes(batch.column(1))
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(U64)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
    runs = (rolled(points, 3) >> U64(64 - TEXT_BITS)).astype(np.int64)
    first = np.minimum(at[:-1], len(runs))
    return runs, first, np.clip(at[1:] - 2, first, len(runs))


def _meta(batch: pa.RecordBatch) -> np.ndarray:
    return np.vstack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, batch.num_columns - 1)])


def _evidence(views: Views, batch: pa.RecordBatch, triples) -> tuple[np.ndarray, np.ndarray]:
    runs, first, last = triples
    total = np.concatenate([[0.0], np.cumsum(views.text[runs])])
    return (total[last] - total[first]) / np.maximum(last - first, 1), views.meta[_meta(batch)].sum(axis=0)


def _odds(counts: np.ndarray, prior: float) -> np.ndarray:
    """log P(feature | good) - log P(feature | bad) of counts (2 x features)."""
    p = np.log(counts + prior) - np.log(counts.sum(axis=1, keepdims=True) + prior * counts.shape[1])
    return p[1] - p[0]


def _counted(views, sure: float):
    """Counts by (view, feature, class) of a task's documents: with their labels, or with what the other view is sure of."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, meta = np.zeros((2, 1 << TEXT_BITS)), np.zeros((2, 1 << META_BITS))
        for batch in steps(batches):
            triples = _triples(batch)
            runs, first, last = triples
            if views is None:
                label = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
                by_text = by_meta = label
            else:
                t, m = _evidence(views.value, batch, triples)
                pt, pm = (sigmoid(a * x + b) for x, (a, b) in zip((t, m), views.value.platt, strict=True))
                by_text, by_meta = (np.where(p >= sure, 1, np.where(p <= 1 - sure, 0, -1)) for p in (pt, pm))
            for k in (0, 1):
                edge = np.zeros(len(runs) + 1, np.int8)
                chosen = by_meta == k  # the text view learns from the metadata view, and the other way round
                np.add.at(edge, first[chosen], 1)
                np.add.at(edge, last[chosen], -1)
                text[k] += np.bincount(runs[np.cumsum(edge[:-1], dtype=np.int8) > 0], minlength=1 << TEXT_BITS)
                meta[k] += np.bincount(_meta(batch)[:, by_text == k].ravel(), minlength=1 << META_BITS)
        for view, counts in enumerate((text, meta)):
            k, feature = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), view, np.int32)), pa.array(feature.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(counts[k, feature])], names=["view", "feature", "class", "n"])

    return run


def _gather(df: DataFrame, views, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """The summed counts of both views; at most twice as many rows as there are features."""
    got = df.mapInArrow(_counted(views, sure), "view int, feature int, class int, n double").groupBy("view", "feature", "class").agg(F.sum("n").alias("n")).toArrow()
    text, meta = np.zeros((2, 1 << TEXT_BITS)), np.zeros((2, 1 << META_BITS))
    view, feature, k, n = (got[c].to_numpy() for c in ("view", "feature", "class", "n"))
    for which, counts in enumerate((text, meta)):
        own = view == which
        counts[k[own], feature[own]] = n[own]
    return text, meta


def _margins(views):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            t, m = _evidence(views.value, batch, _triples(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(batch.num_columns - 1), pa.array(t), pa.array(m)], names=["doc_id", "y", "t", "m"])

    return run


def _score(views, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            if views.value is None:
                none = pa.nulls(batch.num_rows, pa.float64())
                cols = [none, none, none, pa.array(np.ones(batch.num_rows, bool))]
            else:
                v = views.value
                t, m = _evidence(v, batch, _triples(batch))
                zt, zm = (a * x + b for x, (a, b) in zip((t, m), v.platt, strict=True))
                p = sigmoid(v.both[0] * zt + v.both[1] * zm + v.both[2])
                cols = [pa.array(sigmoid(zt)), pa.array(sigmoid(zm)), pa.array(p), pa.array(p >= threshold)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "text_prob", "meta_prob", "quality_prob", "kept"])

    return run


def _out_of_fold(x: np.ndarray, y: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Each margin calibrated by the other half of the rows; by all where that has only one kind of label."""
    out = np.empty(len(x))
    for k in (0, 1):
        other = half != k if len(set(y[half != k].tolist())) == 2 else np.ones(len(y), bool)
        slope, shift = logistic(x[other][:, None], y[other])
        out[half == k] = slope * x[half == k] + shift
    return out


def co_train(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ("source", "lang"), size: str = "n_chars", id_col: str = "doc_id", text_col: str = "text", label: str = "quality", rounds: int = 2, sure: float = 0.97, threshold: float = 0.5, limit: int = MAX_LABELLED) -> DataFrame:
    """One row per document: doc_id, text_prob, meta_prob, quality_prob (all of good quality), kept."""
    spark = docs.sparkSession
    width = F.lit(1 << META_BITS)
    features = [F.pmod(F.xxhash64(F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("\0"))), width).alias(f"_m{i}") for i, c in enumerate(metadata)]
    features.append(F.pmod(F.xxhash64(F.lit(size), F.coalesce(F.floor(F.log2(F.greatest(F.col(size).cast("double"), F.lit(1.0)))), F.lit(-1))), width).alias("_size"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *features)
    chosen = sample(labels, [label], limit).withColumnRenamed(label, "_y")
    known = saved(own.join(F.broadcast(chosen), "doc_id"))
    held_out = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) == 0
    seeds, trial = known.where(~held_out), known.where(held_out)
    text, meta = seed_text, seed_meta = _gather(seeds, None, sure)
    names = own.columns

    def fitted(text: np.ndarray, meta: np.ndarray) -> Views | None:
        views = Views(_odds(text, TEXT_PRIOR), _odds(meta, META_PRIOR), (np.zeros(2), np.zeros(2)), np.zeros(3))
        got = trial.mapInArrow(_margins(spark.sparkContext.broadcast(views)), "doc_id long, y int, t double, m double").toArrow().sort_by([("doc_id", "ascending"), ("t", "ascending")])
        y, t, m = (got[c].to_numpy().astype(float) for c in ("y", "t", "m"))
        half = folds(got["doc_id"].to_numpy(), 2)
        if len(set(y.tolist())) < 2 or not seed_meta.sum(axis=1).all():
            return None
        views.platt = (logistic(t[:, None], y), logistic(m[:, None], y))
        views.both = logistic(np.column_stack([_out_of_fold(x, y, half) for x in (t, m)]), y)
        return views

    views = fitted(text, meta)
    pool = own.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti").select(*names, F.lit(-1).alias("_y"))
    for _ in range(rounds if views else 0):
        more_text, more_meta = _gather(pool, spark.sparkContext.broadcast(views), sure)
        views = fitted(seed_text + more_text, seed_meta + more_meta)
    schema = "doc_id long, text_prob double, meta_prob double, quality_prob double, kept boolean"
    return own.select(*names, F.lit(-1).alias("_y")).mapInArrow(_score(spark.sparkContext.broadcast(views), threshold), schema)
