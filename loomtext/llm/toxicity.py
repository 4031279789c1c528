"""Toxicity by classifier chains over hashed words.

Method. Categories are predicted one after the other by linear models: each sees the words, word pairs and word beginnings present in
the text and the probabilities of the categories before it. For training those probabilities come from out-of-fold models, so that a
later model learns from what it will meet. Words that tell nothing of a category on the sample (a small log-odds ratio
for its error) have no weight. Each category's margins are calibrated out of fold by Platt's scaling.

Defined cases: null or blank text has no words and the categories' base probabilities. A category whose labels are all
alike is predicted as that share, and without any labels all probabilities are 0. Repeated rows and null ids are scored
like others; an empty table gives an empty one. A probability at the threshold is toxic; of the labelled documents those
with the least hash of their id are fitted on. A very long text is one step of work, in proportion to its length. Other
columns are not read, whatever their names; `drop_toxic` hands them on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, documents, mix, rolled, steps, text_bytes, word_hashes, words
from .labelled import MAX_LABELLED, sample
from .linear import Rows, fit, folds, logistic, sigmoid, sums
from .quality_rules import sparse_rows

BITS = 18
#: Fewest texts that a word must be in to count, and its log-odds ratio in standard errors.
LEAST_TEXTS, LEAST_Z = 4, 4.0
#: Bytes of the word beginnings that are features too, once for each number of times that a text has one at least.
STEMS, STEM_TIMES = (6, 7), (1, 2, 3, 5)
#: All ASCII but letters and digits separates words here.
OTHER = np.zeros(256, bool)
OTHER[:128] = [not chr(i).isalnum() for i in range(128)]


def present(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text (words, pairs of words, word beginnings), flat, and where each text's begin (n + 1)."""
    data, at = text_bytes(batch.column(column))
    data = LOWER[data]
    starts, ends, before = words(data, at, OTHER)
    hashes = word_hashes(data, starts, ends)
    text = np.repeat(np.arange(batch.num_rows), np.diff(before)).astype(U64) << U64(BITS)
    shift = U64(64 - BITS)
    pairs = rolled(hashes, 2)
    inside = text[1:] == text[:-1]
    keys = [text | (hashes >> shift), text[:-1][inside] | (pairs[inside] >> shift)]
    for size in STEMS:
        long = ends - starts >= size
        stems = word_hashes(data, starts[long], starts[long] + size)
        kinds, times = np.unique(text[long] | (mix(stems + U64(size)) >> shift), return_counts=True)
        for least in STEM_TIMES:
            often = kinds[times >= least]
            keys.append((often >> U64(BITS) << U64(BITS)) | (mix((often & U64((1 << BITS) - 1)) * U64(64) + U64(size * 8 + least)) >> shift))
    key = np.unique(np.concatenate(keys))
    return (key & U64((1 << BITS) - 1)).astype(np.int64), np.searchsorted(key, np.arange(batch.num_rows + 1, dtype=U64) << U64(BITS))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        idx, at = present(batch, batch.num_columns - 1)
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(idx.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), lists], names=[*batch.schema.names[:-1], "idx"])


def telling(rows: Rows, y: np.ndarray) -> np.ndarray:
    """Features whose presence tells something of y."""
    owner = np.repeat(np.arange(len(y)), rows.at[1:] - rows.at[:-1])
    up, n = y.sum() + 1.0, len(y) + 2.0
    a = np.bincount(rows.idx, y[owner], minlength=1 << BITS)
    c = np.bincount(rows.idx, minlength=1 << BITS)
    ratio = np.log((a + 0.5) / (up - a + 0.5)) - np.log((c - a + 0.5) / (n - up - (c - a) + 0.5))
    error = np.sqrt(1 / (a + 0.5) + 1 / (c - a + 0.5) + 1 / (up - a + 0.5) + 1 / (n - up - c + a + 0.5))
    return (c >= LEAST_TEXTS) & (np.abs(ratio) > LEAST_Z * error)


def _model(rows: Rows, y: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    if len(set(y.tolist())) < 2:
        share = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
        return np.zeros(1 << BITS), np.zeros(extra.shape[1]), float(np.log(share / (1 - share)))
    known = telling(rows, y)
    names = np.flatnonzero(known)
    place = np.zeros(1 << BITS, np.int64)
    place[names] = np.arange(len(names))
    use = known[rows.idx]
    small = Rows(np.concatenate([[0], np.cumsum(use)])[rows.at], place[rows.idx[use]], rows.val[use])
    w, v, b = fit(small, y, len(names), extra, l2=0.3, rounds=200, rate=0.1)
    full = np.zeros(1 << BITS)
    full[names] = w
    return full, v, b


def _apply(model, rows: Rows, extra: np.ndarray) -> np.ndarray:
    w, v, b = model
    return sums(w[rows.idx] * rows.val, rows.at) + extra @ v + b


def train_chain(rows: Rows, ids: np.ndarray, labels: np.ndarray, n_folds: int = 3) -> list[tuple[np.ndarray, np.ndarray, float, float, float]]:
    """A model for each column of labels, in order: weights, weights of earlier probabilities, bias, Platt's two numbers."""
    fold = folds(ids, n_folds)
    earlier, chain = np.zeros((len(ids), 0)), []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        model = _model(rows, y, earlier)
        slope, shift = 1.0, 0.0
        margin = _apply(model, rows, earlier)
        if len(set(y.tolist())) == 2:
            for f in range(n_folds):
                out, inside = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
                if len(out) and len(inside):
                    margin[out] = _apply(_model(rows.take(inside), y[inside], earlier[inside]), rows.take(out), earlier[out])
            slope, shift = logistic(margin[:, None], y)
        chain.append((model[0].astype(np.float32), model[1], model[2], float(slope), float(shift)))
        earlier = np.column_stack([earlier, sigmoid(slope * margin + shift)])
    return chain


def chain_probabilities(chain, idx: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each text's probability of each category (n x categories)."""
    earlier = np.zeros((len(at) - 1, 0))
    for w, v, b, slope, shift in chain:
        z = sums(w[idx], at) + earlier @ v + b
        earlier = np.column_stack([earlier, sigmoid(slope * z + shift)])
    return earlier


def _score(model, names: list[str], last: str, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            p = chain_probabilities(model.value, *present(batch, 1)) if model.value else np.zeros((batch.num_rows, len(names)))
            toxic = p[:, -1] >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, i]) for i in range(len(names))), pa.array(toxic), pa.array(~toxic)], names=["doc_id", *(f"p_{n}" for n in names), last, "kept"])

    return run


def _fitted(own: DataFrame, labels: DataFrame, categories: dict[str, str], limit: int):
    """The chain, broadcast; its size is fixed."""
    names = list(categories)
    chosen = sample(labels.select("doc_id", *[F.expr(e).alias(n) for n, e in categories.items()]), names, limit)
    typed = ", ".join(f"{n} int" for n in names)
    ids, table, rows = sparse_rows(own.join(F.broadcast(chosen), "doc_id").select("doc_id", *names, "text").mapInArrow(_rows, f"doc_id long, {typed}, idx array<int>").toArrow())
    y = np.column_stack([table[n].to_numpy() for n in names])
    return own.sparkSession.sparkContext.broadcast(train_chain(rows, ids, y) if len(ids) else [])


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, limit: int = MAX_LABELLED) -> DataFrame:
    """One row per document: doc_id, p_<category> for each category in chain order, <last category> boolean, kept.

    categories: name -> SQL expression over labels that gives 0 or 1, in the order of the chain. The last one decides.
    """
    own, names = documents(docs, id_col, text_col), list(categories)
    model = _fitted(own, labels, categories, limit)
    schema = ", ".join(["doc_id long", *(f"p_{n} double" for n in names), f"{names[-1]} boolean", "kept boolean"])
    return own.mapInArrow(_score(model, names, names[-1], threshold), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, limit: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs that `toxicity` keeps, with all their columns; nothing is moved."""
    model = _fitted(documents(docs, id_col, text_col), labels, categories, limit)
    place = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_col):
            if model.value:
                batch = batch.filter(pa.array(chain_probabilities(model.value, *present(batch, place))[:, -1] < threshold))
            yield batch

    return docs.mapInArrow(run, docs.schema)
