"""Quality rules: counted limits, and a hashed n-gram logistic regression with calibrated probabilities.

Method. Word runs of one and two and character runs of three and four are hashed to 2^17 features, each weighted by its
share of the document's runs. A logistic regression is fitted on a bounded sample of labelled documents; its margins
from out-of-fold models calibrate it by Platt's scaling. The models are fitted side by side, each in a task of its own.
All documents are scored in Arrow batches, and are kept at a fixed threshold if the counted limits hold.

Defined cases: null or blank text has no words, fails the limits and is not kept. Without labels of both kinds the
probability is null and the limits alone decide. Repeated rows and null ids are scored like others; an empty table gives
an empty one. A probability at the threshold is kept; of the labelled documents those with the least hash of their id are
fitted on. A very long text is one step of work, in proportion to its length; as a labelled one it has as many features
as there are at most. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, documents, mix, rolled, saved, steps, text_bytes, word_hashes, words
from .labelled import MAX_LABELLED, sample
from .linear import Rows, fit, folds, logistic, sigmoid, sums

BITS = 17
#: Weight of a document's share of a feature; only sets the scale of the fitted weights.
SCALE = 30.0
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 8


def _features(data: np.ndarray, at: np.ndarray, hashes: np.ndarray, before: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of run: the features of all texts, and where each text's begin and end (2 x n)."""
    shift = U64(64 - BITS)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(U64)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
    out = []
    for items, edges, sizes in ((hashes, before, (1, 2)), (points, at, (3, 4))):
        for n in sizes:
            runs = rolled(items, n) >> shift
            first = np.minimum(edges[:-1], len(runs))
            out.append((runs.astype(np.int64), np.vstack([first, np.clip(edges[1:] - n + 1, first, len(runs))])))
    return out


def _span_sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1), np.cumsum(values, dtype=np.float64)])
    return total[edges[1]] - total[edges[0]]


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each labelled text's features and their weights; as many as there are features at most."""
    for batch in steps(batches):
        data, at = text_bytes(batch.column(2))
        starts, ends, before = words(data, at)
        kinds = _features(data, at, word_hashes(data, starts, ends), before)
        idx, val = [], []
        for i in range(batch.num_rows):
            total = np.zeros(1 << BITS, np.float32)
            for runs, (a, b) in kinds:
                if b[i] > a[i]:
                    total += np.bincount(runs[a[i] : b[i]], minlength=1 << BITS).astype(np.float32) * np.float32(SCALE / (b[i] - a[i]))
            full = np.flatnonzero(total)
            idx.append(full.astype(np.int32))
            val.append(total[full])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], names=["doc_id", "y", "idx", "val"])


def sparse_rows(table: pa.Table) -> tuple[np.ndarray, pa.Table, Rows]:
    """Ids, table and sparse rows of a table of rows with idx and maybe val, in order of id."""
    table = table.sort_by("doc_id").combine_chunks()
    lists = table["idx"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    idx = lists.flatten().to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    val = np.ones(len(idx))
    if "val" in table.column_names:
        vals = table["val"].combine_chunks()
        vals = vals.chunk(0) if isinstance(vals, pa.ChunkedArray) else vals
        val = vals.flatten().to_numpy(zero_copy_only=False)
    return table["doc_id"].to_numpy(), table, Rows(at, idx, val)


N_FOLDS = 3


def _fit(table: pa.Table) -> pa.Table:
    """One model of the sample: of a fold, the margins of its rows by a model of the others; of number N_FOLDS, the weights of all rows' model.

    Rows out: (number, value) of each feature's weight, number -1 for the bias; or (label, margin) of each row.
    """
    model = table["model"][0].as_py()
    table = table.select(["doc_id", "y", "text"]).sort_by("doc_id")
    y, fold = table["y"].to_numpy().astype(float), folds(table["doc_id"].to_numpy(), N_FOLDS)
    inside, out = fold != model, fold == model
    number, value = np.zeros(0, np.int64), np.zeros(0)
    if len(set(y.tolist())) == 2 and inside.any():
        got = [(r.column(2), r.column(3)) for r in _rows(table.to_batches())]
        size = np.concatenate([x.value_lengths().to_numpy() for x, _ in got]).astype(np.int64)
        idx, val = (np.concatenate([r[i].flatten().to_numpy() for r in got]) for i in range(2))
        del got, table
        names = np.flatnonzero(np.bincount(idx, minlength=1 << BITS))
        place = np.zeros(1 << BITS, np.int32)
        place[names] = np.arange(len(names))
        idx = place[idx]

        def part(which: np.ndarray) -> Rows:
            mine = np.repeat(which, size)
            return Rows(np.concatenate([[0], np.cumsum(size[which])]), idx[mine], val[mine])

        w, _, b = fit(part(inside), y[inside], len(names))
        own = part(out)
        number, value = (np.append(names, -1), np.append(w, b)) if model == N_FOLDS else (y[out].astype(np.int64), sums(w[own.idx] * own.val, own.at) + b)
    return pa.table({"model": pa.array(np.full(len(number), model), pa.int32()), "number": pa.array(number, pa.int64()), "value": value})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_LABELLED) -> tuple[np.ndarray, float, np.ndarray] | None:
    """Feature weights, bias and Platt's two numbers; None without both kinds of label.

    Texts of the sample go to the four tasks, which make the features: these would be many times the texts' bytes in a
    shuffle. The sample is bounded in rows, and each row in features; the driver gets weights and margins.
    """
    chosen = sample(labels, [label], limit)
    rows = saved(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", F.col(label).alias("y"), "text"))
    each = rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(N_FOLDS))))
    got = each.groupBy("model").applyInArrow(_fit, "model int, number long, value double").toArrow()
    model, number, value = (got[c].to_numpy() for c in ("model", "number", "value"))
    whole = model == N_FOLDS
    if not whole.any():
        return None
    w = np.zeros(1 << BITS, np.float32)
    feature = whole & (number >= 0)
    w[number[feature]] = value[feature]
    order = np.lexsort((value[~whole], number[~whole]))
    margin, y = value[~whole][order], number[~whole][order].astype(float)
    return w, float(value[whole & (number < 0)][0]), logistic(margin[:, None], y) if len(y) else np.array([1.0, 0.0])


def _line_repeats(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) == len(set(lines)):
        return 0
    seen, n = set(), 0
    for line in lines:
        if line in seen:
            n += bool(line.strip(" \t\n\r\x0b\x0c"))
        else:
            seen.add(line)
    return n


def counts(batch: pa.RecordBatch, column: int, data: np.ndarray, at: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    own = np.concatenate([[0], np.cumsum(chars[ends] - chars[starts])])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    lines = np.array([_line_repeats(t or "") for t in batch.column(column).to_pylist()], np.int64)
    covered = np.zeros(len(starts) + 1, np.int32)
    if len(starts) >= WINDOW:
        runs = rolled(hashes, WINDOW)
        text = np.searchsorted(before, np.arange(len(runs)), side="right") - 1
        inside = np.flatnonzero(np.arange(len(runs)) + WINDOW <= before[text + 1])
        key = runs[inside] ^ mix(text[inside].astype(U64))
        order = np.argsort(key)
        twin = key[order][1:] == key[order][:-1]
        hit = np.zeros(len(inside), bool)
        hit[order[1:][twin]] = True
        hit[order[:-1][twin]] = True
        np.add.at(covered, inside[hit], 1)
        np.add.at(covered, inside[hit] + WINDOW, -1)
    repeats = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    return [np.diff(before), own[before[1:]] - own[before[:-1]], symbols[at[1:]] - symbols[at[:-1]], lines, repeats[before[1:]] - repeats[before[:-1]]]


def _score(model, least_words: int, most_repeats: int, threshold: float):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_prob"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            data, at = text_bytes(batch.column(1))
            starts, ends, before = words(data, at)
            hashes = word_hashes(data, starts, ends)
            base = counts(batch, 1, data, at, hashes, starts, ends, before)
            failed = (base[0] < least_words) | (100 * base[4] > most_repeats * base[0])
            kept, prob = ~failed, pa.nulls(batch.num_rows, pa.float64())
            if model.value:
                w, b, (slope, shift) = model.value
                z = np.full(batch.num_rows, b)
                for runs, edges in _features(data, at, hashes, before):
                    z += SCALE * _span_sums(w[runs], edges) / np.maximum(edges[1] - edges[0], 1)
                p = sigmoid(slope * z + shift)
                kept, prob = kept & (p >= threshold), pa.array(p)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, base), pa.array(failed), pa.array(kept), prob], names=names)

    return run


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", least_words: int = 20, most_repeats: int = 30, threshold: float = 0.35, limit: int = MAX_LABELLED) -> DataFrame:
    """One row per document: the counts, base_failed, kept and the calibrated probability of good quality."""
    own = documents(docs, id_col, text_col)
    model = own.sparkSession.sparkContext.broadcast(train(own, labels, label, limit))
    return own.mapInArrow(_score(model, least_words, most_repeats, threshold), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality_prob double")
