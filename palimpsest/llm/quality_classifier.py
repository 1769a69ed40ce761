"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are counts over whole texts, taken for many texts at once from their bytes.  Trees are complete to a
fixed depth and lie in flat arrays, so that scoring is ``depth`` gathers a tree for a whole batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import binary_parts, gram_hashes, is_held_out, pieces, train_rows, word_hashes, word_spans

TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAF = 100, 4, 64, 0.15, 1.0, 10

_CLASS = np.zeros(256, np.int64)
for _n, _members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".,;:?'\"-()", b"!", b"|", b"#*$%&<>~^_={}[]\\/@+`"), start=1):
    _CLASS[list(_members)] = _n
CLASSES = 10  # the first: bytes of other alphabets and controls

FEATURES = ("words", "word_bytes", "other", "lower", "upper", "digit", "newline", "stop", "shout", "bar", "symbol", "distinct", "distinct_4", "twice_in_row", "longest", "short", "lines", "dup_lines", "upper_first")


def features(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """One row of statistics for each text; a text without words has zeros."""
    raw, offsets = binary_parts(texts)
    n = len(offsets) - 1
    doc_of_byte = np.repeat(np.arange(n), np.diff(offsets))
    by_class = np.bincount(doc_of_byte * CLASSES + _CLASS[raw], minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float64)
    starts, ends, first = word_spans(raw, offsets)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n), n_words)
    length = ends - starts
    hashes = word_hashes(raw, starts, ends)
    per = lambda flags, of=doc: np.bincount(of[flags], minlength=n).astype(np.float64)

    def distinct(value: np.ndarray, of: np.ndarray) -> np.ndarray:
        shift = np.uint64(40)
        tagged = np.sort((of.astype(np.uint64) << shift) | (value >> np.uint64(24)))
        new = np.concatenate([[True], tagged[1:] != tagged[:-1]]) if len(tagged) else np.zeros(0, bool)
        return np.bincount((tagged[new] >> shift).astype(np.int64), minlength=n).astype(np.float64)

    grams = gram_hashes(hashes, 4)
    inside = doc[: len(grams)] == doc[3:] if len(grams) else np.zeros(0, bool)
    twice = np.zeros(len(doc), bool)
    twice[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    not_line = np.zeros(256, bool)
    not_line[10] = True
    l_starts, l_ends, l_first = word_spans(raw, offsets, not_line)
    l_doc = np.repeat(np.arange(n), np.diff(l_first))
    n_lines = np.diff(l_first).astype(np.float64)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    w, size = np.maximum(n_words, 1).astype(np.float64), np.maximum(np.diff(offsets), 1).astype(np.float64)
    n_grams = np.maximum(np.bincount(doc[: len(grams)][inside], minlength=n), 1)
    columns = [
        np.log1p(n_words), np.bincount(doc, weights=length, minlength=n) / w, by_class[:, 0] / size, by_class[:, 1] / size, by_class[:, 2] / size, by_class[:, 3] / size,
        by_class[:, 5] / w, by_class[:, 6] / w, by_class[:, 7] / w, by_class[:, 8] / w, by_class[:, 9] / w,
        distinct(hashes, doc) / w, distinct(grams[inside], doc[: len(grams)][inside]) / n_grams, per(twice) / w, np.log1p(longest), per(length <= 2) / w,
        n_words / np.maximum(n_lines, 1), (n_lines - distinct(word_hashes(raw, l_starts, l_ends), l_doc)) / np.maximum(n_lines, 1),
        per(_CLASS[raw[starts]] == 2) / w if len(starts) else np.zeros(n),
    ]
    return np.stack(columns, axis=1)


@dataclass(frozen=True)
class Trees:
    """A boosted model in flat arrays: inner nodes ``[tree, 2 ** depth - 1]``, leaves ``[tree, 2 ** depth]``."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boost logistic loss on binned columns; with no rows or one class only the model is the smoothed share."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    nodes, f = 2**depth - 1, x.shape[1]
    if len(np.unique(y)) < 2:
        return Trees(base, np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    cell = binned + np.arange(f) * bins
    total = np.full(len(y), base)
    out = ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        feature, threshold, leaf = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(nodes + 1)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            low, count = 2**level - 1, 2**level
            at = ((node - low) * (f * bins))[:, None] + cell
            hist = [np.bincount(at.ravel(), weights=np.repeat(w, f), minlength=count * f * bins).reshape(count, f, bins).cumsum(axis=2) for w in (grad, hess, np.ones(len(y)))]
            (g, h, c), (tg, th, tc) = hist, (a[:, :1, -1:] for a in hist)
            gain = g**2 / (h + L2) + (tg - g) ** 2 / (th - h + L2) - tg**2 / (th + L2)
            gain[(c < LEAF) | (tc - c < LEAF)] = 0
            for k, e in enumerate(edges):
                gain[:, k, len(e) :] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for i, b in enumerate(best):
                if gain[i].ravel()[b] > 1e-9:
                    feature[low + i], threshold[low + i] = b // bins, edges[b // bins][b % bins]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        end = node - nodes
        leaf = -rate * np.bincount(end, weights=grad, minlength=nodes + 1) / (np.bincount(end, weights=hess, minlength=nodes + 1) + L2)
        total += leaf[end]
        for store, a in zip(out, (feature, threshold, leaf)):
            store.append(a)
    return Trees(base, *map(np.stack, out))


def _features_of(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def run(batches):
        for whole in batches:
            for batch in pieces(whole, 0):
                x = features(batch.column(0))
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    got = rows.mapInArrow(run, "x array<double>, y int").toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = got.column("y").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))  # the model must not depend on the order in which rows arrive
    return x[order], y[order]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", **shape) -> Trees:
    """Fit on at most ``rows`` labelled documents (the bound on what reaches the driver), held-out ids never."""
    return fit(*_features_of(train_rows(docs, labels, label, rows, id_col, text_col)), **shape)


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row; a narrow map without a shuffle.

    Null and empty texts have zero statistics and are scored like any other.  Repeated rows and null ids come back as
    they are (a null id is not held out); other columns are not read.
    """

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, 1):
                s = model.score(features(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = own.mapInArrow(run, "doc_id long, score double, predicted int")
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
