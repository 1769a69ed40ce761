"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence is toxic with probability ``sigmoid(bias + sum of its word weights)``
and the document if any of them is (noisy-or), so the weights are learned from document labels alone, and the same
weights point at the sentences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import binary_parts, is_held_out, materialize, mix64, pieces, release, train_rows, word_hashes, word_spans

TRAIN_ROWS = 20_000
PREFIXES = (6, 7, 8)  # characters of a word's beginning, for languages that compound
SCREEN = 12.0  # least likelihood-ratio statistic of a feature's documents against the share of the label (p about 0.0005)
STEPS, RATE, L2 = 200, 0.1, 1e-5
OFFENDING = 0.5

_PARTS = np.ones(256, bool)  # bytes between words: all but letters, digits and other alphabets
_PARTS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Bags:
    """Features of many texts, which are hashed words and beginnings of words: value, sentence (numbered through all
    texts) and text of each."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        raw, self.offsets = binary_parts(texts)
        self.raw = raw
        starts, ends, first = word_spans(raw, self.offsets, _PARTS)
        self.starts, self.ends = starts, ends
        low = _LOWER[raw]
        begins = np.append(np.flatnonzero((raw & 0xC0) != 0x80), np.full(max(PREFIXES), len(raw)))  # of the characters
        lead = np.searchsorted(begins, starts)
        shapes = [word_hashes(low, starts, ends)]
        for k in PREFIXES:
            cut = begins[lead + k]
            shapes.append(np.where(cut < ends, word_hashes(low, starts, np.minimum(ends, cut)), np.uint64(0)))
        doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(first))
        stop = np.concatenate([[0], np.cumsum(_ENDS[raw])])[starts] if len(starts) else np.zeros(0, np.int64)
        new = np.concatenate([[True], (stop[1:] != stop[:-1]) | (doc[1:] != doc[:-1])]) if len(starts) else np.zeros(0, bool)
        own = np.cumsum(new) - 1
        mixed = np.concatenate([mix64(h + np.uint64(k)) for k, h in enumerate(shapes)])
        real = np.concatenate([h != 0 for h in shapes])
        self.word = mixed[real].view(np.int64)
        self.sentence = np.tile(own, len(shapes))[real]
        self.first = np.flatnonzero(new)
        self.doc = doc[self.first]  # of each sentence


@dataclass(frozen=True)
class Model:
    bias: float
    words: np.ndarray  # sorted hashes that have a weight
    weights: np.ndarray

    def sentence_logits(self, word: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        if not len(self.words):
            return np.full(n, self.bias)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        hit = self.words[at] == word
        return self.bias + np.bincount(sentence[hit], weights=self.weights[at[hit]], minlength=n)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def loss(theta: np.ndarray, column: np.ndarray, row: np.ndarray, doc: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean noisy-or loss of the weights and bias ``theta``, and its gradient."""
    n, n_s = len(y), len(doc)
    z = theta[-1] + np.bincount(row, weights=theta[column], minlength=n_s)
    total = np.bincount(doc, weights=_softplus(z), minlength=n) + 1e-9  # minus log of "no sentence is toxic"
    value = np.where(y > 0, -np.log(-np.expm1(-total)), total).mean()
    outer = np.where(y > 0, -1 / np.expm1(np.minimum(total, 500)), 1.0) / n
    inner = outer[doc] / (1 + np.exp(-z))
    return float(value), np.append(np.bincount(column, weights=inner[row], minlength=len(theta) - 1), inner.sum())


def fit(words: np.ndarray, column: np.ndarray, row: np.ndarray, doc: np.ndarray, y: np.ndarray, steps: int = STEPS) -> Model:
    """Minimise the noisy-or loss by Adam.

    ``words`` are the features in order; ``column`` and ``row`` say which feature stands in which sentence, ``doc`` gives
    the document of each sentence and ``y`` the label of each document.  With no documents or one class only, no
    feature has a weight and every sentence gets the same extreme score.
    """
    if len(np.unique(y)) < 2:
        return Model(8.0 if y.any() else -8.0, np.zeros(0, np.int64), np.zeros(0))
    theta = np.zeros(len(words) + 1)
    theta[-1] = -5.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        _, grad = loss(theta, column, row, doc, y)
        grad[:-1] += L2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(float(theta[-1]), words, theta[:-1].copy())


def _telling(rows: DataFrame) -> np.ndarray:
    """All features whose documents are labelled unlike the rest by more than chance, by a distributed count."""

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, 0):
                bags = _Bags(batch.column(0))
                doc = bags.doc[bags.sentence] if len(bags.word) else np.zeros(0, np.int64)
                order = np.lexsort((bags.word, doc))
                doc, word = doc[order], bags.word[order]
                new = np.concatenate([[True], (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])]) if len(word) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(word[new]), batch.column(1).take(pa.array(doc[new]))], ["word", "y"])

    n, rate = rows.agg(F.count(F.lit(1)), F.coalesce(F.avg("y"), F.lit(0.0))).first()
    if not n or rate in (0.0, 1.0):
        return np.zeros(0, np.int64)
    counts = rows.mapInArrow(run, "word long, y int").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    part = lambda count, share: F.when(count > 0, count * F.log(count / (F.col("n") * share))).otherwise(0.0)
    told = counts.filter(2 * (part(F.col("pos"), rate) + part(F.col("n") - F.col("pos"), 1 - rate)) > SCREEN)
    return np.sort(told.select("word").toArrow().column("word").to_numpy())


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS) -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out part; all their telling features count.

    The driver sees these features and where they stand in those documents, not the texts.
    """
    sample = materialize(train_rows(docs, labels, label, rows, id_col, text_col), "labelled")
    words = _telling(sample)

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, 0):
                bags = _Bags(batch.column(0))
                at = np.searchsorted(words, bags.word)
                hit = np.flatnonzero(words[np.minimum(at, len(words) - 1)] == bags.word) if len(words) else np.zeros(0, np.int64)
                hit = hit[np.argsort(bags.sentence[hit], kind="stable")]
                n = np.bincount(bags.doc[bags.sentence[hit]], minlength=batch.num_rows) if len(hit) else np.zeros(batch.num_rows, np.int64)
                edges = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                n_sentences = np.bincount(bags.doc, minlength=batch.num_rows)
                first = np.cumsum(n_sentences) - n_sentences
                place = bags.sentence[hit] - first[bags.doc[bags.sentence[hit]]] if len(hit) else np.zeros(0, np.int64)
                lists = [pa.ListArray.from_arrays(edges, pa.array(a.astype(np.int32))) for a in (at[hit], place)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array(n_sentences.astype(np.int32)), batch.column(1), batch.column(2)], ["columns", "places", "n", "y", "h"])

    got = sample.select("text", "y", F.xxhash64("text").alias("h")).mapInArrow(run, "columns array<int>, places array<int>, n int, y int, h long").toArrow()
    got = got.sort_by([("h", "ascending"), ("y", "ascending")]).combine_chunks()  # the model must not depend on the order of rows
    n = got.column("n").to_numpy().astype(np.int64)
    flat = lambda name: np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in got.column(name).chunks)]).astype(np.int64)
    held = np.concatenate([np.zeros(0, np.int64), *(c.value_lengths().to_numpy() for c in got.column("columns").chunks)]).astype(np.int64)
    row = flat("places") + np.repeat(np.cumsum(n) - n, held)
    sample_model = fit(words, flat("columns"), row, np.repeat(np.arange(len(n)), n), got.column("y").to_numpy().astype(float), steps)
    release(sample)
    return sample_model


SCORES = "doc_id long, score double, predicted int, offending array<struct<start:int,stop:int,score:double>>"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` and ``offending`` of every row; a narrow map without a shuffle.

    ``offending`` lists the sentences of probability 0.5 or more by code point positions (first word to last word).
    A text without words has no sentence and scores 0.  Repeated rows and null ids come back as they are (a null id is
    not held out); other columns are not read.
    """

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, 1):
                bags = _Bags(batch.column(1))
                n, n_s = batch.num_rows, len(bags.first)
                z = model.sentence_logits(bags.word, bags.sentence, n_s)
                s = 1 - np.exp(-np.bincount(bags.doc, weights=_softplus(z), minlength=n))
                found: list[list[dict]] = [[] for _ in range(n)]
                last = np.append(bags.first[1:], len(bags.starts)) - 1
                for i in np.flatnonzero(z >= np.log(OFFENDING / (1 - OFFENDING))).tolist():
                    d, a, b = int(bags.doc[i]), int(bags.starts[bags.first[i]]), int(bags.ends[last[i]])
                    begin = int(bags.offsets[d])
                    start = int(((bags.raw[begin:a] & 0xC0) != 0x80).sum())
                    found[d].append({"start": start, "stop": start + int(((bags.raw[a:b] & 0xC0) != 0x80).sum()), "score": float(1 / (1 + np.exp(-z[i])))})
                kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(found, kind)], ["doc_id", "score", "predicted", "offending"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = own.mapInArrow(run, SCORES)
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "offending")
