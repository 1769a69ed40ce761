"""Token counts of a byte-pair vocabulary by rank-synchronous array merging.

Pre-tokens of many texts lie end to end in one array of symbols.  In each step every sequence applies the pair of
lowest rank that it holds, at all its places at once; sequences without a pair leave.  What is left of each is its
number of tokens, which is remembered for the next batch.  A sequence that is long (text without blanks, encoded bytes)
keeps its places in lists by rank instead, and after a step only the places beside a merge are ranked anew.
"""

from __future__ import annotations

import json
import unicodedata
from heapq import heapify, heappop, heappush
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import per_worker, pieces

LONG = 256  # bytes of a pre-token from which its places are kept by rank; it is not remembered
NEVER = np.int64(1) << 40
KNOWN_LIMIT = 400_000  # remembered pre-tokens of a worker; more are forgotten together and counted anew


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """Arrays of a word-end byte-pair vocabulary: first symbols, and pairs by key with rank and product."""

    inner: np.ndarray
    final: np.ndarray
    size: int
    keys: np.ndarray
    ranks: np.ndarray
    products: np.ndarray
    pattern: str
    specials: tuple[str, ...]

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, suffix = data["model"], data["model"]["end_of_word_suffix"]
        kinds = [n["type"] for n in data["normalizer"]["normalizers"]]
        split = data["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or not suffix:
            raise ValueError("not a lower-case word-end vocabulary")
        ids = model["vocab"]
        signs = byte_symbols()
        pairs = np.array([(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]], np.int64)
        keys = pairs[:, 0] * len(ids) + pairs[:, 1]
        order = np.argsort(keys)
        specials = tuple(t["content"] for t in data["added_tokens"])
        return Vocabulary(np.array([ids[s] for s in signs], np.int64), np.array([ids[s + suffix] for s in signs], np.int64), len(ids), keys[order], order.astype(np.int64), pairs[order, 2], split["pattern"]["Regex"], specials)


    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair (``NEVER`` for those that do not merge), and its place in the table."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER), at


def merged_length(word: bytes, v: Vocabulary) -> int:
    """Symbols of one long word that survive all merges; the time is near to linear in its bytes."""
    raw = np.frombuffer(word, np.uint8)
    symbols = v.inner[raw]
    symbols[-1] = v.final[raw[-1]]
    n = left = len(symbols)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    rank = np.full(n, NEVER)
    rank[:-1], _ = v.rank(symbols[:-1], symbols[1:])
    waiting: dict[int, list[int]] = {}
    for place in np.flatnonzero(rank < NEVER).tolist():
        waiting.setdefault(int(rank[place]), []).append(place)
    ranks = list(waiting)
    heapify(ranks)
    while ranks:
        lowest = heappop(ranks)
        at = np.unique(np.array(waiting.pop(lowest), np.int64))
        at = at[rank[at] == lowest]
        if not len(at):
            continue
        # of overlapping places (one symbol repeated) every other one counts, from the left
        turn = np.arange(len(at))
        chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
        at = at[(turn - np.maximum.accumulate(np.where(chained, 0, turn))) % 2 == 0]
        _, row = v.rank(symbols[at[:1]], symbols[after[at[:1]]])
        gone = after[at]
        symbols[at] = v.products[row[0]]
        far = after[gone]
        after[at] = far
        inside = far < n
        before[far[inside]] = at[inside]
        rank[gone] = NEVER
        left -= len(at)
        beside = before[at]
        touched = np.concatenate([at, beside[beside >= 0]])
        right = after[touched]
        rank[touched] = NEVER
        touched, right = touched[right < n], right[right < n]
        rank[touched], _ = v.rank(symbols[touched], symbols[right])
        for place, r in zip(touched.tolist(), rank[touched].tolist()):
            if r < NEVER:
                if r not in waiting:
                    waiting[r] = []
                    heappush(ranks, r)
                waiting[r].append(place)
    return left


def merged_lengths(words: list[bytes], v: Vocabulary) -> np.ndarray:
    """Symbols that survive all merges, for each non-empty word."""
    if any(len(w) > LONG for w in words):
        out = np.zeros(len(words), np.int64)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        out[short] = merged_lengths([words[i] for i in short], v) if short else 0
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = merged_length(w, v)
        return out
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    symbols = v.inner[raw]
    ends = np.cumsum(lengths)
    symbols[ends - 1] = v.final[raw[ends - 1]]
    row = np.repeat(np.arange(len(words)), lengths)
    out = lengths.copy()
    while len(symbols) > 1:
        rank, at = v.rank(symbols[:-1], symbols[1:])
        rank = np.append(np.where(row[:-1] == row[1:], rank, NEVER), NEVER)
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        size = np.diff(np.append(first, len(row)))
        lowest = np.repeat(np.minimum.reduceat(rank, first), size)
        hit = (rank == lowest) & (lowest < NEVER)
        # of overlapping places (one symbol repeated) every other one counts, from the left
        place = np.arange(len(hit))
        begin = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), place, 0))
        hit &= (place - begin) % 2 == 0
        where = np.flatnonzero(hit)
        symbols[where] = v.products[at[where]]
        alive = lowest < NEVER
        alive[where + 1] = False
        out -= np.bincount(row[where], minlength=len(out))
        symbols, row = symbols[alive], row[alive]
    return out


class Counter:
    """Token counts of whole texts; keeps what it learned about pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.specials))) if vocabulary.specials else None
        self.known: dict[str, int] = {}

    def words(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text and the number of its special tokens, which match before anything is changed."""
        parts, special = [text], 0
        if self.special is not None and "<" in text:
            parts = self.special.split(text)
            special = len(parts) - 1
        out: list[str] = []
        for part in parts:
            part = part if part.isascii() else unicodedata.normalize("NFC", part)
            low = part.lower() if "Σ" not in part else "".join(map(str.lower, part))  # letter by letter
            found = self.find(low)
            out = out + found if out else found
        return out, special

    def count(self, texts: list[str]) -> list[int]:
        split = [self.words(t) for t in texts]
        new = set().union(*(w for w, _ in split)) - self.known.keys()
        if len(self.known) + len(new) > KNOWN_LIMIT:
            self.known.clear()
            new = set().union(*(w for w, _ in split))
        long: dict[str, int] = {}
        if new:
            fresh = list(new)
            for w, n in zip(fresh, merged_lengths([w.encode("utf-8") for w in fresh], self.v).tolist()):
                (self.known if len(w) <= LONG else long)[w] = n
        known = self.known
        get = known.__getitem__ if not long else lambda w: known[w] if w in known else long[w]
        return [sum(map(get, w)) + n for w, n in split]


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of every row; a narrow map without a shuffle.

    The vocabulary is read on the driver (about a megabyte of arrays) and travels with the function.  Null texts count
    as empty: no bytes, no tokens.  Repeated rows and null ids come back as they are; other columns are not read.
    """
    vocabulary = Vocabulary.load(vocabulary_path)

    def run(batches):
        counter = per_worker(("bpe", vocabulary_path), lambda: Counter(vocabulary))
        for whole in batches:
            for batch in pieces(whole, 1, 1 << 20):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                n = counter.count(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
