"""Benchmark decontamination by pigeonhole edit matching.

A test item with a budget of k edits is cut into k + 1 pieces.  Wherever a document holds a copy within k edits, one
piece is in it unchanged; around each piece found the document is searched for the item with Myers' bit-parallel edit
distance, whose columns are single Python integers of as many bits as the item has characters.

Items of up to ``BLOCK_CHARS`` characters travel with the function, and an Aho-Corasick automaton finds their pieces in
one narrow pass.  More items are not sent: their pieces are a table of hashes, the documents' runs of the same lengths
that pass a bit filter of bounded size are joined to it, and what meets is brought together with the texts.  Either way
the documents are read once for the search, whatever the number of items.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import character_hashes, materialize, per_worker, pieces, shuffle_partitions, text_bytes

ERROR_RATE = 0.08
MIN_CHARS = 20
BLOCK_CHARS = 4 << 20
FILTER_BITS, PIECE_BITS = 29, 16  # the bit filter has a power of two of bits: some 16 a piece, at most 2 ** 29 (64 MB)
GROUP_BYTES = 4 << 20


def normalize(text: str | None) -> str:
    """Lower case with single blanks between words."""
    return " ".join((text or "").lower().split())


def budget(length: int, error_rate: float = ERROR_RATE) -> int:
    return int(length * error_rate)


def cut(item: str, parts: int) -> list[tuple[int, str]]:
    """Offsets and texts of ``parts`` pieces of nearly equal length."""
    edges = [len(item) * k // parts for k in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def item_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_match(length: int, masks: dict[str, int], text: str) -> tuple[int, int]:
    """Least edit distance of an item to any part of ``text``, and the end of the first part that has it."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, at = full, 0, length
    best, end = length, 0
    get = masks.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        x = eq | minus
        h = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(h | plus)
        down = plus & h
        if up & top:
            at += 1
        elif down & top:
            at -= 1
            if at < best:
                best, end = at, j
        up <<= 1
        plus = ((down << 1) | ~(x | up)) & full
        minus = up & x & full
    return best, end


class Matcher:
    """The items of one block, ready to search documents."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items, found = [], {}
        for item_id, text in items:
            number, k = len(self.items), _edits(len(text), error_rate)
            self.items.append((item_id, len(text), k, item_masks(text)))
            for offset, piece in cut(text, k + 1):
                found.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """``item_id``, distance, item length and end in the normalised text of each item within its budget."""
        if not self.items or not text:
            return []
        starts: dict[int, list[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for number, offset in places:
                starts.setdefault(number, []).append(end + 1 - size - offset)
        out = []
        for number, at in starts.items():
            item_id, length, k, masks = self.items[number]
            found = nearest(text, length, k, masks, at)
            if found:
                out.append((item_id, found[0], length, found[1]))
        return sorted(out)


def nearest(text: str, length: int, k: int, masks: dict[str, int], at: list[int]) -> tuple[int, int] | None:
    """Least distance of an item within its budget near the places where it would begin, and where that part ends."""
    if length < MIN_CHARS:
        at = [s for s in at if not (text[s - 1 : s].isalnum() or text[s + length : s + length + 1].isalnum())]
    best, where, windows = k + 1, 0, []
    for s in sorted(set(at)):  # windows that touch are searched as one
        low, high = max(0, s - k), min(len(text), s + length + k)
        if windows and low <= windows[-1][1]:
            windows[-1][1] = max(high, windows[-1][1])
        else:
            windows.append([low, high])
    for low, high in windows:
        distance, end = best_match(length, masks, text[low:high])
        if distance < best:
            best, where = distance, low + end
    return (best, where) if best <= k else None


def _edits(length: int, error_rate: float) -> int:
    return budget(length, error_rate) if length >= MIN_CHARS else 0


def _own(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).dropna()


def _few(own: DataFrame, block_chars: int) -> list[tuple[int, str]] | None:
    """The usable items, if they have few enough characters to travel."""
    if own.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"] > block_chars:
        return None
    return sorted({(r["i"], t) for r in own.collect() if (t := normalize(r["t"]))})


def _matcher(block: list[tuple[int, str]], error_rate: float):
    key = ("items", hashlib.md5(repr((block, error_rate)).encode()).hexdigest())
    return lambda: per_worker(key, lambda: Matcher(block, error_rate))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _piece_table(own: DataFrame, error_rate: float) -> DataFrame:
    """``h`` and ``size`` of each piece with its item: ``item_id``, the item's ``item`` text and the piece's ``offset``."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t := normalize(t):
                    rows += [(int(character_hashes(_codes(x), len(x)).view(np.int64)[0]), len(x), i, t, offset) for offset, x in cut(t, _edits(len(t), error_rate) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32()))], ["h", "size", "item_id", "item", "offset"])

    return own.distinct().mapInArrow(run, "h long, size int, item_id long, item string, offset int").distinct()


def _filter(found: DataFrame) -> np.ndarray:
    """A bit for the leading digits of each hash; its size is bounded, beyond it more runs pass by chance."""
    bits = min(FILTER_BITS, max(16, (found.count() * PIECE_BITS).bit_length()))
    place = F.shiftrightunsigned("h", 64 - bits)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")
    table = found.select(F.shiftright(place, 6).cast("int").alias("w"), bit.alias("x")).groupBy("w").agg(F.bit_or("x").alias("x")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[table.column("w").to_numpy()] = table.column("x").to_numpy().view(np.uint64)
    return out


def _joined(docs: DataFrame, own: DataFrame, error_rate: float) -> DataFrame:
    """``MATCHES`` and the key ``dk`` of the documents ``doc_id``, ``text``, ``dk``, for any number of items."""
    spark = docs.sparkSession
    index = materialize(_piece_table(own, error_rate), "pieces")
    sizes = sorted(r["size"] for r in index.select("size").distinct().collect())  # pieces of one rate have few lengths
    bits = spark.sparkContext.broadcast(_filter(index))

    def probe(batches):
        table = bits.value
        shift = np.uint64(64 - (len(table) * 64).bit_length() + 1)
        for whole in batches:
            for batch in pieces(whole, 1):
                parts = []
                for dk, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    codes = _codes(normalize(text))
                    for size in sizes:
                        h = character_hashes(codes, size)
                        place = h >> shift
                        at = np.flatnonzero((table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1))
                        if len(at):
                            parts.append((h[at].view(np.int64), np.full(len(at), dk), at.astype(np.int32)))
                cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "dk", "at"])

    hits = docs.select("dk", "text").mapInArrow(probe, "h long, dk long, at int")
    near = hits.join(index, "h").groupBy("dk", "item_id", "item").agg(F.collect_set(F.col("at") - F.col("offset")).alias("starts"))
    groups = max(shuffle_partitions(spark), -(-text_bytes(docs, "text") // GROUP_BYTES))
    gid = F.pmod("dk", F.lit(groups)).alias("gid")

    def verify(rows: pa.Table, found: pa.Table) -> pa.Table:
        wanted: dict[int, list] = {}
        for dk, i, item, starts in zip(*(found.column(c).to_pylist() for c in ("dk", "item_id", "item", "starts"))):
            wanted.setdefault(dk, []).append((i, item, starts))
        out, masks = [], {}
        for doc_id, dk, text in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "dk", "text"))):
            if dk in wanted:
                text = normalize(text)
                for i, item, starts in wanted[dk]:
                    if item not in masks:
                        masks[item] = item_masks(item)
                    n = len(item)
                    best = nearest(text, n, _edits(n, error_rate), masks[item], starts)
                    if best:
                        out.append((doc_id, i, best[0], n, text[max(0, best[1] - n) : best[1]], dk))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64())
        return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["doc_id", "item_id", "distance", "item_chars", "passage", "dk"])

    return docs.select(gid, "doc_id", "dk", "text").groupBy("gid").cogroup(near.select(gid, "*").groupBy("gid")).applyInArrow(verify, f"{MATCHES}, dk long")


MATCHES = "doc_id long, item_id long, distance int, item_chars int, passage string"


def contaminations(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document row and item that the document holds within the item's budget of edits.

    Both texts are compared in lower case with single blanks.  The budget is ``error_rate`` times the item's characters,
    rounded down.  Returns ``doc_id``, ``item_id``, ``distance`` (the least), ``item_chars`` and ``passage`` (the part
    of the normalised text that ends where the least distance is first reached, as long as the item).  Items
    shorter than 20 characters are found where they stand unchanged between word borders; null and blank ones are left out; an item that is repeated with one id counts once.  Null or empty
    texts hold nothing.  Repeated rows are reported each, a null ``doc_id`` as null; other columns are not read.  Items
    of more than ``block_chars`` characters are searched by a join of their pieces, with the same result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = _own(items, item_id_col, item_text_col)
    block = _few(own, block_chars)
    if block is None:
        return _joined(rows.withColumn("dk", F.xxhash64("doc_id", "text")), own, error_rate).drop("dk")
    matcher = _matcher(block, error_rate)

    def run(batches):
        find = matcher().find
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = normalize(text.as_py())
                rows += [(doc_id, i, d, n, text[max(0, e - n) : e]) for i, d, n, e in find(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["doc_id", "item_id", "distance", "item_chars", "passage"])

    return rows.mapInArrow(run, MATCHES)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; ids need not be unique, nor are they read."""
    own = _own(items, item_id_col, item_text_col)
    block = _few(own, block_chars)
    if block is None:
        rows = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).distinct().withColumn("dk", F.xxhash64("text"))
        held = _joined(rows, own, error_rate).select(F.col("dk").alias("_held")).distinct()
        return docs.join(held, F.xxhash64(docs[text_col].cast("string")) == held["_held"], "left_anti")
    matcher, where = _matcher(block, error_rate), docs.columns.index(text_col)

    def run(batches):
        find = matcher().find
        for batch in batches:
            clean = [not find(normalize(None if t is None else str(t))) for t in batch.column(where).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
