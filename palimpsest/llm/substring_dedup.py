"""Substring dedup by fixed-block anchors.

A repeat of ``window`` words holds a whole block of ``(window + 1) // 2`` words that begins at a multiple of the
block's length in the document it is copied from.  Those non-overlapping blocks are the index; every rolling run of
the same length is a probe.  Where a probe hits a block of another document, both sides are extended by the words
around the block to all windows that contain it.  Each window is led to the smallest document that has it and to its place there;
windows that run on side by side in both documents fuse to maximal exact repeats, each with its source and the place in it.

Windows are compared by 96 bits made of 64-bit hashes of their words: two words would have to collide, or two windows in
both parts, for a wrong match.

Data flow.  Documents are dealt by a hash of their id and text into groups.  A group sends each distinct probe once,
whatever the number of its documents that hold it, as four bytes in wide buckets; a bucket answers with one bit a probe.
Windows go the same way and come back with the source where there is an earlier one.  So a passage that a third of all
documents share costs one entry a group, no task gathers its documents, and no pair of documents is ever formed.
Groups and buckets both grow with the square root of the text, so a row between them keeps some ``ENTRIES`` entries
at any size and the shuffle stays in proportion to the text.
"""

from __future__ import annotations

import hashlib
from itertools import compress
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import binary_parts, gram_hashes, shuffle_partitions, text_bytes, word_hashes, word_spans

_SECOND = 0xDA942042E4DD58B5  # base of the second hash of a window
_REPLY, _NOTE = 0, 1

ENTRIES, ENTRY_BYTES = 64, 6  # wanted in a row between a group and a bucket; bytes of text for an entry
LEAST_BUCKET = 1 << 19  # bytes of text that a bucket stands for, at least

SPANS = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:int,stop:int>>, repeats array<struct<start:int,stop:int,source_id:bigint,source_start:int>>, kept_text string"


class _Texts:
    """The words of one text group in order of id and text, so that places are the same in every stage; rows without an
    id take no part in matching."""

    def __init__(self, rows: pa.Table):
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
        self.id_column = rows.column("doc_id").combine_chunks()
        self.live = self.id_column.is_valid().to_numpy(zero_copy_only=False)
        self.ids = self.id_column.fill_null(0).to_numpy(zero_copy_only=False)
        self.raw, self.offsets = binary_parts(rows.column("text"))
        self.starts, self.ends, self.first = word_spans(self.raw, self.offsets)
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.ids)), self.n_words)
        self.words = word_hashes(self.raw, self.starts, self.ends)

    def begins(self, n: int) -> np.ndarray:
        """Whether n words of one document with an id begin at each word."""
        room = np.repeat(self.first[1:], self.n_words) - np.arange(len(self.doc))
        return (room >= n) & self.live[self.doc]


class _Probes:
    """Distinct rolling blocks of a group in hash order, with two flags: begins a block here; is in several documents."""

    def __init__(self, texts: _Texts, block: int):
        at = np.flatnonzero(texts.begins(block))
        value = gram_hashes(texts.words, block)[at] if len(at) else np.zeros(0, np.uint64)
        order = np.argsort(value, kind="stable")
        self.at, value = at[order], value[order]
        new = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.zeros(0, bool)
        self.first = np.flatnonzero(new)
        self.number = np.cumsum(new) - 1
        self.value = value[self.first]
        if len(value):
            doc = texts.doc[self.at]
            last = np.append(self.first[1:], len(doc)) - 1
            several = doc[last] != doc[self.first]
            anchor = np.logical_or.reduceat((self.at - texts.first[doc]) % block == 0, self.first)
            self.flags = anchor.astype(np.uint64) | (several.astype(np.uint64) << np.uint64(1))
        else:
            self.flags = np.zeros(0, np.uint64)


def _bucket_edges(value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets present in sorted hashes and where each begins (with the end)."""
    bucket = (value >> np.uint64(64 - bits)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    return bucket[new], np.append(new, len(bucket))


def _rows(bucket, gid, kind, payload) -> pa.Table:
    return pa.table({"bucket": pa.array(bucket, pa.int64()), "gid": pa.array(gid, pa.int64()), "kind": pa.array(kind, pa.int32()), "payload": pa.array(payload, pa.binary())})


_ROWS = "bucket long, gid long, kind int, payload binary"


def _send_probes(block: int, bits: int):
    def run(key, rows):
        gid, probes = key[0].as_py(), _Probes(_Texts(rows), block)
        short = ((probes.value >> np.uint64(34 - bits)) << np.uint64(2)) & np.uint64((1 << 32) - 1) | probes.flags  # the 30 bits after the bucket's
        buckets, edges = _bucket_edges(probes.value, bits)
        data = short.astype("<u4").tobytes()
        payload = [data[4 * a : 4 * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        return _rows(buckets, np.full(len(buckets), gid), np.full(len(buckets), _REPLY), payload)

    return run


def _answer_probes(key, rows):
    raw, offsets = binary_parts(rows.column("payload"))
    value = np.frombuffer(raw.tobytes(), "<u4")
    order = np.argsort(value, kind="stable")
    ranked = value[order]
    first = np.flatnonzero(np.concatenate([[True], (ranked[1:] >> np.uint32(2)) != (ranked[:-1] >> np.uint32(2))]))
    count = np.diff(np.append(first, len(ranked)))
    flags = np.bitwise_or.reduceat(ranked & np.uint32(3), first)
    hit = ((count > 1) | (flags >= 2)) & (flags & np.uint32(1) == 1)
    active = np.zeros(len(value), bool)
    active[order] = np.repeat(hit, count)
    return _bits(key[0].as_py(), rows.column("gid").to_numpy(), active, offsets // 4)


def _bits(bucket: int, gids: np.ndarray, flags: np.ndarray, edges: np.ndarray, *values: np.ndarray) -> pa.Table:
    """One row for each sender with any flag set: a bit an entry, and the ``values`` of the entries that are set."""
    sent = [(g, b"".join([np.packbits(flags[a:b]).tobytes(), *(_pack(v[a:b][flags[a:b]]) for v in values)])) for g, a, b in zip(gids.tolist(), edges[:-1].tolist(), edges[1:].tolist()) if flags[a:b].any()]
    return _rows([bucket] * len(sent), [g for g, _ in sent], [_REPLY] * len(sent), [b for _, b in sent])


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers above their least in as many bytes each as the greatest needs."""
    low = int(values.min()) if len(values) else 0
    above = values.astype(np.int64).view(np.uint64) - np.uint64(low % (1 << 64))
    top = int(above.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + np.int64(low).tobytes() + above.astype(f"<u{width}").tobytes()


def _unpack(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    width, low = data[at], np.frombuffer(data, "<i8", 1, at + 1)[0]
    above = np.frombuffer(data, f"<u{width}", n, at + 9).astype(np.uint64)
    return (above + low.view(np.uint64)).view(np.int64), at + 9 + width * n


def _read_bits(rows: pa.Table, buckets: np.ndarray, edges: np.ndarray, n: int, *values: np.ndarray) -> np.ndarray:
    """The flags of ``n`` entries; ``values`` are filled where a flag is set."""
    flags = np.zeros(n, bool)
    where = np.searchsorted(buckets, rows.column("bucket").to_numpy())
    for i, payload in zip(where.tolist(), rows.column("payload").to_pylist()):
        a, b = edges[i], edges[i + 1]
        own = np.unpackbits(np.frombuffer(payload, np.uint8, (b - a + 7) // 8), count=b - a).astype(bool)
        flags[a:b] = own
        at, m = (b - a + 7) // 8, int(own.sum())
        for v in values:
            v[a:b][own], at = _unpack(payload, at, m)
    return flags


class _Windows:
    """Distinct candidate windows of a group, in bucket order and within a bucket by their first document."""

    def __init__(self, texts: _Texts, at: np.ndarray, window: int, bits: int):
        key, check = (gram_hashes(texts.words, window, b)[at] if len(at) else np.zeros(0, np.uint64) for b in (0xD1342543DE82EF95, _SECOND))
        check = (check >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(key, kind="stable")
        key, check = key[order], check[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])]) if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        lead = at[order][first]  # the first place of each, in its smallest document
        ranked = np.lexsort((lead, key[first] >> np.uint64(64 - bits)))
        place = np.empty(len(first), np.int64)
        place[ranked] = np.arange(len(first))
        self.number = np.empty(len(at), np.int64)  # of the window at each candidate place
        self.number[order] = place[np.cumsum(new) - 1] if len(key) else 0
        self.key, self.check, self.doc = key[first][ranked], check[first][ranked], texts.doc[lead][ranked]
        self.place = lead[ranked] - texts.first[self.doc]  # in that document


def _send_windows(window: int, block: int, bits: int):
    def run(key, rows, replies):
        if not rows.num_rows or not replies.num_rows:
            return _rows([], [], [], [])
        gid, texts = key[0].as_py(), _Texts(rows)
        probes = _Probes(texts, block)
        buckets, edges = _bucket_edges(probes.value, bits)
        hit = np.zeros(len(texts.doc), bool)
        hit[probes.at] = _read_bits(replies, buckets, edges, len(probes.value))[probes.number]
        near = np.concatenate([[0], np.cumsum(hit)])  # a window is a candidate if a hit block lies in it
        start = np.flatnonzero(texts.begins(window))
        at = start[near[start + window - block + 1] > near[start]]
        found = _Windows(texts, at, window, bits)
        out = ([], [])
        buckets, edges = _bucket_edges(found.key, bits)
        ids = texts.ids[found.doc]
        for bucket, a, b in zip(buckets.tolist(), edges[:-1].tolist(), edges[1:].tolist()):
            out[0].append(bucket)
            out[1].append(b"".join([np.int64(b - a).tobytes(), found.key[a:b].tobytes(), found.check[a:b].tobytes(), _pack(ids[a:b]), _pack(found.place[a:b])]))
        note = np.zeros(len(texts.doc), bool)
        note[at] = True
        sent = _rows(out[0], [gid] * len(out[0]), [_REPLY] * len(out[0]), out[1])
        return pa.concat_tables([sent, _rows([gid % (1 << bits)], [gid], [_NOTE], [np.packbits(note).tobytes()])])

    return run


def _answer_windows(key, rows):
    notes = rows.filter(pc.equal(rows.column("kind"), _NOTE))
    rows = rows.filter(pc.equal(rows.column("kind"), _REPLY))
    if not rows.num_rows:
        return notes
    keys, checks, ids, places, edges = [], [], [], [], [0]
    for data in rows.column("payload").to_pylist():
        n = int(np.frombuffer(data, "<i8", 1)[0])
        keys.append(np.frombuffer(data, "<u8", n, 8))
        checks.append(np.frombuffer(data, "<u4", n, 8 + 8 * n))
        own, at = _unpack(data, 8 + 12 * n, n)
        ids.append(own)
        places.append(_unpack(data, at, n)[0])
        edges.append(edges[-1] + n)
    value, check, doc, place = map(np.concatenate, (keys, checks, ids, places))
    order = np.lexsort((check, value))
    v, c = value[order], check[order]
    first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (c[1:] != c[:-1])]))
    count = np.diff(np.append(first, len(v)))
    run = np.repeat(np.arange(len(first)), count)
    shared = np.repeat(count > 1, count)
    order, run = order[shared], run[shared]  # windows of one group only have no source elsewhere
    ranked = np.lexsort((place[order], doc[order], run))
    order, run = order[ranked], run[ranked]
    begin = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
    best = np.repeat(order[begin], np.diff(np.append(begin, len(run))))  # the smallest document, and its first place
    later, source, source_place = np.zeros(len(doc), bool), np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
    later[order], source[order], source_place[order] = doc[order] > doc[best], doc[best], place[best]
    return pa.concat_tables([notes, _bits(key[0].as_py(), rows.column("gid").to_numpy(), later, np.array(edges), source, source_place)])


def _remove(window: int, bits: int, with_text: bool):
    def run(rows, replies):
        texts = _Texts(rows)
        n = len(texts.doc)
        covered = np.zeros(n + 1, np.int32)
        note = replies.filter(pc.equal(replies.column("kind"), _NOTE))
        at = source = source_place = np.zeros(0, np.int64)
        if note.num_rows:
            at = np.flatnonzero(np.unpackbits(np.frombuffer(note.column("payload")[0].as_py(), np.uint8), count=n))
            found = _Windows(texts, at, window, bits)
            buckets, edges = _bucket_edges(found.key, bits)
            # the first document of this group that has the window, unless a smaller one elsewhere has it
            source, source_place = texts.ids[found.doc], found.place.copy()
            _read_bits(replies.filter(pc.equal(replies.column("kind"), _REPLY)), buckets, edges, len(found.key), source, source_place)
            source, source_place = source[found.number], source_place[found.number]
            gone = texts.ids[texts.doc[at]] > source
            at, source, source_place = at[gone], source[gone], source_place[gone]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + window, -1)
        removed = np.cumsum(covered[:-1]) > 0
        # windows that run on in both documents are one repeat
        doc = texts.doc[at]
        on = (at[1:] == at[:-1] + 1) & (doc[1:] == doc[:-1]) & (source[1:] == source[:-1]) & (source_place[1:] == source_place[:-1] + 1)
        begin = np.flatnonzero(np.concatenate([[True], ~on])) if len(at) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(at))[: len(begin)] - 1
        start, stop = at[begin] - texts.first[doc[begin]], at[end] - texts.first[doc[begin]] + window
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32())
        fields = [pa.array(v, k) for v, k in zip((start, stop, source[begin], source_place[begin]), kinds)]
        repeats = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[begin], np.arange(len(texts.ids) + 1)).astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "stop", "source_id", "source_start"]))
        shas, kept_texts, span_edges, spans_a, spans_b, n_removed = [], [], [0], [], [], []
        data, off, first = texts.raw.tobytes(), texts.offsets.tolist(), texts.first.tolist()
        for i in range(len(texts.ids)):
            words, out = data[off[i] : off[i + 1]].split(), removed[first[i] : first[i + 1]]
            if n := int(out.sum()):
                words = list(compress(words, (~out).tolist()))
                turn = np.flatnonzero(np.diff(out.astype(np.int8), prepend=0, append=0))
                spans_a.append(turn[::2])
                spans_b.append(turn[1::2])
            span_edges.append(span_edges[-1] + (len(spans_a[-1]) if n else 0))
            kept = b" ".join(words)
            shas.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept.decode("utf-8", "replace") if with_text else None)
            n_removed.append(n)
        ends = [pa.array(np.concatenate(x).astype(np.int32) if x else [], pa.int32()) for x in (spans_a, spans_b)]
        removed_spans = pa.ListArray.from_arrays(pa.array(span_edges, pa.int32()), pa.StructArray.from_arrays(ends, ["start", "stop"]))
        return pa.table([texts.id_column, pa.array(texts.n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas), removed_spans, repeats, pa.array(kept_texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "repeats", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, with_text: bool = True, group_bytes: int = 4 << 20) -> DataFrame:
    """Remove every word covered by a run of ``window`` words that also begins in a document with a smaller id.

    Returns one row per input row: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` (kept words joined by one
    blank), ``removed`` (spans of removed word positions, stop excluded), ``repeats`` (the maximal exact repeats that make them up: a
    span, the smallest document that has each of its windows, and where the span begins there; they may overlap) and ``kept_text``
    (null unless ``with_text``).  Windows are judged on the input.  Null and empty texts have no words.  Rows with a
    null id are returned untouched and take no part in matching; rows that repeat an id do not remove each other,
    whether their texts are equal or not, and come out the same in any order of arrival.  Other columns are not read.
    ``group_bytes`` is the text handled by one call at a time, at least; it grows with the square root of the whole (191 MB at
    100 TB).  A longer document is one call of its own size, and so are rows that are equal in id and text.
    """
    if window < 1:
        raise ValueError("window must be positive")
    block = (window + 1) // 2
    total, wide = text_bytes(docs, text_col), shuffle_partitions(docs.sparkSession)
    even = isqrt(ENTRIES * ENTRY_BYTES * total)
    groups = max(wide, -(-total // max(group_bytes, even)))
    bits = min(max(2 * wide, total // max(LEAST_BUCKET, even), 64).bit_length(), 30)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = own.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("gid"), "doc_id", "text")
    probes = texts.groupBy("gid").applyInArrow(_send_probes(block, bits), _ROWS)
    hits = probes.groupBy("bucket").applyInArrow(_answer_probes, _ROWS)
    windows = texts.groupBy("gid").cogroup(hits.groupBy("gid")).applyInArrow(_send_windows(window, block, bits), _ROWS)
    replies = windows.groupBy("bucket").applyInArrow(_answer_windows, _ROWS)
    return texts.groupBy("gid").cogroup(replies.groupBy("gid")).applyInArrow(_remove(window, bits, with_text), SPANS)
