"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits.  If two fingerprints differ in at most
two bits, the errors fall so that in one of the cyclic segment pairs (0,1), (1,2), (2,0) the first segment is
equal and the second differs in at most one bit.  The second segment is decoded with the perfect binary Golay
code (23, 12): every 23-bit word lies within three bits of exactly one codeword.  The index side keeps the
codeword of the segment itself; the probe side has the codewords of the segment and of all words one bit away
(one key, or six for the words three bits from their codeword).  Equal keys are joined and verified.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import jaccard
from .common import materialize
from .graphs import connected_components

GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
LENGTH, PARITY = 23, 11
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # lowest bit, bits
PAIRS = ((0, 1), (1, 2), (2, 0))  # equal segment, fuzzy segment


def _remainder(word: int) -> int:
    for shift in range(LENGTH - 1, PARITY - 1, -1):
        if word >> shift & 1:
            word ^= GENERATOR << (shift - PARITY)
    return word


_PARITY = np.array([_remainder(info << PARITY) for info in range(1 << (LENGTH - PARITY))], dtype=np.int64)
_ERROR = np.zeros(1 << PARITY, dtype=np.int64)
for _weight in range(4):
    for _bits in combinations(range(LENGTH), _weight):
        _pattern = sum(1 << b for b in _bits)
        _ERROR[_remainder(_pattern)] = _pattern


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12 information bits of the codeword nearest to each 23-bit word."""
    syndrome = (words & ((1 << PARITY) - 1)) ^ _PARITY[words >> PARITY]
    return (words ^ _ERROR[syndrome]) >> PARITY


def fuzzy_indices(words: np.ndarray) -> np.ndarray:
    """Codeword indices of each word and of its 23 one-bit neighbours, one row each; repeats are -1."""
    flips = np.concatenate([[0], 1 << np.arange(LENGTH)]).astype(np.int64)
    found = np.sort(codeword_index(words[:, None] ^ flips[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Majority of the bits of XXH64 (seed 42) over word shingles, repeats included; 0 for no words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest, ones, step = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 1 << 14
    for at in range(0, count, step):
        spans = zip(starts[at : min(at + step, count)].tolist(), last[at : min(at + step, count)].tolist())
        h = np.array([digest(joined[a:b], 42) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` (64 bits as a signed long) of every row; a narrow map without a shuffle."""

    def run(batches):
        for batch in batches:
            values = batch.column(1).cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(v.as_py(), shingle) for v in values], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    bits = fps.view(np.uint64)
    return [((bits >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]


def _keys(classes: DataFrame, probe: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            parts = _segments(fps)
            keys, owner = [], []
            for number, (same, fuzzy) in enumerate(PAIRS):
                base = (number << 36) | (parts[same] << 12)
                if probe:
                    row, col = np.nonzero((found := fuzzy_indices(parts[fuzzy])) >= 0)
                    keys.append(base[row] | found[row, col])
                    owner.append(row)
                else:
                    keys.append(base | codeword_index(parts[fuzzy]))
                    owner.append(np.arange(len(fps)))
            own = np.concatenate(owner)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(fps[own]), batch.column(1).take(pa.array(own))], ["key", "fp", "rep"])

    return classes.select("fp", "rep").mapInArrow(run, "key long, fp long, rep long")


def link_pairs(classes: DataFrame, max_bits: int = 2) -> DataFrame:
    """All pairs of different fingerprints at ``max_bits`` (0..2) or fewer bits, once each, as their ``rep`` ids.

    ``classes`` has one row per distinct fingerprint, so copies never multiply; a fingerprint has at most 2080
    others within two bits, so the pairs are bounded by a constant times the rows.
    """
    index = _keys(classes, False).select("key", F.col("fp").alias("fp_i"), F.col("rep").alias("src"))
    probe = _keys(classes, True).select("key", F.col("fp").alias("fp_p"), F.col("rep").alias("dst"))
    close = F.bit_count(F.col("fp_i").bitwiseXOR(F.col("fp_p"))) <= max_bits
    return index.join(probe, (index["key"] == probe["key"]) & (F.col("fp_i") < F.col("fp_p")) & close).select("src", "dst").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per input row: ``doc_id``, ``fp``, ``class_id`` (smallest id with this fingerprint), ``component_id``.

    Documents link when their fingerprints differ in at most ``max_bits`` bits (0 to 2).  Null or blank texts have
    fingerprint zero and link like any other; texts under ``shingle`` words use the whole sequence.  Repeated rows
    come back repeated.  A null id keeps its row but never names a class or component (a class of null ids only has
    null in both).  Other input columns are not read; an empty input gives an empty result.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the segment pairs cover at most two differing bits")
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    labels = connected_components(link_pairs(classes.dropna(), max_bits))
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select(
        F.col("fp").alias("class_fp"), F.col("rep").alias("class_id"), F.coalesce("label", "rep").alias("component_id")
    )
    return fps.join(named, fps["fp"] == named["class_fp"], "left").select("doc_id", "fp", "class_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, similar: bool = False) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with all their columns; null ids stay.

    Rows are told apart by id and text.  So rows that share the smallest id stay together, copies of one another or
    not, and a row without an id stays beside its copies: without an id there is no saying which is the first.  With ``similar``, texts whose sets of five-word shingles have a Jaccard
    similarity of 0.8 or more link as well.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the segment pairs cover at most two differing bits")
    th = F.xxhash64(F.col(text_col).cast("string"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), th.alias("th"), F.col(text_col).cast("string").alias("text"))
    # a fingerprint belongs to a text, so the text's hash goes in the place of the id
    fps = materialize(fingerprints(texts, "th", "text", shingle).select(F.col("doc_id").alias("th"), "fp").distinct(), "fingerprints")
    classes = fps.select("fp", F.col("fp").alias("rep")).distinct()
    links, found = link_pairs(classes, max_bits), None
    if similar:
        found = materialize(jaccard.prefixes(texts), "prefixes")
        own = fps.join(found.filter("n > 0").select("th", "sid").distinct(), "th").select("fp", "sid").distinct()
        named = materialize(own.groupBy("sid").agg(F.min("fp").alias("name")), "named")
        same = own.join(named, "sid").filter("fp != name").select(F.col("fp").alias("src"), F.col("name").alias("dst"))
        near = jaccard.similar_links(found, texts)
        near = near.join(named.select(F.col("sid").alias("src"), F.col("name").alias("s")), "src").join(named.select(F.col("sid").alias("dst"), F.col("name").alias("d")), "dst")
        links = links.unionByName(same).unionByName(near.filter("s != d").select(F.col("s").alias("src"), F.col("d").alias("dst")))
    labels = connected_components(links)
    parts = fps.join(labels, fps["fp"] == labels["node"], "left").select("th", F.coalesce("label", "fp").alias("part"))
    rows = materialize(texts.select("id", "th").distinct().join(parts, "th"), "rows")
    least = rows.groupBy("part").agg(F.min("id").alias("least"))
    gone = rows.join(least, "part").filter(F.col("id") > F.col("least")).select(F.col("id").alias("_gone"), F.col("th").alias("_gone_text"))
    return docs.join(gone, (docs[id_col].cast("long") == gone["_gone"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["_gone_text"]), "left_anti")
