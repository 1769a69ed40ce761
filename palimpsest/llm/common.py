"""Helpers shared by the operators: shared-folder tables, byte-level tokens and array hashes."""

from __future__ import annotations

import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a maximal run of anything but blank and the ASCII controls HT..CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``, or in local mode a temporary one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing a Parquet table to the shared folder; it outlives the executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete a table made by ``materialize`` that no later plan reads."""
    path = getattr(df, "_shared_path", None)
    if path:
        spark = df.sparkSession
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of all texts: one narrow scan with a partial sum."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def longs(values: list[int]) -> Column:
    """A constant array as one literal, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def last_at_most(edges: list[int], value: Column) -> Column:
    """Place of the last of the rising ``edges`` at or below ``value`` (0 if there is none), by bisection."""
    steps, array = F.array(*(F.lit(1 << k) for k in reversed(range(len(edges).bit_length())))), longs(edges)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(array, at + step) <= value, at + step).otherwise(at))


def is_held_out(doc_id):
    """Column: the row's label is never learned from (crc32 of the id as text, modulo 4, is 2)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def binary_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column as one array, and the n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    wide = column.cast(pa.large_binary()).fill_null(b"")
    if not len(wide):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of every word, and for each text the index of its first word (n + 1 entries).

    ``separator`` says for each of the 256 byte values whether it parts words.
    """
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[raw]
    border = np.zeros(len(raw) + 1, dtype=bool)  # between two texts no word goes on
    border[offsets] = True
    before = np.concatenate([[True], ~inside[:-1]]) | border[:-1]
    after = np.concatenate([~inside[1:], [True]]) | border[1:]
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        full = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        full[0] = 1
        known = np.multiply.accumulate(full)
        if len(known) <= 1 << 23:
            _powers[base] = known
    return known[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective avalanche of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 22) -> np.ndarray:
    """A 64-bit hash of every word from prefix sums of a byte polynomial, many words at once.

    Works through the bytes in pieces of about ``piece``, so memory does not follow the length of a text.
    """
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + piece, side="right")))
        s, e = starts[at:to] - low, ends[at:to] - low
        weighted = _BYTE_CODE[raw[low : ends[to - 1]]]
        weighted *= _power_table(_BASE, len(weighted))
        prefix = np.zeros(len(weighted) + 1, dtype=np.uint64)
        np.cumsum(weighted, out=prefix[1:])
        value = (prefix[e] - prefix[s]) * _power_table(_BASE_INVERSE, len(weighted))[s]
        out[at:to] = mix64(value + (e - s).astype(np.uint64))
        at = to
    return out


def gram_hashes(words: np.ndarray, n: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """A 64-bit hash of every run of n consecutive words (len - n + 1 of them)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    value = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        value *= np.uint64(base)
        value += words[k : k + count]
    return mix64(value)


def character_hashes(codes: np.ndarray, n: int, piece: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of every run of n characters, in pieces of a bounded length."""
    out = []
    for at in range(0, max(0, len(codes) - n + 1), piece):
        part = mix64(codes[at : at + piece + n - 1].astype(np.uint64) + np.uint64(1))
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _power_table(_BASE, len(part)), out=prefix[1:])
        count = len(part) - n + 1
        out.append(mix64((prefix[n:] - prefix[:-n]) * _power_table(_BASE_INVERSE, len(part))[:count] + np.uint64(n)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def runs(total: int, lengths: np.ndarray) -> np.ndarray:
    """0..lengths[i]-1 for each i, concatenated."""
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def pieces(batch: pa.RecordBatch, column: int, size: int = 4 << 20):
    """Consecutive slices of a batch whose texts have about ``size`` bytes each (a longer text is alone)."""
    offsets = binary_parts(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def per_worker(key, build):
    """A value built once in each Python worker, whatever the number of tasks it serves."""
    kept = sys.modules["builtins"].__dict__.setdefault("_palimpsest_kept", {})
    if key not in kept:
        if len(kept) >= 8:
            kept.clear()
        kept[key] = build()
    return kept[key]


def train_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text`` and ``y`` of at most ``rows`` labelled documents outside the held-out part, the same at every run.

    The ids are chosen by a hash, so the choice does not follow the order of the table; their number is the bound that
    makes the join a broadcast.  An id that is repeated brings one text (the least by hash) and one label (the greatest).
    """
    own = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("int").alias("y")).dropna().groupBy("_id").agg(F.max("y").alias("y"))
    chosen = own.filter(~is_held_out(F.col("_id"))).orderBy(F.xxhash64("_id", F.lit(7)), "_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("_own"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), texts["_own"] == chosen["_id"])
    return found.groupBy("_own").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"), F.max("y").alias("y")).select("t.text", "y")
