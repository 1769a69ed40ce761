"""Near copies by the Jaccard similarity of five-word shingles, without loss.

Two sets with a similarity of 0.8 or more share an element among the first ``n - ceil(0.8 n) + 1`` of each, in any order
that holds for all sets (prefix filter).  The shared elements of two prefixes, with what follows the prefix, bound the overlap of the sets, so most
chance pairs go before whole sets are compared.  The order here puts shingles that are common in a sample last; it decides the
cost only, never the result.  Before whole sets are compared, parity sketches are: two sets with a similarity of 0.8 or more
differ in at most a ninth of their sizes' sum, and each bit in which their sketches differ stands for an element that
one of them lacks.  In a bucket of many sets a few pivots are compared with all; only where these leave it in several
components are the sets outside the largest compared with all, by their sketches first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import binary_parts, gram_hashes, materialize, mix64, pieces, release, word_hashes, word_spans
from .graphs import connected_components

WORDS = 5
SAMPLE_ROWS, SAMPLE_COMMON, COMMON_MOST = 20_000, 4, 200_000
BUCKET, PIVOTS = 32, 8
REST = 1024  # sets that one task compares with a whole bucket


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted hashes of each text's shingles, case and spacing ignored; a shorter text is one shingle, none has none."""
    raw, offsets = binary_parts(pc.utf8_lower(texts.cast(pa.large_string())))
    starts, ends, first = word_spans(raw, offsets)
    hashes = word_hashes(raw, starts, ends)
    return [np.unique(gram_hashes(hashes[a:b], min(words, b - a))) if b > a else np.zeros(0, np.uint64) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def set_id(shingles: np.ndarray) -> int:
    """A hash of a set; equal sets have equal ids."""
    return int(np.array(mix64(np.array([mix64(shingles ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + np.uint64(len(shingles))])), np.uint64).view(np.int64)[0])


def prefix(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    if len(common):
        hot = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
        shingles = np.concatenate([shingles[~hot], shingles[hot]])
    n = len(shingles)
    return shingles[: n - (4 * n + 4) // 5 + 1] if n else shingles


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the counts in a power of two of bins, four or more for a shingle; halves fold onto each other by XOR."""
    bins = max(512, 1 << (4 * len(shingles) - 1).bit_length()) if len(shingles) else 512
    odd = np.bincount((shingles & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def low(parities: np.ndarray) -> np.ndarray:
    """A sketch folded to its least size, eight words."""
    return np.bitwise_xor.reduce(parities.reshape(-1, 8), axis=0)


def _low_alike(a: str, b: str, n: str, m: str):
    """The same of folded sketches: coarser, without lambdas."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, 8)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0]))) * 9 <= F.col(n) + F.col(m)


def _alike(a: str, b: str, n: str, m: str):
    """Whether the sketches ``a`` and ``b`` of sets of ``n`` and ``m`` allow a similarity of 0.8; sizes differ by a fifth at most, so sketches by one fold."""
    a, b = F.col(a), F.col(b)
    fold = lambda x, y: F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda p, q: p.bitwiseXOR(q))).otherwise(x)
    apart = F.aggregate(F.zip_with(fold(a, b), fold(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, x: total + x)
    return apart * 9 <= F.col(n) + F.col(m)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array((np.concatenate(parts) if parts else np.zeros(0, np.uint64)).view(np.int64)))


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Shingles that several texts of a sample of bounded size share, in order.  ``texts`` has ``th`` and ``text``."""
    step = max(1, -(-texts.count() // SAMPLE_ROWS))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 0):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *shingle_sets(part.column(0))]).view(np.int64))], ["key"])

    some = texts.filter(F.pmod(F.xxhash64("th"), F.lit(step)) == 0).select("text").mapInArrow(run, "key long")
    found = some.groupBy("key").count().filter(F.col("count") >= SAMPLE_COMMON).orderBy(F.desc("count"), "key").limit(COMMON_MOST).select("key").collect()
    return np.sort(np.array([r["key"] for r in found], np.int64).view(np.uint64))


def prefixes(texts: DataFrame) -> DataFrame:
    """``id``, ``th``, ``sid`` (null without words), ``n``, ``prefix``, ``sketch`` and ``low`` of every row."""
    common = common_shingles(texts)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 2):
                sets = shingle_sets(part.column(2))
                sketches = [sketch(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), _lists([prefix(s, common) for s in sets]), _lists(sketches), _lists([low(s) for s in sketches])], ["id", "th", "sid", "n", "prefix", "sketch", "low"])

    return texts.select("id", "th", "text").mapInArrow(run, "id long, th long, sid long, n int, prefix array<long>, sketch array<long>, low array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in pieces(batch, 0):
                sets = shingle_sets(part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), _lists(sets)], ["sid", "items"])

    return texts.select("text").mapInArrow(run, "sid long, items array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` of sets with a similarity of 0.8 or more, as ``src``, ``dst``."""

    def run(batches):
        for batch in batches:
            keep, (left, right) = [], ((c.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(pc.list_value_length(c).to_numpy())])) for c in (batch.column(2), batch.column(3)))
            for i in range(batch.num_rows):
                x, y = left[0][left[1][i] : left[1][i + 1]], right[0][right[1][i] : right[1][i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(5 * both >= 4 * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("sid").alias("a"), F.col("items").alias("x")), "a")
    two = one.join(sets.select(F.col("sid").alias("b"), F.col("items").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(run, "src long, dst long")


def _near(n: str, m: str):
    return (F.col(n) * 5 >= F.col(m) * 4) & (F.col(m) * 5 >= F.col(n) * 4)


def similar_links(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``src``, ``dst`` of set ids: every pair with a similarity of 0.8 or more is in one component of them.

    ``found`` comes from ``prefixes`` (a table); ``texts`` has ``id``, ``th`` and ``text``.
    """
    real = found.filter("n > 0")
    one = real.groupBy("sid").agg(F.min(F.struct("th", "id")).alias("row"))

    def verified(pairs: DataFrame) -> DataFrame:
        needed = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
        wanted = one.join(needed, "sid", "left_semi").select(F.col("row.th").alias("_th"), F.col("row.id").alias("_id"))
        sets = materialize(_sets(texts.join(wanted, (F.col("th") == F.col("_th")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")), "sets")
        return _verified(pairs, sets)

    key, sketches = W.partitionBy("key"), real.groupBy("sid").agg(F.first("sketch").alias("sketch"), F.first("low").alias("low"), F.first("n").alias("size"))

    def alike(pairs: DataFrame) -> DataFrame:
        """The pairs ``a``, ``b`` whose sketches allow a link."""
        one = pairs.join(sketches.select(F.col("sid").alias("a"), F.col("sketch").alias("x"), F.col("size").alias("n")), "a")
        two = one.join(sketches.select(F.col("sid").alias("b"), F.col("sketch").alias("y"), F.col("size").alias("m")), "b")
        return two.filter(_alike("x", "y", "n", "m")).select("a", "b")

    own = real.select("sid", "n", "prefix").dropDuplicates(["sid"]).select("sid", "n", F.size("prefix").alias("p"), F.posexplode("prefix").alias("pos", "key"))
    posts = own.withColumn("size", F.count(F.lit(1)).over(key)).filter("size > 1")
    posts = materialize(posts.withColumn("rank", F.when(F.col("size") > BUCKET, F.row_number().over(key.orderBy(F.xxhash64("sid"), "sid")))), "posts")
    left = posts.select("key", F.col("sid").alias("a"), "n", "p", "pos", "rank")
    right = posts.select("key", F.col("sid").alias("b"), F.col("n").alias("m"), F.col("p").alias("q"), F.col("pos").alias("pos_b"))
    # in small buckets all pairs; in large ones those of the pivots
    raw = left.filter(f"rank is null or rank <= {PIVOTS}").join(right, "key").filter(_near("n", "m") & ((F.col("a") < F.col("b")) | (F.col("rank").isNotNull() & (F.col("a") != F.col("b")))))
    big = posts.filter("rank is not null").groupBy("sid").agg(F.count(F.lit(1)).alias("big"))
    counts = raw.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.max(F.col("n") + F.col("m")).alias("both"), F.max(F.greatest(F.col("n") - F.col("p"), F.col("m") - F.col("q"))).alias("tail"))
    # keys of large buckets may be shared without being counted
    counts = counts.join(big.select(F.col("sid").alias("a"), F.col("big").alias("big")), "a", "left")
    pairs = materialize(alike(counts.filter((F.col("c") + F.coalesce("big", F.lit(0)) + F.col("tail")) * 9 >= F.col("both") * 4).select("a", "b")), "pairs")
    links = materialize(verified(pairs), "similar")
    labels = connected_components(links)
    # what the pivots left apart
    large = posts.filter("rank is not null").select("key", "sid", "n", "pos")
    parts = large.join(labels, large["sid"] == labels["node"], "left").select("key", "sid", "n", "pos", F.coalesce("label", "sid").alias("part"))
    sizes = parts.groupBy("key", "part").count()
    major = sizes.groupBy("key").agg(F.max_by("part", F.struct("count", "part")).alias("major"), F.count(F.lit(1)).alias("parts"), (F.sum("count") - F.max("count")).alias("others")).filter("parts > 1")
    mixed = parts.join(major.select("key", "major", F.ceil(F.col("others") / REST).cast("int").alias("shares")), "key")
    of_set = mixed.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("pos", "key")))["key"].alias("keys")).join(sketches.drop("size"), "sid")  # at most a prefix of keys
    mixed = materialize(mixed.join(of_set, "sid"), "mixed")
    # a bucket with many sets outside its largest component is shared out, so no task compares more than REST with all
    rest = mixed.filter("part != major").select("key", F.pmod(F.xxhash64("sid"), F.col("shares")).cast("int").alias("share"), F.col("sid").alias("a"), "n", "pos", F.col("part").alias("s"), F.col("sketch").alias("x"), F.col("low").alias("low_x"), F.col("keys").alias("keys_a"))
    every = mixed.select("key", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("sid").alias("b"), F.col("n").alias("m"), F.col("pos").alias("pos_b"), F.col("part").alias("t"), F.col("sketch").alias("y"), F.col("low").alias("low_y"), F.col("keys").alias("keys_b"))
    # of all buckets that two sets share the first compares them; if they are similar enough of both is behind their first shared element
    enough = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("pos_b")) * 9 >= (F.col("n") + F.col("m")) * 4
    first = F.col("key") == F.get(F.array_intersect("keys_a", "keys_b"), F.lit(0))
    more = rest.join(every, ["key", "share"]).filter((F.col("s") != F.col("t")) & _near("n", "m") & enough & _low_alike("low_x", "low_y", "n", "m") & _alike("x", "y", "n", "m") & first)
    more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = materialize(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
    out = materialize(links.unionByName(verified(more)), "similar")
    for df in (posts, pairs, more, links, labels, mixed):
        release(df)
    return out
