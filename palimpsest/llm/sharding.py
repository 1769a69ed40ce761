"""Sharding with size-tiered compaction, in DataFrame functions only.

A shard store is a folder of immutable Parquet shards and numbered manifests.  ``append`` writes arrivals as small
shards, one for every ``arrival_rows`` rows in order of id.  ``compact`` merges neighbouring shards of one size tier (a
power of four of bytes) into files of about the target size and leaves full and lone shards alone.  Every write goes
to a folder of its own with a fresh name; a manifest names the shards that count and where they lie, and is published by
renaming a finished folder to the next number, which fails if another writer took it.  So readers see the old version
or the new, never a part, and what a lost writer left behind is in nobody's way until ``vacuum`` removes it.

Tasks follow the bytes.  Rows are dealt by ranges of ids of about ``GROUP_BYTES``; a range that one id (or the null id) fills is
split by a hash of the text.  Planning works on shard sizes alone, in neighbourhoods of ``SPAN`` shard numbers;
documents move once however many rounds the plan has, from the files that the manifest names and no others.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import last_at_most, longs, materialize, release, shared_dir, shuffle_partitions

ARRIVAL_ROWS, TARGET_BYTES, ROUNDS, SPAN = 1000, 32 << 20, 4, 4096
GROUP_BYTES, MOST_GROUPS = 64 << 20, 1 << 20  # text of a writing task; the edges between tasks are an array of eight bytes each
BATCH = 1 << 16  # shards whose places are broadcast together; more are handled in further batches

_MANIFEST = "shard_id long, version int, tier int, n_docs long, n_bytes long, write_id string"
RESERVED = ("shard_id", "version", "tier", "shard_docs", "shard_bytes", "write_id", "row_bytes")


def tier(n_bytes: Column) -> Column:
    return ((F.length(F.bin(F.greatest(n_bytes, F.lit(1)))) - 1) / 2).cast("int")


def compaction_plan(shards: DataFrame, target_bytes: int = TARGET_BYTES, rounds: int = ROUNDS) -> DataFrame:
    """``shard_id``, ``into`` and the merged ``n_docs``, ``n_bytes`` for shards with these columns.

    A round takes the shards under the target, groups them by tier and neighbourhood, and in id order cuts each group
    where its running size passes a multiple of the target; a part becomes one shard, named by its smallest id.  Each
    round is written to the shared folder: a row for each shard, read by the next round and by every use of the plan.
    """
    plan = shards.select("shard_id", "n_docs", "n_bytes", F.col("shard_id").alias("into"))
    for _ in range(rounds):
        now = plan.groupBy("into").agg(F.sum("n_bytes").alias("size"))
        open_ = F.when(F.col("size") < target_bytes, tier(F.col("size"))).otherwise(F.lit(-1))
        now = now.select("into", "size", open_.alias("t"), F.floor(F.col("into") / SPAN).alias("near"))
        run = W.partitionBy("t", "near").orderBy("into").rowsBetween(W.unboundedPreceding, -1)
        part = F.when(F.col("t") < 0, F.col("into")).otherwise(F.floor(F.coalesce(F.sum("size").over(run), F.lit(0)) / target_bytes))
        now = now.withColumn("part", part)
        now = now.select("into", F.min("into").over(W.partitionBy("t", "near", "part")).alias("next"))
        plan = materialize(plan.join(now, "into").select("shard_id", "n_docs", "n_bytes", F.col("next").alias("into")), "compaction")
    whole = W.partitionBy("into")
    return plan.select("shard_id", "into", F.sum("n_docs").over(whole).alias("n_docs"), F.sum("n_bytes").over(whole).alias("n_bytes"))


class ShardStore:
    """Shards below ``root/data/write_id=w/shard_id=s`` and manifests in ``root/manifest/v``."""

    def __init__(self, spark: SparkSession, root: str, id_col: str = "doc_id", text_col: str = "text"):
        self.spark, self.root, self.id_col, self.text_col = spark, root.rstrip("/"), id_col, text_col
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))] if self._fs.exists(self._path(folder)) else []

    def version(self) -> int:
        """The newest committed version; 0 for a new store."""
        return max((int(n) for n in self._names("manifest") if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        at = self.version() if version is None else version
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/{at}") if at else self.spark.createDataFrame([], _MANIFEST)

    def commit(self, shards: DataFrame, base: int) -> int:
        """Publish ``shards`` as version ``base + 1``; raises if that version exists by now."""
        draft = f"draft-{uuid.uuid4().hex}"
        shards.select("shard_id", "version", "tier", "n_docs", "n_bytes", "write_id").write.parquet(f"{self.root}/{draft}")
        self._fs.mkdirs(self._path("manifest"))
        goal = self._path(f"manifest/{base + 1}")
        if self._fs.exists(goal) or not self._fs.rename(self._path(draft), goal) or self._fs.exists(self._path(f"manifest/{base + 1}/{draft}")):
            self._fs.delete(self._path(draft), True)
            self._fs.delete(self._path(f"manifest/{base + 1}/{draft}"), True)
            raise RuntimeError(f"version {base + 1} was committed by another writer")
        return base + 1

    def _commit_own(self, shards: DataFrame, base: int, writes: list[str]) -> int:
        """Commit, or remove what this call wrote and nothing else."""
        try:
            return self.commit(shards, base)
        except Exception:
            self._discard(writes)
            raise

    def _discard(self, writes: list[str]) -> None:
        for w in writes:
            self._fs.delete(self._path(f"data/write_id={w}"), True)

    def _write(self, rows: DataFrame, version: int, write_id: str) -> DataFrame:
        """Write rows with ``shard_id`` and ``row_bytes``, clustered by shard; returns the manifest rows of what was written."""
        path = f"{self.root}/data/write_id={write_id}"
        rows.write.option("compression", "zstd").partitionBy("shard_id").parquet(path)
        if not any(n.startswith("shard_id=") for n in self._names(f"data/write_id={write_id}")):
            return self.spark.createDataFrame([], _MANIFEST)
        written = self.spark.read.schema("row_bytes long, shard_id long").parquet(path)  # of the texts only their sizes
        sizes = written.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("row_bytes").alias("n_bytes"))
        return sizes.select("shard_id", F.lit(version).alias("version"), tier(F.col("n_bytes")).alias("tier"), "n_docs", "n_bytes", F.lit(write_id).alias("write_id"))

    def _ranked(self, docs: DataFrame, arrival_rows: int, first_shard: int) -> DataFrame:
        """``docs`` with ``row_bytes`` and ``shard_id``: the arrival that the row's exact rank by id falls in, nulls last."""
        own, text = F.col(f"`{self.id_col}`").cast("long"), F.col(f"`{self.text_col}`").cast("string")
        docs = docs.withColumn("row_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
        rows, size, nulls = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("row_bytes"), F.lit(0)), F.count_if(own.isNull())).first()
        groups = min(MOST_GROUPS, max(-(-size // GROUP_BYTES), shuffle_partitions(self.spark)), max(1, -(-rows // arrival_rows)))
        ids = docs.select(own.alias("id")).filter("id IS NOT NULL").repartitionByRange(groups, "id")
        found = sorted((r["lo"], r["n"]) for r in ids.groupBy(F.spark_partition_id().alias("g")).agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("n")).collect())
        edges, counts = [r[0] for r in found] or [0], [r[1] for r in found] or [0]
        group = F.when(own.isNull(), F.lit(len(edges))).otherwise(last_at_most(edges, own))
        counts.append(nulls)
        # a group far above the mean is one hot id (or many null ones): it is cut by a hash of the row's text
        even = max(1, -(-rows // groups))
        cuts = [max(1, -(-n // even)) if n > 2 * even else 1 for n in counts]
        first = [0]
        for c in cuts:
            first.append(first[-1] + c)
        part = F.get(longs(first), group)
        if max(cuts) > 1:
            part = part + F.pmod(F.xxhash64(own, text), F.get(longs(cuts), group))
            counts = [0] * first[-1]
            for r in docs.select(part.alias("part")).groupBy("part").count().collect():
                counts[r["part"]] = r["count"]
        before, total = [], 0
        for n in counts:
            before.append(total)
            total += n
        dealt = docs.withColumn("write_id", part).repartitionByRange(len(counts), "write_id")
        rank = F.get(longs(before), F.col("write_id").cast("int")) + F.row_number().over(W.partitionBy("write_id").orderBy(own, F.xxhash64(text))) - 1
        return dealt.withColumn("shard_id", F.lit(first_shard) + F.floor(rank / arrival_rows).cast("long")).drop("write_id")

    def append(self, docs: DataFrame, arrival_rows: int = ARRIVAL_ROWS) -> int:
        """Add ``docs`` as arrivals of ``arrival_rows`` rows, numbered after all shards there are."""
        docs, base, write_id = docs.drop(*RESERVED), self.version(), uuid.uuid4().hex
        live = self.manifest(base)
        first = live.agg(F.coalesce(F.max("shard_id") + 1, F.lit(0).cast("long")).alias("n")).first()["n"]
        try:
            new = self._write(self._ranked(docs, arrival_rows, first), base + 1, write_id)
        except Exception:
            self._discard([write_id])
            raise
        return self._commit_own(live.unionByName(new), base, [write_id])

    def compact(self, target_bytes: int = TARGET_BYTES, rounds: int = ROUNDS) -> int:
        """Merge similarly sized runs; a store with nothing to merge keeps its version.

        A task writes one merged shard, or a few small ones: its input follows the target, not the store.
        """
        base = self.version()
        live, writes = self.manifest(base), []
        plan = compaction_plan(live, target_bytes, rounds)
        parts = materialize(live.join(plan.select("shard_id", "into"), "shard_id").withColumn("parts", F.count(F.lit(1)).over(W.partitionBy("into"))), "moves")
        moved = parts.filter("parts > 1")
        n = moved.count()
        if not n:
            release(parts)
            return base
        done = parts.filter("parts = 1").select("shard_id", "version", "tier", "n_docs", "n_bytes", "write_id")
        batches = -(-n // BATCH)
        try:
            for b in range(batches):
                some = moved.filter(F.pmod(F.xxhash64("into"), F.lit(batches)) == b)
                goals = some.select("into").distinct().count()
                if not goals:
                    continue
                rows = self._files(some).join(F.broadcast(some.select("shard_id", "into")), "shard_id").drop("shard_id").withColumnRenamed("into", "shard_id")
                writes.append(uuid.uuid4().hex)
                done = done.unionByName(self._write(rows.repartitionByRange(goals, "shard_id"), base + 1, writes[-1]))
        except Exception:
            self._discard(writes)
            raise
        at = self._commit_own(done, base, writes)
        release(parts)
        return at

    def _files(self, shards: DataFrame) -> DataFrame:
        """The rows of some shards of a manifest with ``shard_id``, read from the folders that it names."""
        paths = sorted(f"{self.root}/data/write_id={r['write_id']}/shard_id={r['shard_id']}" for r in shards.select("write_id", "shard_id").collect())
        found = self.spark.read.option("basePath", f"{self.root}/data").parquet(*paths)
        return found.withColumn("shard_id", F.col("shard_id").cast("long")).drop("write_id")

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version with ``shard_id``, ``version`` (of the shard), ``tier``, ``shard_docs``, ``shard_bytes``.

        The driver holds the names of the shards; their numbers go to the rows in broadcasts of at most ``BATCH`` shards.
        """
        live, out = self.manifest(version), None
        n = live.count()
        if not n:
            raise ValueError("the version holds no shards")
        batches = -(-n // BATCH)
        for b in range(batches):
            some = live.filter(F.pmod(F.xxhash64("shard_id"), F.lit(batches)) == b) if batches > 1 else live
            named = some.select("shard_id", "version", "tier", F.col("n_docs").alias("shard_docs"), F.col("n_bytes").alias("shard_bytes"))
            part = self._files(some).drop("row_bytes").join(F.broadcast(named), "shard_id")
            out = part if out is None else out.unionByName(part)
        return out

    def vacuum(self, keep: int = 1, min_age_s: float = 86_400.0) -> int:
        """Delete manifests before the newest ``keep``, and shard folders that no kept manifest names; returns how many.

        Folders touched within ``min_age_s`` stay: a writer that has not committed yet may own them.
        """
        last = self.version()
        kept = [v for v in range(max(1, last - keep + 1), last + 1) if self._fs.exists(self._path(f"manifest/{v}"))]
        for n in self._names("manifest"):
            if n.isdigit() and int(n) <= last and int(n) not in kept:
                self._fs.delete(self._path(f"manifest/{n}"), True)
        before, gone = (time.time() - min_age_s) * 1000, 0
        for name in self._names("data"):
            write_id = name.removeprefix("write_id=")
            live = {r["shard_id"] for v in kept for r in self.manifest(v).filter(F.col("write_id") == write_id).select("shard_id").collect()}
            for s in self._fs.listStatus(self._path(f"data/{name}")):
                folder = s.getPath().getName()
                if folder.startswith("shard_id=") and int(folder[9:]) not in live and s.getModificationTime() <= before:
                    self._fs.delete(s.getPath(), True)
                    gone += 1
            if not live and self._fs.getFileStatus(self._path(f"data/{name}")).getModificationTime() <= before:
                self._fs.delete(self._path(f"data/{name}"), True)
        return gone


def shard(docs: DataFrame, root: str | None = None, id_col: str = "doc_id", text_col: str = "text", arrival_rows: int = ARRIVAL_ROWS, target_bytes: int = TARGET_BYTES, rounds: int = ROUNDS) -> DataFrame:
    """Append ``docs`` to a store (a new one in the shared folder), compact it and read the committed version back.

    Every row of the store comes back once with its columns and its shard; repeated rows stay repeated.  Ids may be sparse,
    negative or null (null ids arrive last); rows with one id are in order of a hash of their text.  Null texts count no
    bytes.  Input columns named like the store's (``shard_id``, ``version``, ``tier``, ``shard_docs``, ``shard_bytes``,
    ``write_id``, ``row_bytes``) are dropped.  An empty input commits a manifest without new shards; a store without
    shards gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.drop(*RESERVED)
    store = ShardStore(spark, root or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", id_col, text_col)
    store.append(docs, arrival_rows)
    store.compact(target_bytes, rounds)
    if store.manifest().isEmpty():
        extra = {"shard_id": "long", "version": "int", "tier": "int", "shard_docs": "long", "shard_bytes": "long"}
        return docs.withColumns({c: F.lit(None).cast(t) for c, t in extra.items()}).limit(0)
    return store.read()


def _oracle() -> str:
    size_tier = lambda x: f"(length(bin(greatest({x}, 1))) - 1) // 2"
    steps = ["p0 AS MATERIALIZED (SELECT shard_id, n_docs, n_bytes, shard_id AS into_ FROM arrived)"]
    for r in range(ROUNDS):
        steps.append(f"""s{r} AS MATERIALIZED (SELECT into_, size, t, near, CASE WHEN t < 0 THEN into_ ELSE coalesce(sum(size) OVER (PARTITION BY t, near ORDER BY into_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // {TARGET_BYTES} END AS part
  FROM (SELECT into_, size, CASE WHEN size < {TARGET_BYTES} THEN {size_tier('size')} ELSE -1 END AS t, into_ // {SPAN} AS near FROM (SELECT into_, sum(n_bytes)::BIGINT AS size FROM p{r} GROUP BY into_)))""")
        steps.append(f"p{r + 1} AS MATERIALIZED (SELECT p.shard_id, p.n_docs, p.n_bytes, n.next AS into_ FROM p{r} p JOIN (SELECT into_, min(into_) OVER (PARTITION BY t, near, part) AS next FROM s{r}) n USING (into_))")
    return f"""
WITH d AS (SELECT doc_id, doc_id // {ARRIVAL_ROWS} AS arrival, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes FROM documents),
arrived AS (SELECT arrival AS shard_id, count(*) AS n_docs, sum(n_bytes)::BIGINT AS n_bytes FROM d GROUP BY arrival),
{", ".join(steps)},
final AS (SELECT into_ AS shard_id, sum(n_docs)::BIGINT AS shard_docs, sum(n_bytes)::BIGINT AS shard_bytes, CASE WHEN count(*) > 1 THEN 2 ELSE 1 END AS version FROM p{ROUNDS} GROUP BY into_)
SELECT d.doc_id, f.shard_id, f.version::INTEGER AS version, ({size_tier('f.shard_bytes')})::INTEGER AS tier, f.shard_docs, f.shard_bytes
FROM d JOIN p{ROUNDS} p ON d.arrival = p.shard_id JOIN final f ON p.into_ = f.shard_id"""


ORACLE_SQL = _oracle()
