"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source's documents are shuffled by the MD5 of their id and laid end to end, then once more for repeats.  A
document's virtual finish time is its source's words up to and with it divided by the source's target; sorting all
by that time serves sources in proportion to their targets, and the mix is the sorted prefix within the budget.

Both sorts are range sorts of narrow rows without texts, in as many ranges as the rows need, written with the number of
their range.  Running sums run within a range; only the totals of the ranges run on.  So a source, or an id, may hold
most rows, and rows that are equal in all are one row with a count.  The driver sees the totals of the ranges and the one row at the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import materialize, release, shuffle_partitions

WEIGHTS = (3, 1, 2)
SHARE, REPEATS = 1.5, 2
RANGE_ROWS = 250_000  # narrow rows of a sorted range
RUN_ROWS = 4096  # equal rows that one task counts out


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target`` (double).

    Sources, by code point with null last, take the weights in turn.  The budget is shared by weight; a target stops
    at ``repeats`` times its source and the excess goes to the others by weight.  In order of size per weight, the
    sources before the first that is not filled are full, the others share what is left.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    per = per.select("source", "source_size", weight.alias("weight"), (repeats * F.col("source_size")).alias("cap"))
    filling = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = filling.rowsBetween(W.unboundedPreceding, -1)
    onward = filling.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(upto), F.lit(0))
    level = per.select("*", (left / F.sum("weight").over(onward)).alias("level"), F.row_number().over(filling).alias("turn"))
    part = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("turn", "level"))
    first = F.min(part).over(whole)  # the first source that is not filled
    full = F.coalesce(F.col("turn") < first["turn"], F.lit(True))
    return level.select("source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(F.col("weight") * first["level"]).alias("target"))


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all columns, so rows that differ anywhere are told apart; maps go by their JSON."""
    odd = lambda kind: "map<" in kind or "variant" in kind
    return F.xxhash64(*(F.to_json(F.struct(F.col(f"`{c}`"))) if odd(kind) else F.col(f"`{c}`") for c, kind in docs.dtypes))


def _ranges(spark: SparkSession, rows: int) -> int:
    return max(shuffle_partitions(spark), -(-rows // RANGE_ROWS))


def _laid(docs: DataFrame, id_col: str, text_col: str, source_col: str, row_hash: Column, weights, share, repeats) -> tuple[DataFrame, DataFrame, float]:
    """Every row (no texts) with ``upto``, its source's words up to and with it; the targets; the budget."""
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{source_col}`").cast("string").alias("source"), row_hash.alias("rh"))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary"))
    none = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))  # a key that is never null
    sizes = own.select("doc_id", "source", none.alias("s"), key.alias("h"), word_count(F.col("text")).alias("size"), "rh")
    classes = materialize(sizes.groupBy("s", "source", "h", "doc_id", "size", "rh").agg(F.count(F.lit(1)).alias("m")), "sizes")
    rows, most, total = classes.agg(F.count(F.lit(1)), F.coalesce(F.max("m"), F.lit(0)), F.coalesce(F.sum(F.col("size") * F.col("m")), F.lit(0))).first()
    goal = materialize(targets(classes.select("source", (F.col("size") * F.col("m")).alias("size")), weights, share, repeats), "targets")
    order = ("h", "doc_id", "size", "rh")
    ranged = materialize(classes.repartitionByRange(_ranges(spark, rows), "s", *order).withColumn("part", F.spark_partition_id()), "ranged")
    words = F.sum(F.col("size") * F.col("m"))
    parts = ranged.groupBy("s", "part").agg(words.alias("words"))
    parts = parts.select("s", "part", F.coalesce(F.sum("words").over(W.partitionBy("s").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(words.over(W.partitionBy("part", "s").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    goals = goal.select(none.alias("s"), "source_size", "target")
    placed = ranged.withColumn("start", inside).join(parts, ["s", "part"]).join(goals, "s").withColumn("start", F.col("start") + F.col("before"))
    if most > RUN_ROWS:  # a long run of equal rows is counted out by many tasks
        placed = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(RUN_ROWS)))).repartition("h", "run")
        turn = F.explode(F.sequence(F.col("run") + 1, F.least(F.col("m"), F.col("run") + RUN_ROWS)))
    else:
        turn = F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))
    laid = placed.withColumn("turn", turn).select("doc_id", "source", "h", "size", "rh", "m", "source_size", "target", (F.col("start") + F.col("turn") * F.col("size")).alias("upto"))
    laid = materialize(laid, "laid")
    for df in (classes, ranged):
        release(df)
    return laid, goal, share * total


def _copies(laid: DataFrame, budget: float, repeats: int) -> Column:
    """How often each row is taken: a column over ``laid``."""
    order = ("v", "h", "doc_id", "copy", "size")

    def time(copy: int) -> Column:
        return F.when(F.col("target") > 0, (F.col("upto") + F.lit(copy) * F.col("source_size")) / F.col("target"))

    turns = laid.filter("size > 0").select("h", "doc_id", "size", F.explode(F.array(*(F.struct(time(k).alias("v"), F.lit(k).alias("copy")) for k in range(repeats)))).alias("t")).select("t.v", "h", "doc_id", "t.copy", "size").filter("v IS NOT NULL")
    ranges = _ranges(laid.sparkSession, laid.count() * repeats)
    queue = materialize(turns.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "queue")
    spent, end, open_ = 0, None, None
    for r in queue.groupBy("part").agg(F.sum("size").alias("words"), F.max(F.struct(*order)).alias("last")).orderBy("part").collect():  # a row a range
        if spent + r["words"] > budget:
            open_ = r["part"]
            break
        spent, end = spent + r["words"], r["last"]
    if open_ is not None:
        last = queue.filter(F.col("part") == open_).withColumn("run", F.sum("size").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) + spent)
        end = last.filter(F.col("run") <= budget).agg(F.max(F.struct(*order)).alias("m")).first()["m"] or end
    release(queue)

    def taken(copy: int) -> Column:
        if open_ is None:
            return time(copy).isNotNull().cast("int")
        if end is None:
            return F.lit(0)
        here = F.struct(time(copy).alias("v"), F.col("h"), F.col("doc_id"), F.lit(copy).alias("copy"), F.col("size"))
        limit = F.struct(F.lit(end["v"]).alias("v"), F.lit(end["h"]).alias("h"), F.lit(end["doc_id"]).cast("long").alias("doc_id"), F.lit(end["copy"]).alias("copy"), F.lit(end["size"]).cast("long").alias("size"))
        return F.coalesce(time(copy).isNotNull() & (here <= limit), F.lit(False)).cast("int")

    return sum((taken(k) for k in range(1, repeats)), taken(0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``copies`` (0 to ``repeats``) of every row.

    Null and empty texts have size 0 and cost nothing; null sources are a source of their own, last in order.  Null ids
    shuffle by the hash of their text; rows of one id are served one after another, by size, and equal rows each have their own turn.
    An empty input, or one without words, takes nothing.  Other columns are not read.
    """
    text = F.col(f"`{text_col}`").cast("string")
    laid, _, budget = _laid(docs, id_col, text_col, source_col, F.xxhash64(text), weights, share, repeats)
    return laid.select("doc_id", "source", "size", "source_size", "target", _copies(laid, budget, repeats).alias("copies"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes each, with their columns; whatever ids they have, totals are those of ``mix``.

    Rows that are equal in every column are interchangeable: if their turns do not divide evenly, one of them stands for all.
    """
    laid, _, budget = _laid(docs, id_col, text_col, source_col, _row_hash(docs), weights, share, repeats)
    found = laid.withColumn("copies", _copies(laid, budget, repeats)).groupBy("h", "rh").agg(F.count(F.lit(1)).alias("m"), F.sum("copies").alias("n")).filter("n > 0")
    found = found.select(F.col("h").alias("_h"), F.col("rh").alias("_rh"), "m", "n")
    own = F.md5(F.coalesce(F.col(f"`{id_col}`").cast("long").cast("string"), F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), own.alias("h"), _row_hash(docs).alias("rh"))
    joined = rows.join(found, (rows["h"] == found["_h"]) & (rows["rh"] == found["_rh"]))
    taken = joined.filter("n % m = 0").select("row", F.expr("n div m").alias("n"))
    if not found.filter("n % m != 0").isEmpty():  # only equal rows that the end of the mix, or of a pass, parts
        uneven = joined.filter("n % m != 0").groupBy("h", "rh").agg(F.first("row").alias("row"), F.first("n").alias("n"))
        taken = taken.unionByName(uneven.select("row", "n"))
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("row.*")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, md5(doc_id::VARCHAR) AS h, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
weighed AS (SELECT *, {REPEATS} * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight FROM per),
levels AS (SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
        row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS turn FROM weighed),
open AS (SELECT min(turn) AS turn, arg_min(level, turn) AS level FROM levels WHERE level <= cap / weight),
goal AS (SELECT l.source, l.source_size, CASE WHEN o.turn IS NULL OR l.turn < o.turn THEN l.cap::DOUBLE ELSE l.weight * o.level END AS target FROM levels l, open o),
laid AS (SELECT d.*, g.source_size, g.target, (sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
         FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
turns AS (SELECT doc_id, h, size, k, (upto + k * source_size) / target AS v FROM laid, range(0, {REPEATS}) AS r(k) WHERE target > 0),
run AS (SELECT *, sum(size) OVER (ORDER BY v, h, doc_id, k, size ROWS UNBOUNDED PRECEDING) AS spent FROM turns),
won AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM run WHERE spent <= {SHARE} * (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT laid.doc_id, laid.size, laid.source_size, laid.target, coalesce(won.taken, 0)::BIGINT AS taken
FROM laid LEFT JOIN won ON laid.doc_id = won.doc_id"""
