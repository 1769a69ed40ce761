"""Operators over sets of paths: weighted edges, distinct elements, prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def numbered(paths: DataFrame) -> DataFrame:
    """Give each path an id that does not depend on how the plan is run: a hash of its elements and its copy number."""
    key = F.xxhash64("path")
    return paths.withColumn("path_id", F.struct(key.alias("h"), F.row_number().over(Window.partitionBy("path").orderBy(F.lit(1))).alias("copy")))


def weighted_edges(paths: DataFrame) -> DataFrame:
    """Edges of all paths with the number of times each path walks them.

    An edge counts with its direction and ranges.  One row for each edge: ``edge``, ``paths`` (list of path id and
    weight) and the total ``weight``; the counts per path combine before the shuffle.
    """
    steps = numbered(paths).select("path_id", F.explode("path").alias("edge")).filter("edge.kind = 'edge'")
    per_path = steps.groupBy("edge", "path_id").agg(F.count(F.lit(1)).alias("weight"))
    return per_path.groupBy("edge").agg(F.array_sort(F.collect_list(F.struct("path_id", "weight"))).alias("paths"), F.sum("weight").alias("weight"))


def edge_weights(paths: DataFrame) -> DataFrame:
    """Total weight and number of paths of each edge, without the lists."""
    steps = numbered(paths).select("path_id", F.explode("path").alias("edge")).filter("edge.kind = 'edge'")
    return steps.groupBy("edge").agg(F.count(F.lit(1)).alias("weight"), F.count_distinct("path_id").alias("n_paths"))


def distinct_elements(paths: DataFrame) -> DataFrame:
    return paths.select(F.explode("path").alias("e")).select("e.*").distinct()


def prefix_counts(paths: DataFrame) -> DataFrame:
    """The prefix tree of the paths: each prefix with its length and the number of paths that begin with it."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))
    return paths.filter(F.size("path") > 0).select(F.explode(prefixes).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).withColumn("depth", F.size("prefix"))
