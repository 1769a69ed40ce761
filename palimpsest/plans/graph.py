"""The tables a traversal reads: one DataFrame for each element type of a pinned version of a graph."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType

from ..functions import ranges as R
from .schema import Schema


@dataclass(frozen=True)
class Elements:
    """Rows of one element type.

    ``df`` has ``id`` (``src`` and ``dst`` too for edges), validity either as one range in ``f``, ``t`` (``single``) or
    as a range set ``rs``, and a column ``p_<name>`` for each property: a plain value that holds as long as the element (listed in
    ``constant``) or a history.
    """

    df: DataFrame
    single: bool
    constant: frozenset[str]
    properties: tuple[str, ...]
    cut: Callable[[list[tuple[int, int]]], DataFrame] | None = None  # the rows of a slice, where they need not be grouped first

    def rs(self) -> Column:
        return F.array(R.span(F.col("f"), F.col("t"))) if self.single else F.col("rs")


class Lazy(Mapping):
    """Tables by type name that are opened when a plan first reads them."""

    def __init__(self, openers: dict[str, Callable[[], Elements]]):
        self._openers, self._opened = openers, {}

    def __getitem__(self, name: str) -> Elements:
        if name not in self._opened:
            self._opened[name] = self._openers[name]()
        return self._opened[name]

    def __iter__(self):
        return iter(self._openers)

    def __len__(self) -> int:
        return len(self._openers)


@dataclass(frozen=True)
class Graph:
    schema: Schema
    nodes: Mapping[str, Elements]
    edges: Mapping[str, Elements]
    spark: SparkSession

    @property
    def id_type(self) -> DataType:
        tables = self.nodes or self.edges
        return tables[next(iter(tables))].df.schema["id"].dataType

    def _slice(self, of: Elements, versions) -> DataFrame:
        """Rows valid in any of ``versions`` (range pairs) with ``rs`` cut to them; one range stays a pushed filter."""
        if of.cut is not None:
            return of.cut(list(versions))
        if of.single and len(versions) == 1:
            (a, b), = versions
            return of.df.filter((F.col("f") <= b) & (F.col("t") >= a)).withColumns({"f": F.greatest("f", F.lit(a)), "t": F.least("t", F.lit(b))})
        return of.df.withColumn("rs", R.isect(of.rs(), R.ranges(*versions))).filter(F.size("rs") > 0)

    def nodes_at(self, name: str, versions=R.ALL) -> DataFrame:
        return self._slice(self.nodes[name], versions)

    def edges_at(self, name: str, versions=R.ALL) -> DataFrame:
        return self._slice(self.edges[name], versions)

    def node_by_id(self, name: str, node_id) -> DataFrame:
        return self.nodes[name].df.filter(F.col("id") == node_id)

    def edge_by_id(self, name: str, edge_id) -> DataFrame:
        return self.edges[name].df.filter(F.col("id") == edge_id)

    def _one(self, kind: str, name: str, element_id) -> DataFrame:
        of = (self.nodes if kind == "node" else self.edges)[name]
        found = of.df.filter(F.col("id") == element_id)
        return found.withColumn("rs", of.rs()).drop("f", "t")

    def element_within(self, kind: str, name: str, element_id, versions) -> DataFrame:
        """One element with its ranges cut to ``versions``; no row if nothing of them is left."""
        return self._one(kind, name, element_id).withColumn("rs", R.isect(F.col("rs"), R.ranges(*versions))).filter(F.size("rs") > 0)

    def element_exactly(self, kind: str, name: str, element_id, versions) -> DataFrame:
        """One element with exactly the ranges ``versions``, whatever its own; an empty set of them is refused."""
        if not versions:
            raise ValueError("an element needs a range")
        return self._one(kind, name, element_id).withColumn("rs", R.normalize(R.ranges(*versions)))

    def element_type(self, element_id) -> DataFrame:
        """``kind`` and ``type`` of the elements that have an id, over all types."""
        out = None
        for kind, tables in (("node", self.nodes), ("edge", self.edges)):
            for name, of in tables.items():
                one = of.df.filter(F.col("id") == element_id).select(F.lit(kind).alias("kind"), F.lit(name).alias("type")).distinct()
                out = one if out is None else out.unionByName(one)
        return out

    def node_by_key(self, name: str, **key) -> DataFrame:
        out = self.nodes[name].df
        for column, value in key.items():
            out = out.filter(F.col(f"p_{column}").eqNullSafe(F.lit(value)))
        return out

    def edge_between(self, name: str, source, target) -> DataFrame:
        return self.edges[name].df.filter((F.col("src") == source) & (F.col("dst") == target))

    def versions(self, name: str) -> DataFrame:
        """``id`` and the range set of every element of a type, with whether it holds at the head."""
        of = (self.nodes if name in self.nodes else self.edges)[name]
        return of.df.select("id", of.rs().alias("rs"), R.valid_at_head(of.rs()).alias("at_head"))

    def history(self, name: str, prop: str) -> DataFrame:
        """``id`` and the full history of a property."""
        of = (self.nodes if name in self.nodes else self.edges)[name]
        return of.df.select("id", (R.stamp(of.rs(), F.col(f"p_{prop}")) if prop in of.constant else F.col(f"p_{prop}")).alias("history"))

    def type_counts(self) -> DataFrame:
        """Elements of each type that ever were, without the edges that are part of a node's identity."""
        out = None
        for kind, tables in (("node", self.nodes), ("edge", self.edges)):
            for name, of in tables.items():
                if kind == "edge" and self.schema.is_key_edge(name):
                    continue
                one = of.df.select("id").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.lit(name).alias("type"), "n")
                out = one if out is None else out.unionByName(one)
        return out
