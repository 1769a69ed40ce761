"""From labelled paths to flat tables with version bounds, and on to SQL."""

from __future__ import annotations

import re
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.graph import Graph
from ..plans.traversal import Traversal, execute


def flatten(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """One row for each combination of the labels' values whose ranges meet.

    ``labels`` maps output columns to columns of type ``array<history>`` (the values of a label, newest first).  A label
    that is null or empty gives a null cell and does not bound the versions; a path without any bound gives no row.
    Adds ``VERSION.FROM`` and ``VERSION.TO``; duplicates stay.
    """
    bounds = []
    for i, (name, column) in enumerate(labels.items()):
        entries = F.explode_outer(F.flatten(F.col(f"`{column}`")))
        df = df.select("*", entries.alias(f"_e{i}"))
        bounds.append(f"_e{i}")
    if not bounds:
        return df.limit(0).select(F.lit(0).alias("VERSION.FROM"), F.lit(0).alias("VERSION.TO"))

    def of(pick, part: str) -> Column:
        cells = [F.col(f"{b}.{part}") for b in bounds]
        return cells[0] if len(cells) == 1 else pick(*cells)

    df = df.withColumns({"_f": of(F.greatest, "f"), "_t": of(F.least, "t")}).filter(F.col("_f") <= F.col("_t"))
    cells = [F.col(f"_e{i}.v").alias(name) for i, name in enumerate(labels)]
    return df.select(*cells, F.col("_f").alias("VERSION.FROM"), F.col("_t").alias("VERSION.TO"))


_QUOTED = re.compile(r"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/)", re.S)


def _rename_table(query: str, name: str, by: str) -> str:
    parts = _QUOTED.split(query)
    return "".join(p if i % 2 else re.sub(rf"\b{name}\b(?!\s*\()", by, p) for i, p in enumerate(parts))


def sql(df: DataFrame, query: str = "select * from t1", table: str = "t1") -> DataFrame:
    """Run one query over ``df`` as table ``t1``; dots in column names become underscores.

    The view has a name of its own, so concurrent queries do not meet.  Statements that are not queries are refused.
    """
    spark = df.sparkSession
    view = f"v_{uuid.uuid4().hex}"
    text = _rename_table(query, table, view)
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    kind = plan.getClass().getName()
    if ".command" in kind or kind.rpartition(".")[2].startswith(("Insert", "Create", "Drop", "Update", "Delete", "Merge", "Replace", "Alter", "Set", "Show", "Describe", "Truncate")):
        raise ValueError("only queries can be run over an extracted table")
    plain = df.toDF(*(c.replace(".", "_") for c in df.columns))
    storable = plain.select(*(F.to_json(f"`{c}`").alias(c) if t.startswith(("struct", "map")) else F.col(f"`{c}`") for c, t in plain.dtypes))
    storable.createOrReplaceTempView(view)
    try:
        return spark.sql(text)
    finally:
        spark.catalog.dropTempView(view)


@dataclass(frozen=True)
class Extract:
    """``table(...)`` of a traversal; ``sql`` may be chained, each query sees the table before it as ``t1``."""

    traversal: Traversal
    columns: tuple[str, ...] = ()
    queries: tuple[str, ...] = ()

    def sql(self, query: str = "select * from t1") -> Extract:
        return Extract(self.traversal, self.columns, (*self.queries, query))

    def run(self, graph: Graph) -> DataFrame:
        frame = execute(graph, self.traversal)
        missing = [c for c in self.columns if c not in frame.labels]
        if missing:
            raise ValueError(f"never labelled: {', '.join(missing)}")
        names = self.columns or frame.labels
        table = flatten(frame.df, {n: f"l_{n}" for n in names})
        return reduce(sql, self.queries, table)


@dataclass(frozen=True)
class From:
    traversal: Traversal

    def extract(self, *columns: str) -> Extract:
        """A table of these labels in this order; without names of all labels in the order they first appear."""
        return Extract(self.traversal, columns)


def from_(traversal: Traversal) -> From:
    return From(traversal)


def timed(phase: str, timings: list[tuple[str, int]], f):
    """``f()`` with its milliseconds noted under ``phase``."""
    began = time.monotonic()
    try:
        return f()
    finally:
        timings.append((phase, round((time.monotonic() - began) * 1000)))
