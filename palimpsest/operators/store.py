"""The versioned store: slowly changing rows for each element type in immutable folders, named by versions.

The manifest of version ``n`` (``versions/n``) says for each element where its rows lie: a folder of open rows (those
that hold at the head, rewritten by each import) and the folders of closed rows (those that an import closed, written once).
An import therefore shuffles open rows against the staged ones only; history that is over is never read or
rewritten.  Every write goes to a folder with a fresh name and a version is published by renaming its manifest, so writers cannot
harm each other or a reader: of two, one publishes and the other removes what it wrote itself.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import ranges as R
from ..plans.graph import Elements, Graph, Lazy
from ..plans.schema import Edge, Node, Schema

MODES = ("full", "incremental")


def element_id(type_name: str, key: list[Column]) -> Column:
    """An id that is the key itself as text, so different keys never meet."""
    return F.concat(F.lit(f"{type_name}:"), F.to_json(F.array(*(F.coalesce(F.to_json(F.struct(k.alias("k"))), F.lit("{}")) for k in key))))


def _same(left: str, right: str, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`"))
    return out


def merge(open_rows: DataFrame, staged: DataFrame, keys: list[str], data: list[str], version: int, delete: str = "none", gone: DataFrame | None = None) -> DataFrame:
    """One step of history: the rows open after ``version`` (``part`` is ``open``) and the rows it closed (``closed``), with ``f`` and ``t``.

    ``open_rows`` has the keys, the data and ``f``; ``staged`` the keys, the data and ``_n`` (load order: of rows with one
    key the first counts).  New keys open at ``version`` (a deleted key that comes back too); changed data closes the old
    row at ``version - 1`` and opens a new one; unchanged rows stay.  A row opened by this very version is not changed
    again.  ``delete`` is ``none``, ``absent`` (open keys that are not staged close) or ``listed`` (those in ``gone``).
    """
    first = staged.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy("_n"))).filter("_place = 1").select(*keys, *data)
    o, s = open_rows.select(*keys, *data, "f").alias("o"), first.withColumn("_s", F.lit(True)).alias("s")
    both = o.join(s, _same("o", "s", keys), "full_outer")
    there, new = F.col("o.f").isNotNull(), F.coalesce(F.col("s._s"), F.lit(False))
    if delete == "listed":
        g = gone.select(*keys).distinct().withColumn("_g", F.lit(True)).alias("g")
        both = both.join(g, _same("o", "g", keys), "left")
        ends = there & ~new & F.coalesce(F.col("g._g"), F.lit(False))
    else:
        ends = there & ~new & F.lit(delete == "absent")
    changed = there & new & ~_same("o", "s", data) & (F.col("o.f") < version)
    closes = (ends | changed) & (F.col("o.f") < version)
    old = [F.col(f"o.`{c}`").alias(c) for c in keys + data]
    now = [F.when(there, F.col(f"o.`{c}`")).otherwise(F.col(f"s.`{c}`")).alias(c) for c in keys] + [F.when(there & ~changed, F.col(f"o.`{c}`")).otherwise(F.col(f"s.`{c}`")).alias(c) for c in data]
    stays = F.struct(*now, F.when(there & ~changed, F.col("o.f")).otherwise(F.lit(version)).cast("int").alias("f"), F.lit(R.HEAD).alias("t"), F.lit("open").alias("part"))
    closed = F.struct(*old, F.col("o.f").alias("f"), F.lit(version - 1).cast("int").alias("t"), F.lit("closed").alias("part"))
    # both at once: a changed row is one row of either kind
    return both.select(F.explode(F.array_compact(F.array(F.when(~ends, stays), F.when(closes, closed)))).alias("row")).select("row.*")


@dataclass(frozen=True)
class Load:
    """What an import brings for one element type: rows with keys, data and ``_n``, and how they are meant."""

    rows: DataFrame
    mode: str = "full"
    previous: DataFrame | None = None  # the rows of the last full import of this element, for a difference


class Store:
    """Writer and reader of a versioned graph.  ``read(version)`` gives a ``Graph``; ``load`` makes the next version."""

    def __init__(self, spark: SparkSession, root: str, schema: Schema):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def version(self) -> int:
        """The newest version; a new store is at 0."""
        if not self._fs.exists(self._path("versions")):
            return 0
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(self._path("versions")) if s.getPath().getName().isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """Where the rows of a version lie: ``elements`` by name, and ``sources``, the imports that it and those before it are made of."""
        at = self.version() if version is None else version
        if not at:
            return {"elements": {}, "sources": []}
        stream = self._fs.open(self._path(f"versions/{at}/manifest.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    # -- tables
    def _columns(self, element: str) -> tuple[list[str], list[str], str]:
        keys, data = self.schema.table_columns(element)
        ddl = ", ".join(f"`{c}` {p.spark}" for c, p in keys + data)
        return [c for c, _ in keys], [c for c, _ in data], ddl

    def _stored(self, element: str, entry: dict, folders: list[str], more: str) -> DataFrame:
        """Rows of some folders in the key order of the schema, whatever the order they were written in."""
        keys, data = self.schema.table_columns(element)
        names = self.schema.key_names(element)
        if sorted(names) != sorted(entry["keys"]):
            raise ValueError(f"{element} is stored with the key {entry['keys']}, not {names}")
        place = {name: c for name, (c, _) in zip(names, keys)}
        kind = {c: p.spark for c, p in keys}
        ddl = ", ".join([f"`{c}` {kind[place[name]]}" for (c, _), name in zip(keys, entry["keys"])] + [f"`{c}` {p.spark}" for c, p in data])
        rows = self.spark.read.schema(f"{ddl}, {more}").parquet(*(f"{self.root}/data/{x}" for x in folders))
        if names == entry["keys"]:
            return rows
        own = {place[name]: c for (c, _), name in zip(keys, entry["keys"])}
        return rows.select(*(F.col(own[c]).alias(c) for c, _ in keys), *(c for c, _ in data), *(x.split()[0] for x in more.split(", ")))

    def open_rows(self, element: str, version: int | None = None) -> DataFrame:
        return self._open(element, self.manifest(version)["elements"].get(element))

    def _open(self, element: str, entry: dict | None) -> DataFrame:
        if not entry or not entry["open"]:
            return self.spark.createDataFrame([], f"{self._columns(element)[2]}, f int")
        return self._stored(element, entry, [entry["open"]], "f int")

    def rows(self, element: str, version: int | None = None, within: tuple[int, int] | None = None) -> DataFrame:
        """Every row of an element's history as of a version, with closed ranges ``f``, ``t``.

        ``within`` keeps the rows that hold anywhere in a range of versions, cut to it; the scans filter by it.
        """
        return self._rows(element, self.manifest(version)["elements"].get(element), [within] if within else None)

    def _rows(self, element: str, entry: dict | None, versions=None) -> DataFrame:
        def sliced(df: DataFrame) -> DataFrame:
            if versions is None:
                return df
            hit = F.lit(False)
            for a, b in versions:
                hit = hit | ((F.col("f") <= b) & (F.col("t") >= a))
            a, b = min(v[0] for v in versions), max(v[1] for v in versions)
            return df.filter(hit).withColumns({"f": F.greatest("f", F.lit(a)), "t": F.least("t", F.lit(b))})

        now = sliced(self._open(element, entry).withColumn("t", F.lit(R.HEAD)))
        if not entry or not entry["closed"]:
            return now
        return now.unionByName(sliced(self._stored(element, entry, entry["closed"], "f int, t int")))

    # -- writing
    def load(self, loads: dict[str, Load], source: str | None = None) -> tuple[int, dict[str, DataFrame]]:
        """Apply an import as the next version; returns it and, by element, the staged rows that were refused.

        Nodes go in schema order and edges after them.  A node whose parent, or an edge whose end, does not hold at the
        new head is refused; so are loads of key edges, which follow their nodes.  An import with a ``source`` that a
        version already has is not applied again.
        """
        base = self.version()
        before = self.manifest(base)
        if source is not None and source in before["sources"]:
            return base, {}
        at, refused, written = base + 1, {}, {}
        after = dict(before["elements"])

        def head(node: str) -> DataFrame:
            return self._open(node, after.get(node))

        try:
            for e in (*self.schema.nodes, *self.schema.edges):
                if e.name not in loads:
                    continue
                if isinstance(e, Edge):
                    if self.schema.is_key_edge(e.name):
                        raise ValueError(f"{e.name} is part of an identity and cannot be loaded")
                    ends = [("s", e.source), ("d", e.target)]
                else:
                    ends = [(place, parent) for _, parent, place in self.schema.parents(e.name)]
                load = self._checked(e.name, loads[e.name], ends, head, refused)
                after[e.name] = self._write(e.name, self._merged(e.name, load, after.get(e.name), at), after.get(e.name), written)
            self._publish(at, after, before["sources"] + ([source] if source is not None else []))
        except Exception:
            self._discard(written)
            raise
        return at, refused

    def _write(self, element: str, rows: DataFrame, entry: dict | None, written: dict) -> dict:
        """Write rows with ``part``; the element's new entry.  Notes the folder in ``written``."""
        folder = f"{element}/{uuid.uuid4().hex}"
        written[folder] = element
        rows.write.partitionBy("part").parquet(f"{self.root}/data/{folder}")
        there = lambda part: [f"{folder}/part={part}"] if self._fs.exists(self._path(f"data/{folder}/part={part}")) else []
        return {"keys": self.schema.key_names(element), "open": (there("open") or [None])[0], "closed": (entry["closed"] if entry else []) + there("closed")}

    def _discard(self, written: dict) -> None:
        for folder in written:
            self._fs.delete(self._path(f"data/{folder}"), True)

    def _checked(self, element: str, load: Load, ends, head, refused) -> Load:
        if load.mode not in MODES:
            raise ValueError(f"unknown import mode {load.mode}")
        rows = load.rows
        for place, node in ends:
            width = len(self.schema.key_columns(node))
            mine = [f"{place}{i}" for i in range(width)] if isinstance(place, str) else [f"k{place + i}" for i in range(width)]
            parents = head(node).select(*(F.col(f"k{i}").alias(f"_p{i}") for i in range(width)))
            on = F.lit(True)
            for m, i in zip(mine, range(width)):
                on = on & rows[m].eqNullSafe(parents[f"_p{i}"])
            lost = rows.join(parents, on, "left_anti")
            refused[element] = lost if element not in refused else refused[element].unionByName(lost)
            rows = rows.join(parents, on, "left_semi")
        return Load(rows, load.mode, load.previous)

    def _merged(self, element: str, load: Load, entry: dict | None, at: int) -> DataFrame:
        keys, data, _ = self._columns(element)
        now = self._open(element, entry)
        if load.mode == "incremental":
            return merge(now, load.rows, keys, data, at)
        if load.previous is None:
            return merge(now, load.rows, keys, data, at, "absent")
        # a difference: write what is new or changed against the last file, delete the keys that left it
        same = load.previous.select(*keys, *data)
        fresh = load.rows.join(same.distinct().withColumnsRenamed({c: f"_o{c}" for c in keys + data}), self._on(load.rows, keys + data), "left_anti")
        gone = same.select(*keys).distinct().join(load.rows.select(*(F.col(c).alias(f"_n{c}") for c in keys)), self._on(same, keys, "_n"), "left_anti")
        return merge(now, fresh, keys, data, at, "listed", gone)

    @staticmethod
    def _on(left: DataFrame, columns: list[str], prefix: str = "_o") -> Column:
        out = F.lit(True)
        for c in columns:
            out = out & F.col(f"`{c}`").eqNullSafe(F.col(f"`{prefix}{c}`"))
        return out

    def delete(self, element: str, keys: DataFrame) -> int:
        """A version in which the listed keys (``k0..`` or ``s0.., d0..``) are closed; other edges stay open."""
        columns, data, ddl = self._columns(element)
        base = self.version()
        entry = self.manifest(base)["elements"].get(element)
        none = self.spark.createDataFrame([], f"{ddl}, _n long")
        return self.replace({element: merge(self._open(element, entry), none, columns, data, base + 1, "listed", keys)}, base, keep=True)

    def replace(self, rows: dict[str, DataFrame], base: int, keep: bool = False) -> int:
        """Publish the version after ``base`` with new rows (with ``part``) for some elements; ``keep`` their closed history."""
        before, written = self.manifest(base), {}
        after = dict(before["elements"])
        try:
            for element, df in rows.items():
                after[element] = self._write(element, df, after.get(element) if keep else None, written)
            self._publish(base + 1, after, before["sources"])
        except Exception:
            self._discard(written)
            raise
        return base + 1

    def _publish(self, at: int, elements: dict, sources: list[str]) -> None:
        draft = f"draft-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(f"{draft}/manifest.json"))
        try:
            out.write(bytearray(json.dumps({"version": at, "elements": elements, "sources": sources}).encode()))
        finally:
            out.close()
        self._fs.mkdirs(self._path("versions"))
        goal, inside = self._path(f"versions/{at}"), self._path(f"versions/{at}/{draft}")
        # a rename onto a folder that is there fails or moves into it
        if self._fs.exists(goal) or not self._fs.rename(self._path(draft), goal) or self._fs.exists(inside):
            self._fs.delete(self._path(draft), True)
            self._fs.delete(inside, True)
            raise RuntimeError(f"version {at} was published by another writer")

    def vacuum(self, keep: int = 1, min_age_s: float = 86_400.0) -> int:
        """Delete the manifests before the newest ``keep`` versions, and data folders that no kept manifest names; returns how many.

        Folders touched within ``min_age_s`` stay: a writer that has not published yet may own them.
        """
        last = self.version()
        kept = [v for v in range(max(1, last - keep + 1), last + 1) if self._fs.exists(self._path(f"versions/{v}"))]
        live = {x.rpartition("/")[0] for v in kept for entry in self.manifest(v)["elements"].values() for x in [entry["open"], *entry["closed"]] if x}
        for v in range(1, last - keep + 1):
            self._fs.delete(self._path(f"versions/{v}"), True)
        before, gone = (time.time() - min_age_s) * 1000, 0
        for element in self._fs.listStatus(self._path("data")) if self._fs.exists(self._path("data")) else []:
            for s in self._fs.listStatus(element.getPath()):
                if f"{element.getPath().getName()}/{s.getPath().getName()}" not in live and s.getModificationTime() <= before:
                    self._fs.delete(s.getPath(), True)
                    gone += 1
        return gone

    # -- reading
    def read(self, version: int | None = None, within: tuple[int, int] | None = None) -> Graph:
        """The graph of a version.

        ``within`` is a slice: the scans keep rows that hold in that range of versions, and ranges are cut to it.  In a
        slice of one version every element has one row and a plain range; nor is a type grouped whose history has nothing closed.
        """
        elements = self.manifest(version)["elements"]
        opener = lambda e: lambda: self._elements(e, elements, within)
        return Graph(self.schema, Lazy({n.name: opener(n) for n in self.schema.nodes}), Lazy({e.name: opener(e) for e in self.schema.edges}), self.spark)

    def _elements(self, e: Node | Edge, elements: dict, within: tuple[int, int] | None) -> Elements:
        """The table of a type; slices of it filter rows before they are grouped."""
        key_edge = isinstance(e, Edge) and self.schema.is_key_edge(e.name)
        owner = e.source if key_edge else e.name
        entry = elements.get(owner)
        keys, data, _ = self._columns(owner)
        data = [] if key_edge else data
        lone = not (entry and entry["closed"])  # no element has a second row
        single = within is not None and within[0] == within[1]

        def table(versions, flat: bool) -> DataFrame:
            rows = self._rows(owner, entry, versions)
            if lone and not flat:
                rows = rows.withColumns({"rs": F.array(R.span(F.col("f"), F.col("t")))} | {c: F.array(F.struct("f", "t", F.col(f"`{c}`").alias("v"))) for c in data})
            elif not flat:
                span = F.struct("f", "t")
                rows = rows.groupBy(*keys).agg(R.normalize(F.collect_list(span)).alias("rs"), *(R.history(F.collect_list(F.struct("f", "t", F.col(f"`{c}`").alias("v")))).alias(c) for c in data))
            own = self._identity(e, owner, keys, key_edge)
            return rows.select(*own, *(("f", "t") if flat else ("rs",)), *(keys if isinstance(e, Node) else ()), *data)

        def cut(versions) -> DataFrame:
            a, b = within or (0, R.HEAD)
            versions = [(max(x, a), min(y, b)) for x, y in versions if max(x, a) <= min(y, b)]
            if not versions:
                return table([(a, b)], single).filter(F.lit(False))
            of = table(versions, single)
            if single and len(versions) == 1:
                return of
            rs = F.array(R.span(F.col("f"), F.col("t"))) if single else F.col("rs")
            return of.withColumn("rs", R.isect(rs, R.ranges(*versions))).filter(F.size("rs") > 0)

        if isinstance(e, Node):
            names = [label for label, p in self.schema.key_columns(e.name) if label == p.name]
        else:
            names = []
        properties = () if key_edge else tuple(names) + tuple(p.name for p in e.data)
        return Elements(table([within] if within else None, single), single, frozenset(properties if single else names), properties, cut)

    def _identity(self, e: Node | Edge, owner: str, keys: list[str], key_edge: bool) -> list[Column]:
        columns = [F.col(k) for k in keys]
        own = element_id(e.name, columns).alias("id")
        if isinstance(e, Node):
            return [own, *(F.col(c).alias(f"p_{label}") for c, (label, p) in zip(keys, self.schema.key_columns(e.name)) if label == p.name)]
        if key_edge:  # part of an identity: it lives as long as its node
            offset = next(o for name, _, o in self.schema.parents(owner) if name == e.name)
            width = len(self.schema.key_columns(e.target))
            return [own, element_id(owner, columns).alias("src"), element_id(e.target, columns[offset : offset + width]).alias("dst")]
        s, d = [F.col(k) for k in keys if k[0] == "s"], [F.col(k) for k in keys if k[0] == "d"]
        return [own, element_id(e.source, s).alias("src"), element_id(e.target, d).alias("dst")]
