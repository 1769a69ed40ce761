"""Schema evolution: what may change between two schemas, and the change of a store."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import ranges as R
from ..plans.schema import Node, Property, Schema
from .store import Store


class MigrationError(ValueError):
    pass


@dataclass(frozen=True)
class Difference:
    added_nodes: tuple[str, ...]
    added_edges: tuple[str, ...]
    added_properties: tuple[tuple[str, Property], ...]
    removed_properties: tuple[tuple[str, Property], ...]


def _properties(schema: Schema) -> set:
    """Property identity: element, name, kind and whether it is part of the key; a change of kind is a new property."""
    return {(e.name, p.name, p.kind, isinstance(e, Node) and p.name in e.key) for e in (*schema.nodes, *schema.edges) for p in e.properties}


def difference(old: Schema, new: Schema) -> Difference:
    """What to change; raises ``MigrationError`` for what cannot be done without losing identities."""
    old_nodes, new_nodes = {n.name: n for n in old.nodes}, {n.name: n for n in new.nodes}
    old_edges, new_edges = {e.name: e for e in old.edges}, {e.name: e for e in new.edges}
    gone, come = _properties(old) - _properties(new), _properties(new) - _properties(old)
    if bad := sorted(n for n in old_nodes if n not in new_nodes):
        raise MigrationError(f"node types cannot be removed: {bad}")
    if bad := sorted(e for e in old_edges if e not in new_edges):
        raise MigrationError(f"edge types cannot be removed: {bad}")
    if bad := sorted(f"{e}.{p}" for e, p, _, is_id in gone if is_id):
        raise MigrationError(f"key properties cannot be removed: {bad}")
    if bad := sorted(f"{e}.{p}" for e, p, _, is_id in come if is_id and e in old_nodes):
        raise MigrationError(f"key properties cannot be added to old nodes: {bad}")
    for name, n in old_nodes.items():
        parts = [k for k in n.key if k in old_edges]
        now = [k for k in new_nodes[name].key if k in new_edges]
        if set(parts) - set(now):
            raise MigrationError(f"key edges cannot be removed: {name}")
        if set(now) - set(parts):
            raise MigrationError(f"old nodes cannot get new key edges: {name}")
    for name, e in old_edges.items():
        if (e.source, e.target) != (new_edges[name].source, new_edges[name].target):
            raise MigrationError(f"the ends of {name} cannot change")
    for name, e in new_edges.items():
        if name not in old_edges and ((e.to_card in "1+" and e.source in old_nodes) or (e.from_card in "1+" and e.target in old_nodes)):
            raise MigrationError(f"old nodes cannot get a mandatory edge: {name}")
    pick = lambda schema, keys: tuple(sorted(((e, next(p for p in schema.element(e).properties if p.name == name)) for e, name, _, _ in keys), key=lambda x: (x[0], x[1].name)))
    here = {k for k in come if k[0] in old_nodes or k[0] in old_edges}
    return Difference(tuple(n for n in new_nodes if n not in old_nodes), tuple(e for e in new_edges if e not in old_edges), pick(new, here), pick(old, gone))


def migrate(store: Store, new: Schema, defaults: dict[tuple[str, str], object] | None = None, hook: Callable[[Store], None] | None = None) -> Store:
    """The store under ``new``: added properties hold their default (or null) over all history.

    A hook runs first with the store as it was.  The history of each touched element is written to new folders and
    published as one more version; older versions keep their rows, and readers that hold one go on reading it under the
    old schema.  Keys are stored by name, so another order of key properties is no change of the rows.
    """
    change = difference(store.schema, new)
    if hook:
        hook(store)
    after = Store(store.spark, store.root, new)
    base, defaults = store.version(), defaults or {}
    there = store.manifest(base)["elements"]
    touched = {e for e, _ in (*change.added_properties, *change.removed_properties) if e in there}
    whole = {}
    for name in sorted(touched):
        rows = store.rows(name, base)
        for element, p in change.removed_properties:
            if element == name:
                rows = rows.drop(f"p_{p.name}")
        for element, p in change.added_properties:
            if element == name:
                rows = rows.withColumn(f"p_{p.name}", F.lit(defaults.get((name, p.name))).cast(p.spark))
        # keys in the order of the new schema
        old = dict(zip(store.schema.key_names(name), store._columns(name)[0]))
        keys = [F.col(old[n]).alias(k) for n, k in zip(new.key_names(name), after._columns(name)[0])]
        whole[name] = _parted(rows.select(*keys, *after._columns(name)[1], "f", "t"))
    if whole:
        after.replace(whole, base)
    return after


def _parted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("part", F.when(F.col("t") == R.HEAD, "open").otherwise("closed"))


def add_key_property(store: Store, new: Schema, node: str, name: str, default: object) -> Store:
    """The store under ``new``, in which ``node`` has one more key property: ``default`` for all nodes that ever were.

    Identities that hold the node's key, those of weak nodes and of the ends of edges, get it too.  One version.
    """
    before, after = store.schema.node(node), Store(store.spark, store.root, new)
    if name in before.key or name not in new.node(node).key:
        raise MigrationError(f"{node}.{name} is not a new key property")
    base = store.version()
    whole = {}
    for element, entry in store.manifest(base)["elements"].items():
        names, keys = new.key_names(element), new.table_columns(element)[0]
        if sorted(names) == sorted(entry["keys"]):
            continue
        old = dict(zip(store.schema.key_names(element), store._columns(element)[0]))
        if any(n not in old and re.split(r"[#:]", n)[-1] != name for n in names) or set(old) - set(names):
            raise MigrationError(f"the key of {element} changes in other ways")
        columns = [(F.col(old[n]) if n in old else F.lit(default).cast(p.spark)).alias(c) for n, (c, p) in zip(names, keys)]
        whole[element] = _parted(store.rows(element, base).select(*columns, *after._columns(element)[1], "f", "t"))
    if whole:
        after.replace(whole, base)
    return after


def add_rows(store: Store, element: str, rows: DataFrame) -> int:
    """Backdated writes: rows with explicit ranges join the history in a new version.

    A range that is empty, or that meets another row of the same key, old or new, refuses them all.
    """
    base = store.version()
    keys, data, _ = store._columns(element)
    every = store.rows(element, base).select(*keys, *data, "f", "t").unionByName(rows.select(*keys, *data, F.col("f").cast("int"), F.col("t").cast("int")))
    earlier = F.max("t").over(Window.partitionBy(*keys).orderBy("f", "t").rowsBetween(Window.unboundedPreceding, -1))
    if not every.withColumn("_t", earlier).filter("f > t OR _t >= f").isEmpty():
        raise MigrationError(f"rows of {element} would hold at the same version")
    return store.replace({element: _parted(every)}, base)


def remove_element(store: Store, name: str) -> int:
    """A version without an element type's rows; older versions keep them."""
    return _republish(store, {name: None})


def rename_element(store: Store, old: str, new: str) -> int:
    """A version in which an element type has another name; its rows stay where they are."""
    if old not in store.manifest()["elements"]:
        raise MigrationError(f"{old} could not be renamed")
    return _republish(store, {old: new})


def _republish(store: Store, names: dict[str, str | None]) -> int:
    base = store.version()
    before = store.manifest(base)
    elements = {names.get(e, e): entry for e, entry in before["elements"].items()}
    elements.pop(None, None)
    store._publish(base + 1, elements, before["sources"])
    return base + 1
