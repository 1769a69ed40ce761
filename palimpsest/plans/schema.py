"""Static schemas of versioned property graphs: node and edge types with typed properties and natural keys."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from ..functions.parsing import spark_type

CARDINALITIES = ("*", "+", "?", "1")


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class Property:
    name: str
    kind: str
    desc: str = ""
    scale: int = 18

    @property
    def spark(self) -> str:
        return spark_type(self.kind, self.scale)


@dataclass(frozen=True)
class Node:
    """A node type.  ``key`` lists names of own properties and of edges to the parents that are part of the identity."""

    name: str
    properties: tuple[Property, ...]
    key: tuple[str, ...]
    desc: str = ""

    @property
    def data(self) -> tuple[Property, ...]:
        return tuple(p for p in self.properties if p.name not in self.key)


@dataclass(frozen=True)
class Edge:
    """A directed edge type; cardinalities are declared, not enforced."""

    name: str
    source: str
    target: str
    properties: tuple[Property, ...] = ()
    from_card: str = "*"
    to_card: str = "1"
    desc: str = ""

    @property
    def data(self) -> tuple[Property, ...]:
        return self.properties


@dataclass(frozen=True)
class Schema:
    nodes: tuple[Node, ...] = ()
    edges: tuple[Edge, ...] = ()
    name: str = "schema"
    desc: str = ""

    def __post_init__(self):
        validate(self)

    def node(self, name: str) -> Node:
        for n in self.nodes:
            if n.name == name:
                return n
        raise SchemaError(f"no node type {name}")

    def edge(self, name: str) -> Edge:
        for e in self.edges:
            if e.name == name:
                return e
        raise SchemaError(f"no edge type {name}")

    def element(self, name: str) -> Node | Edge:
        return self.node(name) if any(n.name == name for n in self.nodes) else self.edge(name)

    def is_key_edge(self, name: str) -> bool:
        return any(name in n.key for n in self.nodes)

    def key_columns(self, node: str) -> list[tuple[str, Property]]:
        """The flattened identity of a node type: its key properties in order, parents' keys in place of key edges.

        Columns of a parent are named ``edge>Parent#column``, nested as deep as the parents are.
        """
        n, out = self.node(node), []
        own = {p.name: p for p in n.properties}
        for part in n.key:
            if part in own:
                out.append((part, own[part]))
            else:
                parent = self.edge(part).target
                out += [(f"{part}>{parent}#{c}", p) for c, p in self.key_columns(parent)]
        return out

    def header(self, element: str) -> list[tuple[str, Property]]:
        """The columns of an element's file: flattened keys (of both ends for an edge), then data properties."""
        e = self.element(element)
        if isinstance(e, Node):
            return self.key_columns(element) + [(p.name, p) for p in e.data]
        ends = [(f"{end}#{c}", p) for end in (e.source, e.target) for c, p in self.key_columns(end)]
        return ends + [(p.name, p) for p in e.properties]

    def table_columns(self, element: str) -> tuple[list[tuple[str, Property]], list[tuple[str, Property]]]:
        """Key columns by position (``k0..`` of a node, ``s0..`` and ``d0..`` of an edge's ends) and data columns (``p_<name>``)."""
        e = self.element(element)
        if isinstance(e, Node):
            return [(f"k{i}", p) for i, (_, p) in enumerate(self.key_columns(element))], [(f"p_{p.name}", p) for p in e.data]
        ends = [(f"{side}{i}", p) for side, end in (("s", e.source), ("d", e.target)) for i, (_, p) in enumerate(self.key_columns(end))]
        return ends, [(f"p_{p.name}", p) for p in e.properties]

    def key_names(self, element: str) -> list[str]:
        """What each key column of ``table_columns`` stands for, by name."""
        e = self.element(element)
        if isinstance(e, Node):
            return [c for c, _ in self.key_columns(element)]
        return [f"{side}:{c}" for side, end in (("s", e.source), ("d", e.target)) for c, _ in self.key_columns(end)]

    def parents(self, node: str) -> Iterator[tuple[str, str, int]]:
        """Key edges of a node type: edge, parent type and the offset of the parent's key in the flattened key."""
        n, at = self.node(node), 0
        own = {p.name for p in n.properties}
        for part in n.key:
            if part in own:
                at += 1
            else:
                parent = self.edge(part).target
                yield part, parent, at
                at += len(self.key_columns(parent))


def validate(schema: Schema) -> None:
    """The rules of a schema; raises ``SchemaError`` at the first that is broken."""
    names = [n.name for n in schema.nodes]
    every = names + [e.name for e in schema.edges]
    if len(set(every)) != len(every):
        raise SchemaError("element names must be unique")
    for e in schema.edges:
        if e.source not in names or e.target not in names:
            raise SchemaError(f"{e.name}: both ends must be node types of the schema")
        if e.from_card not in CARDINALITIES or e.to_card not in CARDINALITIES:
            raise SchemaError(f"{e.name}: unknown cardinality")
    for place, n in enumerate(schema.nodes):
        if len({p.name for p in n.properties}) != len(n.properties):
            raise SchemaError(f"{n.name}: property names must be unique")
        if not n.key:
            raise SchemaError(f"{n.name}: a node needs an identity")
        own = {p.name for p in n.properties}
        for part in n.key:
            if part in own:
                continue
            e = schema.edge(part)
            if e.source != n.name:
                raise SchemaError(f"{part}: a key edge starts at its node")
            if e.to_card != "1":
                raise SchemaError(f"{part}: a key edge leads to exactly one node")
            if e.target == n.name:
                raise SchemaError(f"{part}: a key edge cannot be reflexive")
            if e.properties:
                raise SchemaError(f"{part}: a key edge has no properties")
            if e.target not in names[:place]:
                raise SchemaError(f"{part}: the target of a key edge is listed before its node")


def nest_key(schema: Schema, node: str, values: list) -> list:
    """Lay flat key values onto the tree of the identity: parents' keys become nested lists."""
    flat = list(values)
    width = len(schema.key_columns(node))
    if len(flat) != width:
        raise ValueError(f"{node} has {width} key values, not {len(flat)}")

    def take(name: str) -> list:
        n = schema.node(name)
        own = {p.name for p in n.properties}
        return [flat.pop(0) if part in own else take(schema.edge(part).target) for part in n.key]

    return take(node)
