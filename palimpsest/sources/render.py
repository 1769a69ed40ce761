"""Tables, paths and schemas as JSON, CSV, DOT and GraphML text.

Renderers are for results that a person looks at: they collect, and refuse more rows than ``limit`` (``None`` for no bound).
Large tables go out through ``write_csv`` and ``write_json``, which stay distributed.
"""

from __future__ import annotations

import csv
import html
import io
import json
import math
import subprocess

from pyspark.sql import DataFrame, functions as F

from ..functions.ranges import HEAD
from ..operators.paths import distinct_elements, weighted_edges
from ..plans.graph import Graph
from ..plans.schema import Edge, Node, Schema

LIMIT = 100_000


class TooLarge(ValueError):
    pass


def _collect(df: DataFrame, limit: int | None) -> list:
    if limit is None:
        return df.collect()
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooLarge(f"more than {limit} rows; write the table instead")
    return rows


def _plain(value):
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list | tuple):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    return value if value is None or isinstance(value, bool | int | float | str) else value.isoformat() if hasattr(value, "isoformat") else str(value)


# -- tables


def table_csv(df: DataFrame, limit: int | None = LIMIT) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    for row in _collect(df, limit):
        writer.writerow(["" if v is None else json.dumps(_plain(v), ensure_ascii=False) if isinstance(v, list | dict | tuple) else v for v in row])
    return out.getvalue()


def table_json(df: DataFrame, timings=(), limit: int | None = LIMIT) -> str:
    rows = [[_plain(v) for v in row] for row in _collect(df, limit)]
    return json.dumps({"resultType": "Table", "columnNames": df.columns, "columnTypes": [t for _, t in df.dtypes], "rows": rows, "timings": _timings(timings)}, ensure_ascii=False)


def _timings(timings) -> list[dict]:
    return [{"phase": phase, "ms": ms} for phase, ms in timings]


def write_csv(df: DataFrame, path: str) -> None:
    """A distributed CSV; nested columns as JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*flat).write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


# -- paths


def _number(e) -> str:
    """An element's id, negative for an edge walked backwards."""
    return f"-{e['id']}" if e["kind"] == "edge" and not e["fwd"] else str(e["id"])


def paths_json(paths: DataFrame, graph: Graph | None = None, timings=(), limit: int | None = LIMIT) -> str:
    """Paths from the root, labels with all ranges of each value, and what is known of each element on them."""
    labels = [c for c in paths.columns if c not in ("path", "rs", "value")]
    rows = _collect(paths, limit)
    info = [_plain(r) for r in _collect(distinct_elements(paths), limit)]
    if graph is not None:
        for e in info:
            e["identity"] = identity(graph, e["kind"], e["type"], e["id"])
    body = {"resultType": "Paths", "paths": [[_number(e) for e in r["path"]] for r in rows], "labels": [{n: _plain(r[n]) for n in labels} for r in rows], "elementInfo": info, "timings": _timings(timings)}
    return json.dumps(body, ensure_ascii=False)


def identity(graph: Graph, kind: str, type_name: str, element_id) -> dict:
    """Values that identify a node, its parents' included, or the ends of an edge."""
    of = (graph.nodes if kind == "node" else graph.edges)[type_name]
    row = of.df.filter(F.col("id") == element_id).limit(1).collect()
    if not row:
        return {}
    if kind == "edge":
        return {"from": _plain(row[0]["src"]), "to": _plain(row[0]["dst"])}
    columns = [f"k{i}" for i in range(len(graph.schema.key_columns(type_name)))]
    names = [label for label, _ in graph.schema.key_columns(type_name)]
    if not set(columns) <= set(of.df.columns):
        names = [p for p in of.properties if p in of.constant]
        columns = [f"p_{p}" for p in names]
    return {n: _plain(row[0][c]) for n, c in zip(names, columns)}


def element_json(graph: Graph, kind: str, type_name: str, element_id) -> str:
    """One element with its validity and the history of every property."""
    of = (graph.nodes if kind == "node" else graph.edges)[type_name]
    rows = of.df.filter(F.col("id") == element_id).withColumn("_rs", of.rs()).limit(1).collect()
    if not rows:
        return json.dumps(None)
    row = rows[0]
    body = {"kind": kind, "type": type_name, "id": element_id, "versions": _plain(row["_rs"]), "validAtHead": any(r["t"] == HEAD for r in row["_rs"]), "identity": identity(graph, kind, type_name, element_id), "properties": {p: _plain(row[f"p_{p}"]) for p in of.properties}}
    return json.dumps(body, ensure_ascii=False, default=str)


def _q(text: str) -> str:
    return '"' + str(text).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def _hops(path: list) -> list[tuple]:
    """(from, edge, to) along a path; an end without a node is ``pseudo``."""
    out = []
    for i, e in enumerate(path):
        if e["kind"] == "edge":
            before = path[i - 1]["id"] if i and path[i - 1]["kind"] == "node" else "pseudo"
            after = path[i + 1]["id"] if i + 1 < len(path) and path[i + 1]["kind"] == "node" else "pseudo"
            out.append((before, e, after) if e["fwd"] else (after, e, before))
    return out


def _fields(**values) -> str:
    return "[" + ", ".join(f"{k}={_q(v)}" for k, v in values.items() if v != "") + "]"


def _hue(n: int) -> str:
    """The n-th of any number of hues, each far from those before it (steps of the golden ratio)."""
    return f"{n * 0.61803398875 % 1:.4f} 0.65 0.80"


def _dot_frame(paths: list, label: str | None) -> list[str]:
    """The opening lines and the nodes: rounded boxes, the type over the id; ``pseudo`` stands for an unknown end."""
    nodes = {(e["type"], e["id"]) for p in paths for e in p if e["kind"] == "node"}
    lines = ["digraph paths {", f"  node {_fields(shape='box', style='rounded', fontname='Helvetica')};", f"  edge {_fields(fontname='Helvetica', fontsize='10')};"]
    if label:
        lines.append(f"  graph {_fields(label=label, labelloc='t')};")
    lines += [f"  {_q(i)} {_fields(label=f'{t} {i}', tooltip=t)};" for t, i in sorted(nodes, key=str)]
    if any("pseudo" in (a, b) for p in paths for a, _, b in _hops(p)):
        lines.append(f"  pseudo {_fields(label='?', style='dashed')};")
    return lines


def paths_dot(paths: DataFrame, label: str | None = None, limit: int | None = LIMIT) -> str:
    """Every path in a colour of its own."""
    rows = [r["path"] for r in _collect(paths.select("path"), limit)]
    lines = _dot_frame(rows, label)
    for n, p in enumerate(rows):
        lines += [f"  {_q(a)} -> {_q(b)} {_fields(label=e['type'], color=_hue(n))};" for a, e, b in _hops(p)]
    return "\n".join([*lines, "}"])


def paths_dot_aggregated(paths: DataFrame, label: str | None = None, limit: int | None = LIMIT) -> str:
    """Each edge once: as wide as the root of its weight, coloured by the shares of the paths that walk it."""
    rows = [r["path"] for r in _collect(paths.select("path"), limit)]
    weights = _collect(weighted_edges(paths), limit)
    key = lambda w: (w["path_id"]["h"], w["path_id"]["copy"])
    hue = {i: _hue(n) for n, i in enumerate(sorted({key(w) for r in weights for w in r["paths"]}))}
    ends = {json.dumps(_plain(e), sort_keys=True): (a, b) for p in rows for a, e, b in _hops(p)}
    lines = _dot_frame(rows, label)
    for name, r in sorted((json.dumps(_plain(r["edge"]), sort_keys=True), r) for r in weights):
        a, b = ends[name]
        shares = sorted((hue[key(w)], w["weight"] / r["weight"]) for w in r["paths"])
        lines.append(f"  {_q(a)} -> {_q(b)} {_fields(label=r['edge']['type'] + ' × ' + str(r['weight']), color=':'.join(f'{h};{share:.4f}' for h, share in shares), penwidth=f'{math.sqrt(r['weight']):.2f}')};")
    return "\n".join([*lines, "}"])


def paths_graphml(paths: DataFrame, name: str = "paths", limit: int | None = LIMIT) -> str:
    rows = [r["path"] for r in _collect(paths.select("path"), limit)]
    hops = [h for p in rows for h in _hops(p)]
    text = lambda x: html.escape(str(x), quote=True)
    nodes = sorted({(e["type"], e["id"]) for p in rows for e in p if e["kind"] == "node"}, key=str)
    lines = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="label" for="all" attr.name="label" attr.type="string"/>', '<key id="weight" for="edge" attr.name="weight" attr.type="int"><default>1</default></key>', f'<graph id="{text(name)}" edgedefault="directed">']
    lines += [f'<node id="{text(i)}"><data key="label">{text(t)}</data></node>' for t, i in nodes]
    if any("pseudo" in (a, b) for a, _, b in hops):
        lines.append('<node id="pseudo"/>')
    weight: dict[tuple, int] = {}
    for a, e, b in hops:  # an edge that several paths walk is one edge with their number
        weight[a, e["type"], e["id"], b] = weight.get((a, e["type"], e["id"], b), 0) + 1
    for (a, kind, _, b), n in sorted(weight.items(), key=str):
        lines.append(f'<edge source="{text(a)}" target="{text(b)}"><data key="label">{text(kind)}</data><data key="weight">{n}</data></edge>')
    return "\n".join([*lines, "</graph>", "</graphml>"])


def draw(dot: str, kind: str = "svg", layout: str = "dot", timeout: int = 60) -> bytes:
    """Run Graphviz, where it is installed, to make SVG or PDF of DOT text."""
    if kind not in ("svg", "pdf") or layout not in ("dot", "sfdp"):
        raise ValueError("svg or pdf, by dot or sfdp")
    return subprocess.run([layout, f"-T{kind}"], input=dot.encode(), capture_output=True, check=True, timeout=timeout).stdout


# -- schemas


def _element(schema: Schema, e: Node | Edge) -> dict:
    keys = set(e.key) if isinstance(e, Node) else set()
    body = {"name": e.name, "description": e.desc, "properties": [{"name": p.name, "type": p.kind, "description": p.desc, "isId": p.name in keys} for p in e.properties]}
    if isinstance(e, Edge):
        body |= {"from": e.source, "fromCardinality": e.from_card, "to": e.target, "toCardinality": e.to_card, "isId": schema.is_key_edge(e.name)}
    return body


def schema_json(schema: Schema) -> str:
    enums = sorted({p.kind for e in (*schema.nodes, *schema.edges) for p in e.properties if p.kind.startswith("enum(")})
    return json.dumps({"name": schema.name, "description": schema.desc, "nodes": [_element(schema, n) for n in schema.nodes], "edges": [_element(schema, e) for e in schema.edges], "enums": [{"values": k[5:-1].split("|")} for k in enums]})


def element_schema_json(schema: Schema, name: str) -> str:
    return json.dumps(_element(schema, schema.element(name)))


def schema_meta(schema: Schema) -> dict:
    return {"name": schema.name, "description": schema.desc, "nodeCount": len(schema.nodes), "edgeCount": len(schema.edges)}


def schema_dot(schema: Schema) -> str:
    """Node types with their properties (``#`` marks keys), edge types with their cardinalities; key edges are bold."""
    lines = [f"digraph {_q(schema.name)} {{", f"  node {_fields(shape='box', fontname='Helvetica')};", f"  edge {_fields(fontname='Helvetica', fontsize='10')};"]
    listed = lambda e, keys=(): [("# " if p.name in keys else "") + f"{p.name}: {p.kind}" for p in e.properties]
    for n in schema.nodes:
        lines.append(f"  {_q(n.name)} {_fields(label=chr(10).join([n.name, *listed(n, n.key)]), tooltip=n.desc)};")
    for e in schema.edges:
        label = "\n".join([f"{e.name} ({e.from_card} to {e.to_card})", *listed(e)])
        lines.append(f"  {_q(e.source)} -> {_q(e.target)} {_fields(label=label, style='bold' if schema.is_key_edge(e.name) else 'solid', tooltip=e.desc)};")
    return "\n".join([*lines, "}"])
