"""Writers that are late, lost or repeated; migrations under readers; slices of stored graphs."""

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import ranges as R
from palimpsest.operators.migrate import MigrationError, add_key_property, add_rows, migrate, remove_element, rename_element
from palimpsest.operators.store import Store
from palimpsest.plans import traversal as t
from palimpsest.plans.schema import Edge, Node, Property, Schema
from palimpsest.sources import render
from palimpsest.sources.archives import import_and_file, import_archive

from .test_store import CSV, WEAK, A, AB, B, _load, _rows, _zip

P = Property
ONE = Schema((Node("N", (P("k", "int"), P("v", "string")), ("k",)),))
ROW = "k0 int, p_v string"


def test_a_late_writer_harms_nobody(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/s"
    first, late = Store(spark, root, ONE), Store(spark, root, ONE)
    first.load({"N": _load(spark, ROW, [(1, "a")])})
    seen = Store.version
    with monkeypatch.context() as m:
        m.setattr(Store, "version", lambda self: 1 if self is late else seen(self))  # opened before version 2 was there
        first.load({"N": _load(spark, ROW, [(1, "b")])})
        for write in (lambda: late.load({"N": _load(spark, ROW, [(1, "c")])}), lambda: late.delete("N", spark.createDataFrame([(1,)], "k0 int"))):
            with pytest.raises(RuntimeError):
                write()
    assert _rows(first, "N") == [(1, "a", 1, 1), (1, "b", 2, R.HEAD)] == _rows(first, "N", 2)
    late.load({"N": _load(spark, ROW, [(1, "c")])})
    assert _rows(first, "N") == [(1, "a", 1, 1), (1, "b", 2, 2), (1, "c", 3, R.HEAD)]


def test_a_lost_writer_leaves_nothing_in_the_way(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s", ONE)
    store.load({"N": _load(spark, ROW, [(1, "a")])})

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", crash)
        with pytest.raises(KeyboardInterrupt):
            store.load({"N": _load(spark, ROW, [(1, "lost")])})
    assert store.version() == 1 and _rows(store, "N") == [(1, "a", 1, R.HEAD)]
    store.load({"N": _load(spark, ROW, [(1, "b")])})
    assert _rows(store, "N") == [(1, "a", 1, 1), (1, "b", 2, R.HEAD)]
    assert store.vacuum(keep=2, min_age_s=-60) == 1 and _rows(store, "N", 1) == [(1, "a", 1, R.HEAD)]
    assert store.vacuum(keep=1, min_age_s=-60) == 1 and len(_rows(store, "N")) == 2


def test_an_import_is_applied_once(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s", CSV)
    path = _zip(tmp_path / "a.zip", {"Node": "ID,Prop\n1,a\n"})
    import palimpsest.sources.archives as archives

    def crash(*_, **__):
        raise KeyboardInterrupt

    real = archives.import_archive
    with monkeypatch.context() as m:  # killed after the version was published and before the archive was filed
        m.setattr(archives, "import_archive", lambda *a: (real(*a), crash()))
        with pytest.raises(KeyboardInterrupt):
            import_and_file(store, path, f"file://{tmp_path}/in")
    assert store.version() == 1
    out = io.StringIO()
    with redirect_stdout(out):
        import_and_file(store, path, f"file://{tmp_path}/in")
        import_and_file(store, path, f"file://{tmp_path}/in")
    assert store.version() == 1 and (tmp_path / "in/imported/1.zip").exists() and not out.getvalue()
    import_archive(store, _zip(tmp_path / "b.zip", {"Node": "ID,Prop\n1,b\n"}))
    assert store.version() == 2


def test_migration_under_a_pinned_reader(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", ONE)
    store.load({"N": _load(spark, ROW, [(1, "a"), (2, "x")])})
    store.load({"N": _load(spark, ROW, [(1, "b")])})
    pinned, before = store.read(2), _rows(store, "N", 2)
    new = Schema((Node("N", (P("k", "int"), P("w", "long")), ("k",)),))
    after = migrate(store, new, {("N", "w"): 3})
    assert _rows(after, "N") == [(1, 3, 1, 1), (1, 3, 2, R.HEAD), (2, 3, 1, 1)]
    assert _rows(store, "N", 2) == before and pinned.nodes["N"].df.count() == 2 and _rows(store, "N", 1) == [(1, "a", 1, R.HEAD), (2, "x", 1, R.HEAD)]
    add_rows(after, "N", spark.createDataFrame([(2, 9, 5, 6)], "k0 int, p_w long, f int, t int"))
    for clash in ((1, 9, 0, 1), (1, 9, 2, 2), (1, 9, 7, R.HEAD), (5, 9, 3, 2)):
        with pytest.raises(MigrationError):
            add_rows(after, "N", spark.createDataFrame([clash], "k0 int, p_w long, f int, t int"))
    rename_element(after, "N", "M")
    moved = Store(spark, after.root, Schema((Node("M", (P("k", "int"), P("w", "long")), ("k",)),)))
    assert (2, 9, 5, 6) in _rows(moved, "M") and _rows(moved, "M", 3) == []
    with pytest.raises(MigrationError):
        rename_element(after, "N", "L")
    remove_element(moved, "M")
    assert _rows(moved, "M") == [] and len(_rows(moved, "M", moved.version() - 1)) == 4


def test_keys_are_stored_by_name(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    one = Schema((Node("N", (P("a", "string"), P("b", "string"), P("v", "int")), ("a", "b")),), (Edge("e", "N", "N", (), "*", "*"),))
    two = Schema((Node("N", (P("a", "string"), P("b", "string"), P("v", "int")), ("b", "a")),), (Edge("e", "N", "N", (), "*", "*"),))
    store = Store(spark, root, one)
    store.load({"N": _load(spark, "k0 string, k1 string, p_v int", [("x", "y", 1)]), "e": _load(spark, "s0 string, s1 string, d0 string, d1 string", [("x", "y", "x", "y")])})
    turned = migrate(store, two)
    row = turned.read().nodes["N"].df.first()
    assert (row["p_a"], row["p_b"], row["k0"], row["k1"]) == ("x", "y", "y", "x")
    assert t.paths(turned.read(), t.V("N") >> t.out("e")).count() == 1
    turned.load({"N": _load(spark, "k0 string, k1 string, p_v int", [("y", "x", 2)])})
    assert _rows(turned, "N") == [("y", "x", 1, 1, 1), ("y", "x", 2, 2, R.HEAD)]
    assert _rows(store, "N") == [("x", "y", 1, 1, 1), ("x", "y", 2, 2, R.HEAD)]
    with pytest.raises(ValueError):
        Store(spark, root, Schema((Node("N", (P("a", "string"), P("v", "int")), ("a",)),))).rows("N")


def _filters(df):
    return re.findall(r"(?:PushedFilters|DataFilters): \[([^\]]*)\]", df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))


def test_slices_of_a_stored_graph(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", WEAK)
    for k in range(6):
        store.load({"B": _load(spark, B, [("b",), ("c",)]), "A": _load(spark, A, [("a", "b", f"d{k // 2}")] + ([("z", "c", "q")] if k != 3 else [])), "ab": _load(spark, AB, [("a", "b", "c", f"x{k // 3}")])})
    whole = store.read()
    for a, b in ((1, 1), (2, 4), (3, 3), (4, 6), (9, 9)):
        for kind, name in (("nodes", "A"), ("nodes", "B"), ("edges", "ab"), ("edges", "ref")):
            of = getattr(whole, kind)[name]
            wanted = {r["id"]: [tuple(x) for x in r["rs"]] for r in of.df.withColumn("rs", R.isect(of.rs(), R.ranges((a, b)))).filter(F.size("rs") > 0).collect()}
            cut = getattr(whole, f"{kind}_at")(name, ((a, b),))
            assert {r["id"]: [tuple(x) for x in r["rs"]] for r in cut.collect()} == wanted
            part = getattr(store.read(within=(a, b)), kind)[name]
            assert {r["id"]: [tuple(x) for x in r["rs"]] for r in part.df.withColumn("rs", part.rs()).collect()} == wanted
            if a == b and wanted:
                assert part.single and part.constant == frozenset(part.properties)
    sliced = store.read(within=(3, 3)).nodes["A"].df
    plan = sliced._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and all("f" in x and "t" in x for x in _filters(sliced) if x) and any("LessThanOrEqual(f,3)" in x for x in _filters(sliced))
    assert any("LessThanOrEqual(f,4)" in x for x in _filters(whole.nodes_at("A", ((2, 4),))))
    found = t.paths(store.read(within=(3, 3)), t.V("A") >> t.where("data", lambda v: v == "d1") >> t.out("ref") >> t.ex("id")).collect()
    assert len(found) == 1 and found[0]["id"][0][0]["v"] == "b"
    assert whole.nodes_at("A", ((9, 9), (11, 12))).count() == 1 + 1 and store.read(within=(2, 3)).nodes_at("A", ((5, 6),)).count() == 0


def test_edges_once_and_key_edges_follow_their_node(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", WEAK)
    store.load({"B": _load(spark, B, [("b",)]), "A": _load(spark, A, [("a", "b", "x")]), "ab": _load(spark, AB, [("a", "b", "b", "one"), ("a", "b", "b", "two")])})
    assert _rows(store, "ab") == [("a", "b", "b", "one", 1, R.HEAD)]  # one edge for a type and two ends
    store.load({"A": _load(spark, A, [])})
    store.load({"A": _load(spark, A, [("a", "b", "y")])})
    of = store.read().edges["ref"]
    assert [tuple(r) for r in of.df.withColumn("rs", of.rs()).first()["rs"]] == [(1, 1), (3, R.HEAD)]
    of = store.read().edges["ab"]
    assert [tuple(r) for r in of.df.withColumn("rs", of.rs()).first()["rs"]] == [(1, R.HEAD)]


def test_renderers(spark, sf_dir):
    import xml.dom.minidom

    from palimpsest.sources.sample import SCHEMA, sample_graph

    g = sample_graph(spark, sf_dir)
    df = t.paths(g, t.V("Nation") >> t.out("in_region"))
    doc = xml.dom.minidom.parseString(render.paths_graphml(df.unionByName(df)))
    edges = doc.getElementsByTagName("edge")
    weights = [d.firstChild.data for e in edges for d in e.getElementsByTagName("data") if d.getAttribute("key") == "weight"]
    assert edges.length == 25 and weights == ["2"] * 25 and doc.getElementsByTagName("node").length == 30
    assert render.paths_dot(df).count(" -> ") == 25 and render.paths_dot(df.unionByName(df)).count(" -> ") == 50
    merged = render.paths_dot_aggregated(df.unionByName(df))
    assert merged.count(" -> ") == 25 and 'penwidth="1.41"' in merged
    assert render.schema_dot(SCHEMA).count(" -> ") == len(SCHEMA.edges) and "# c_custkey" in render.schema_dot(SCHEMA)
    for dot in (merged, render.schema_dot(SCHEMA), render.paths_dot(df, 'a "b"')):
        assert dot.count("{") == dot.count("}") == 1 and len(re.findall(r'(?<!\\)"', dot)) % 2 == 0
    assert render.table_csv(spark.range(3), limit=None).splitlines() == ["id", "0", "1", "2"]
    with pytest.raises(render.TooLarge):
        render.table_csv(spark.range(3), limit=2)
    with pytest.raises(ValueError):
        render.draw(merged, "png")


def test_repetition_without_a_bound(spark, sf_dir):
    from palimpsest.plans.traversal import TraversalError
    from palimpsest.sources.sample import sample_graph

    g = sample_graph(spark, sf_dir)
    assert t.paths(g, t.V("Region") >> t.out("ring").many()).count() == 40
    with pytest.raises(TraversalError):
        t.paths(g, t.V("Region") >> t.out("ring").many(3))


def test_one_element(spark, sf_dir):
    from palimpsest.sources.sample import sample_graph

    g = sample_graph(spark, sf_dir)
    assert g.element_within("node", "Order", 1, ((100_000, 100_001),)).count() <= 1
    assert g.element_within("node", "Customer", 1, ((3, 4),)).first()["rs"][0].asDict() == {"f": 3, "t": 4}
    assert g.element_within("node", "Customer", -5, ((3, 4),)).count() == 0
    with pytest.raises(ValueError):
        g.element_exactly("node", "Customer", 1, ())
    assert {(r["kind"], r["type"]) for r in g.element_type(1).collect()} >= {("node", "Customer"), ("node", "Order"), ("edge", "ring")}


def test_jobs_age_and_run_again(spark, tmp_path):
    from palimpsest.jobs import JobManager

    store = Store(spark, f"file://{tmp_path}/s", ONE)
    store.load({"N": _load(spark, ROW, [(1, "a")])})
    jobs = JobManager(spark, store.read, store.version, keep=2)
    first = jobs.submit(t.V("N"))
    assert jobs.result(first).count() == 1
    store.load({"N": _load(spark, ROW, [(1, "a"), (2, "b")])})
    assert jobs.result(first).count() == 1 and jobs.result(first, newest=True).count() == 2 and jobs.info(first)["version"] == 2
    for _ in range(4):
        jobs.result(jobs.submit(t.V("N")))
    assert jobs.count() <= 3
    jobs.close()


def test_a_key_property_for_all_history(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", WEAK)
    store.load({"B": _load(spark, B, [("b",)]), "A": _load(spark, A, [("a", "b", "x")]), "ab": _load(spark, AB, [("a", "b", "b", "p")])})
    store.load({"A": _load(spark, A, [("a", "b", "y")])})
    new = Schema((Node("B", (P("id", "string"), P("site", "int")), ("id", "site")), WEAK.nodes[1]), WEAK.edges)
    after = add_key_property(store, new, "B", "site", 7)
    assert _rows(after, "B") == [("b", 7, 1, R.HEAD)] and _rows(after, "A") == [("a", "b", 7, "x", 1, 1), ("a", "b", 7, "y", 2, R.HEAD)]
    assert t.paths(after.read(), t.V("A") >> t.out("ab") >> t.where("site", lambda v: v == 7)).count() == 1
    assert _rows(store, "A", 2) == [("a", "b", "x", 1, 1), ("a", "b", "y", 2, R.HEAD)]
    with pytest.raises(MigrationError):
        add_key_property(after, new, "B", "site", 8)


def test_drawing(tmp_path, monkeypatch):
    stub = tmp_path / "dot"
    stub.write_text('#!/bin/sh\nread first\necho "$1 $first"\n')
    stub.chmod(0o755)
    monkeypatch.setenv("PATH", str(tmp_path), prepend=":")
    assert render.draw("digraph paths {\n}", "svg") == b"-Tsvg digraph paths {\n"
    for bad in (("png", "dot"), ("svg", "neato")):
        with pytest.raises(ValueError):
            render.draw("digraph x {}", *bad)
