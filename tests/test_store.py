import zipfile

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import ranges as R
from palimpsest.operators.flatten import from_, sql
from palimpsest.operators.migrate import MigrationError, add_rows, difference, migrate, remove_element, rename_element
from palimpsest.operators.store import Load, Store
from palimpsest.plans import traversal as t
from palimpsest.plans.schema import Edge, Node, Property, Schema, SchemaError, nest_key
from palimpsest.sources.archives import ArchiveError, import_and_file, import_archive, template
from palimpsest.streaming.watch import watch

P = Property
WEAK = Schema((Node("B", (P("id", "string"),), ("id",)), Node("A", (P("id", "string"), P("data", "string")), ("id", "ref"))), (Edge("ref", "A", "B"), Edge("ab", "A", "B", (P("prop", "string"),), "*", "*")))


def _load(spark, ddl, rows, mode="full", previous=None):
    return Load(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{ddl}, _n long"), mode, previous)


B, A, AB = "k0 string", "k0 string, k1 string, p_data string", "s0 string, s1 string, d0 string, p_prop string"


def _rows(store, name, version=None):
    return sorted(tuple(r) for r in store.rows(name, version).collect())


def test_history_of_updates_deletes_and_revivals(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", WEAK)
    assert s.version() == 0 and s.read().nodes["A"].df.count() == 0
    s.load({"B": _load(spark, B, [("b",), ("c",)]), "A": _load(spark, A, [("a", "b", "data1")]), "ab": _load(spark, AB, [("a", "b", "c", "x")])})
    s.load({"A": _load(spark, A, [("a", "b", "data2"), ("a", "b", "later")])})
    assert _rows(s, "A") == [("a", "b", "data1", 1, 1), ("a", "b", "data2", 2, R.HEAD)]  # the first change of a version wins
    s.load({"A": _load(spark, A, [])})
    s.load({"A": _load(spark, A, [("a", "b", "data2")], "incremental")})
    assert _rows(s, "A") == [("a", "b", "data1", 1, 1), ("a", "b", "data2", 2, 2), ("a", "b", "data2", 4, R.HEAD)]
    g = s.read()
    row = g.nodes["A"].df.first()
    assert [tuple(r) for r in row["rs"]] == [(1, 2), (4, R.HEAD)] and [tuple(r) for r in row["p_data"]] == [(1, 1, "data1"), (2, 2, "data2"), (4, R.HEAD, "data2")]
    assert [tuple(r) for r in g.edges["ref"].df.first()["rs"]] == [(1, 2), (4, R.HEAD)]  # a key edge lives as its node
    assert [tuple(r) for r in g.edges["ab"].df.first()["rs"]] == [(1, R.HEAD)]  # another edge stays open
    assert _rows(s, "A", 2) == [("a", "b", "data1", 1, 1), ("a", "b", "data2", 2, R.HEAD)]  # an older version reads as it was
    found = t.paths(g, t.V("A") >> t.out("ref") >> t.ex("id")).collect()
    assert len(found) == 1 and found[0]["id"][0][0]["v"] == "b"


def test_missing_parents_and_ends_are_refused(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", WEAK)
    v, refused = s.load({"B": _load(spark, B, [("b",)]), "A": _load(spark, A, [("a", "nope", "x"), ("a", "b", "y")]), "ab": _load(spark, AB, [("a", "b", "b", "x"), ("z", "b", "b", "x")])})
    assert v == 1 and refused["A"].count() == 1 and refused["ab"].count() == 1
    assert _rows(s, "A") == [("a", "b", "y", 1, R.HEAD)] and s.read().edges["ab"].df.count() == 1
    with pytest.raises(ValueError):
        s.load({"ref": _load(spark, "s0 string, s1 string, d0 string", [])})
    assert s.version() == 1


def test_unchanged_rows_and_null_data_stay(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", WEAK)
    for _ in range(2):
        s.load({"B": _load(spark, B, [("b",)]), "A": _load(spark, A, [("a", "b", None)])})
    assert _rows(s, "A") == [("a", "b", None, 1, R.HEAD)]
    s.delete("A", spark.createDataFrame([("a", "b")], "k0 string, k1 string"))
    assert _rows(s, "A") == [("a", "b", None, 1, 2)]


CSV = Schema((Node("Node", (P("ID", "int"), P("Prop", "string")), ("ID",)),), (Edge("Edge", "Node", "Node", (P("Ep", "array<double>"),), "*", "*"),))


def _zip(path, files, config="Node.import=full\nEdge.import = full\n"):
    with zipfile.ZipFile(path, "w") as z:
        if config is not None:
            z.writestr("import.properties", config)
        for name, text in files.items():
            z.writestr(f"{name}.csv", text)
    return f"file://{path}"


def test_archives(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", CSV)
    edges = "Node#ID,Node#ID,Ep\n1,2,\"[1.5,2]\"\n"
    one = _zip(tmp_path / "1.zip", {"Node": 'ID,Prop\n1,a\n2,"x, ""y""\nz"\nbad,b\n3\n', "Edge": edges, "Other": "x\n"})
    report = import_archive(s, one)
    assert report.version == 1 and any("Other" in w for w in report.warnings) and report.rejects["Node"].count() == 2
    assert _rows(s, "Node") == [(1, "a", 1, R.HEAD), (2, 'x, "y"\nz', 1, R.HEAD)]
    assert [r["p_Ep"][0]["v"] for r in s.read().edges["Edge"].df.collect()] == [[1.5, 2.0]]
    two = _zip(tmp_path / "2.zip", {"Node": "ID,Prop\n1,b\n", "Edge": "Node#ID,Node#ID,Ep\n"})
    import_archive(s, two, previous=one)
    assert _rows(s, "Node") == [(1, "a", 1, 1), (1, "b", 2, R.HEAD), (2, 'x, "y"\nz', 1, 1)]
    import_archive(s, _zip(tmp_path / "3.zip", {"Node": "ID,Prop\n4,d\n"}, "Node.import=incremental"))
    assert {r[0] for r in _rows(s, "Node") if r[3] == R.HEAD} == {1, 4}
    assert template(CSV).splitlines() == ["Node.csv:ID,Prop", "Edge.csv:Node#ID,Node#ID,Ep"]


def test_bad_archives_change_nothing(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", CSV)
    for files, config in (({"Node": "ID,Prop\n"}, None), ({"Node": "Prop,ID\n"}, "Node.import=full"), ({"Node": "ID,Prop\n"}, "Node.import=other")):
        with pytest.raises(ArchiveError):
            import_archive(s, _zip(tmp_path / "x.zip", files, config))
    assert s.version() == 0


def test_watched_folder(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", CSV)
    (tmp_path / "in/incoming").mkdir(parents=True)
    _zip(tmp_path / "in/incoming/a.zip", {"Node": "ID,Prop\n1,a\n"})
    _zip(tmp_path / "in/incoming/b.zip", {"Node": "Nope\n"})
    q = watch(s, f"file://{tmp_path}/in", f"file://{tmp_path}/checkpoint", once=True)
    q.awaitTermination(120)
    assert s.version() == 1 and (tmp_path / "in/imported/1.zip").exists() and len(list((tmp_path / "in/failed").glob("*.zip"))) == 1
    with pytest.raises(ArchiveError):
        import_and_file(s, _zip(tmp_path / "c.zip", {"Node": "Nope\n"}), f"file://{tmp_path}/in")


def test_schema_rules():
    n = Node("N", (P("k", "int"),), ("k",))
    m = Node("M", (P("k", "int"),), ("k", "e"))
    Schema((n, m), (Edge("e", "M", "N"),))
    for nodes, edges in [
        ((Node("N", (P("k", "int"),), ()),), ()), ((m, n), (Edge("e", "M", "N"),)), ((n, m), (Edge("e", "N", "M"),)), ((n, m), (Edge("e", "M", "N", (), "*", "*"),)),
        ((n, m), (Edge("e", "M", "N", (P("x", "int"),)),)), ((m,), (Edge("e", "M", "M"),)), ((n,), (Edge("e", "N", "X"),)), ((n, n), ()),
    ]:
        with pytest.raises(SchemaError):
            Schema(nodes, edges)
    s = Schema((n, m), (Edge("e", "M", "N"),))
    assert [c for c, _ in s.header("M")] == ["k", "e>N#k"] and nest_key(s, "M", [1, 2]) == [1, [2]]
    for bad in ([1], [1, 2, 3]):
        with pytest.raises(ValueError):
            nest_key(s, "M", bad)


def test_migration(spark, tmp_path):
    old = Schema((Node("Node", (P("A", "int"), P("B", "string")), ("A",)),))
    s = Store(spark, f"file://{tmp_path}/s", old)
    s.load({"Node": _load(spark, "k0 int, p_B string", [(1, "x")])})
    new = Schema((Node("Node", (P("A", "int"), P("C", "long")), ("A",)), Node("More", (P("A", "int"),), ("A",))), (Edge("to", "Node", "More", (), "?", "?"),))
    change = difference(old, new)
    assert change.added_nodes == ("More",) and [p.name for _, p in change.added_properties] == ["C"] and [p.name for _, p in change.removed_properties] == ["B"]
    after = migrate(s, new, {("Node", "C"): 7})
    assert _rows(after, "Node") == [(1, 7, 1, R.HEAD)] and after.read().nodes["More"].df.count() == 0
    for bad in (
        Schema((Node("Other", (P("A", "int"),), ("A",)),)), Schema((Node("Node", (P("B", "string"),), ("B",)),)), Schema((Node("Node", (P("A", "int"), P("Z", "int")), ("A", "Z")),)),
        Schema((Node("Node", (P("A", "int"), P("B", "string")), ("A",)), Node("M", (P("A", "int"),), ("A",))), (Edge("e", "Node", "M", (), "*", "1"),)),
    ):
        with pytest.raises(MigrationError):
            difference(old, bad)
    add_rows(after, "Node", spark.createDataFrame([(2, 5, 0, 0)], "k0 int, p_C long, f int, t int"))
    assert (2, 5, 0, 0) in _rows(after, "Node")
    rename_element(after, "Node", "Renamed")
    remove_element(after, "Renamed")
    assert _rows(after, "Node") == []


def test_tables_and_sql(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", WEAK)
    s.load({"B": _load(spark, B, [("b",)]), "A": _load(spark, A, [("a", "b", "x")])})
    g = s.read()
    table = from_(t.V("A") >> t.ex_all("A.")).extract("A.data", "A.id")
    assert table.run(g).columns == ["A.data", "A.id", "VERSION.FROM", "VERSION.TO"]
    assert [tuple(r) for r in table.sql("select A_data, VERSION_FROM, 't1' as name from t1").sql("select count(*) as n, max(name) as m from t1").run(g).collect()] == [(1, "t1")]
    assert from_(t.V("A") >> t.fail() >> t.ex("data")).extract().sql().run(g).count() == 0  # an empty table can be queried
    with pytest.raises(ValueError):
        from_(t.V("A") >> t.ex("data")).extract("nothing").run(g)
    with pytest.raises(ValueError):
        sql(spark.range(1), "create table x as select * from t1")
    assert sql(spark.range(1), "SELECT * FROM (VALUES(1.0)) AS v(c1)").first()["c1"] == 1
    assert from_(t.V("A")).extract().run(g).count() == 0
    assert table.run(g).filter(F.col("`VERSION.TO`") == R.HEAD).count() == 1
