import random

import pytest
from pyspark.sql import functions as F

from palimpsest import queries
from palimpsest.functions import ranges as R
from palimpsest.plans import traversal as t
from palimpsest.plans.graph import Elements, Graph
from palimpsest.plans.schema import Edge, Node, Property, Schema
from palimpsest.sources.sample import sample_graph

from . import brute as b
from .helpers import assert_same

SCHEMA = Schema((Node("N", (Property("key", "long"), Property("p", "int")), ("key",)),), (Edge("e", "N", "N", (), "*", "*"),))


def _ranges(r):
    at, out = r.randrange(3), []
    for _ in range(r.randrange(1, 3)):
        f = at + r.randrange(2)
        to = f + r.randrange(1, 6)
        out.append((f, to))
        at = to + 2
    if r.random() < 0.4:
        out[-1] = (out[-1][0], b.HEAD)
    return out


def _graph(spark, seed, single=False):
    r = random.Random(seed)
    nodes = {i: _ranges(r)[: 1 if single else 2] for i in range(5)}
    hist = {i: [(f, t_, r.randrange(3)) for f, t_ in rs] for i, rs in nodes.items()}
    edges = {}
    for e in range(7):
        s, d = r.randrange(5), r.randrange(5)
        if not any((x[0], x[1]) == (s, d) for x in edges.values()):
            edges[e] = (s, d, _ranges(r)[: 1 if single else 2])
    if single:
        n = spark.createDataFrame([(i, i, nodes[i][0][0], nodes[i][0][1]) for i in nodes], "id long, p_key long, f int, t int")
        e = spark.createDataFrame([(k, s, d, rs[0][0], rs[0][1]) for k, (s, d, rs) in edges.items()], "id long, src long, dst long, f int, t int")
        g = Graph(SCHEMA, {"N": Elements(n, True, frozenset(["key"]), ("key",))}, {"e": Elements(e, True, frozenset(), ())}, spark)
    else:
        n = spark.createDataFrame([(i, i, [(f, to, v) for f, to, v in hist[i]], nodes[i]) for i in nodes], "id long, p_key long, p_p array<struct<f:int,t:int,v:int>>, rs array<struct<f:int,t:int>>")
        e = spark.createDataFrame([(k, s, d, rs) for k, (s, d, rs) in edges.items()], "id long, src long, dst long, rs array<struct<f:int,t:int>>")
        g = Graph(SCHEMA, {"N": Elements(n, False, frozenset(["key"]), ("key", "p"))}, {"e": Elements(e, False, frozenset(), ())}, spark)
    return g, b.G(nodes, edges, hist)


def _mine(df):
    return sorted((tuple((e["kind"], e["id"], e["fwd"], tuple((x["f"], x["t"]) for x in e["rs"])) for e in r["path"]), tuple((x["f"], x["t"]) for x in r["rs"])) for r in df.collect())


def _theirs(g, way):
    return sorted((s[0], tuple(s[1])) for s, _ in way(g)(b.START))


CASES = {
    "hop": (t.V("N") >> t.out("e") >> t.in_("e"), b.then(b.then(b.V(), b.out), b.in_)),
    "choice": (t.V("N") >> (t.out("e") | t.in_("e")), b.then(b.V(), b.choice(b.out, b.in_))),
    "opt": (t.V("N") >> t.out("e").opt() >> t.in_("e").opt(), b.then(b.then(b.V(), b.opt(b.out)), b.opt(b.in_))),
    "intersect": (t.V("N") >> t.intersect((2, 3), (4, 6)) >> t.out("e"), b.then(b.then(b.V(), b.intersect((2, 3), (4, 6))), b.out)),
    "star": (t.V("N") >> t.out("e").many(), b.then(b.V(), b.many(b.out))),
    "plus": (t.V("N") >> (t.out("e") | t.in_("e")).many1(), b.then(b.V(), b.many1(b.choice(b.out, b.in_)))),
    "nested": (t.V("N") >> (t.out("e") >> t.out("e").many()).many1(), b.then(b.V(), b.many1(b.then(b.out, b.many(b.out))))),
    "cross": (t.V("N") >> t.out("e") >> t.V("N"), b.then(b.then(b.V(), b.out), b.V())),
    "take": (t.V("N") >> (t.out("e") | t.in_("e")).take(1), b.then(b.V(), b.take(b.choice(b.out, b.in_), 1))),
}


@pytest.mark.parametrize("single", [False, True])
@pytest.mark.parametrize("name", [c for c in CASES if c not in ("plus", "nested")])
def test_random_graphs(spark, name, single):
    way, model = CASES[name]
    for seed in range(2):
        g, small = _graph(spark, seed, single)
        assert _mine(t.paths(g, way)) == _theirs(small, model), seed


@pytest.mark.parametrize("name", ["plus", "nested"])
def test_repetition_in_choice_and_nested(spark, name):
    way, model = CASES[name]
    g, small = _graph(spark, 5, True)
    small.edges = {k: v for k, v in list(small.edges.items())[:3]}
    e = g.edges["e"]
    g = Graph(g.schema, g.nodes, {"e": Elements(e.df.filter(e.df["id"].isin(*small.edges)), True, e.constant, ())}, spark)
    assert _mine(t.paths(g, way)) == _theirs(small, model)


def test_where_on_histories(spark):
    g, small = _graph(spark, 3)
    way = t.V("N") >> t.where("p", lambda v: v > 0) >> t.out("e")
    assert _mine(t.paths(g, way)) == _theirs(small, b.then(b.then(b.V(), b.where(lambda v: v > 0)), b.out))


def test_sub_and_matches(spark):
    g, small = _graph(spark, 4)
    got = {r["path"][0]["id"]: sorted(x["id"] for x in r["value"]) for r in t.paths(g, t.V("N") >> t.sub(t.out("e"))).collect()}
    assert got == {s[0][0][1]: sorted(v) for s, v in b.then(b.V(), b.sub(b.out))(small)(b.START)}
    got = {r["path"][0]["id"]: r["value"] for r in t.paths(g, t.V("N") >> t.matches(t.out("e"))).collect()}
    assert got == {s[0][0][1]: v for s, v in b.then(b.V(), b.matches(b.out))(small)(b.START)}
    some = {r["path"][0]["id"] for r in t.paths(g, t.V("N") >> t.having(t.out("e"))).collect()}
    assert some == {i for i, v in got.items() if v}


def test_equal_rows_of_a_choice_are_taken_apart(spark):
    g, _ = _graph(spark, 1)
    twice = t.V("N") >> (t.success(1) | t.success(1))
    assert t.paths(g, twice >> t.success(2).take(1)).count() == 10
    assert t.paths(g, twice.take(3)).count() == 3


def test_types_are_checked_when_the_plan_is_built(spark):
    g, _ = _graph(spark, 1)
    with pytest.raises(t.TraversalError):
        t.paths(g, t.out("e"))
    with pytest.raises(t.TraversalError):
        t.paths(g, t.V("N") >> t.in_v())
    with pytest.raises(t.TraversalError):
        t.paths(g, t.V("N") >> t.get("nothing"))
    with pytest.raises(t.TraversalError):
        t.paths(g, t.V("N") >> t.versions().label("x") >> t.added().label("x"))
    with pytest.raises(t.TraversalError):
        t.paths(g, t.V("N") >> t.out_e("e").many())


def test_where_on_a_constant_property_reaches_the_scan(spark, sf_dir):
    from palimpsest.sources.sample import sample_graph

    df = t.paths(sample_graph(spark, sf_dir), t.V("Customer") >> t.where("c_mktsegment", lambda v: v == "BUILDING") >> t.added()).select("value")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "c_name" not in plan


def test_labels_states_and_simple_values(spark):
    g, _ = _graph(spark, 2)
    one = t.V("N") >> t.get("key").map(lambda h: R.by_oldest_value(h)).label("k") >> t.out("e") >> t.get_label("k")
    assert all(r["value"] == [r["path"][0]["id"]] for r in t.paths(g, one).collect())
    assert all(r["value"] == [] for r in t.paths(g, t.V("N") >> t.get_label("none")).collect())
    assert t.paths(g, t.V("N") >> t.fail()).count() == 0
    assert {r["value"] for r in t.paths(g, t.V("N") >> t.success("x")).collect()} == {"x"}
    state = t.paths(g, t.V("N") >> t.get_state()).first()["value"]
    assert state["path"][0]["kind"] == "node" and state["rs"]


def _rows(df):
    return sorted(str(x) for x in df.collect())


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize(
    ("before", "hops"),
    [
        (t.V("Customer") >> t.out("in_nation"), [("from_nation", False), ("from_nation", True)]),
        (t.V("Customer"), [("placed_by", False), ("contains", True)]),  # ranges of edges meet or do not
        (t.V("Customer") >> t.intersect((5, 20)), [("placed_by", False), ("placed_by", True)]),
        (t.V("Customer") >> t.intersect((2, 4), (9, 30)), [("placed_by", False)]),  # several ranges before one
        (t.V("User"), [("is_customer", True), ("placed_by", False), ("contains", True)]),
        (t.V("Order"), [("placed_by", True), ("is_customer", False)]),  # one range before several
        (t.V("Nation") >> (t.in_("from_nation") >> t.out("from_nation")).opt(), [("in_region", True)]),  # paths of two lengths
    ],
)
def test_chain_is_the_hops_in_turn(spark, sf_dir, before, hops, parts):
    g = sample_graph(spark, sf_dir)
    plain = before
    for name, forward in hops:
        plain = plain >> (t.out(name) if forward else t.in_(name))
    wanted = _rows(t.paths(g, plain.label("x") >> t.get_label("x")))
    assert wanted and _rows(t.paths(g, (before >> t.chain(*hops, parts=parts)).label("x") >> t.get_label("x"))) == wanted


def test_chain_refuses_what_the_hops_refuse(spark, sf_dir):
    for hops in ([("from_nation", True)], [("in_nation", False), ("from_nation", True)]):
        with pytest.raises(t.TraversalError):
            t.paths(sample_graph(spark, sf_dir), t.V("Nation") >> t.chain(*hops))


def test_label_self_join_multiplies_last_and_in_many_tasks(spark, sf_dir):
    df = queries.QUERIES["label_self_join"](spark, sf_dir)
    assert_same(df, queries.ORACLES["label_self_join"], sf_dir)
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 1  # 25 nations, one file of customers
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "concat(" not in plan and "array_contains(" not in plan  # nothing is built for each row


def test_same_as_compares_whole_values(spark, sf_dir):
    g = sample_graph(spark, sf_dir)
    there = t.V("Nation").label("n") >> t.in_("from_nation")
    found = lambda way: {x["value"] for x in t.paths(g, way).select("value").collect()}
    assert found(there >> t.out("from_nation").same_as("n")) == {True}
    assert found(there >> t.out("from_nation") >> t.path().map(lambda p: p[0]).same_as("n")) == {True}
    assert found(t.V("Nation").label("n") >> t.intersect((3, 4)) >> t.in_("from_nation") >> t.out("from_nation").same_as("n")) == {False}  # fewer versions
    assert found((there >> t.out("from_nation") >> t.out("in_region")).same_as("n")) == {False}  # another type, ids may agree


def test_a_step_of_a_user_may_change_the_path(spark, sf_dir):
    cut = t.update_state(lambda fr: fr.set(fr.df.withColumn("path", F.slice("path", 3, 1))))
    df = t.paths(sample_graph(spark, sf_dir), t.V("Customer") >> t.out("in_nation") >> cut >> t.out("in_region"))
    assert {tuple(e["type"] for e in x["path"]) for x in df.collect()} == {("Nation", "in_region", "Region")}
