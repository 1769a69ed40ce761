"""Traversals: a small algebra whose plans compile to DataFrames.

A traversal takes a frame of paths to a frame of paths.  A frame has one row for each path: the elements walked
(``path``, first to last), the id of the head (``hid``), the ranges in which the head is reached, a column for each
label and the current value (``result``).  Paths, labels and properties that nothing reads later are pruned by the
optimizer, so a plan may carry them freely.  As long as every element on the way has one range only, ranges are two
integer columns (``f``, ``t``) and hops are plain equi-joins; otherwise they are the array ``rs``.

While a path has as many elements in every row they are columns too (``items``), and ``path`` is an array of these: who
reads one part of one element reads that part only, however many joins lie between.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from ..functions import ranges as R
from ..operators.tables import materialize
from .graph import Elements, Graph

_serial = count(1)


class TraversalError(ValueError):
    pass


@dataclass(frozen=True)
class Frame:
    graph: Graph
    df: DataFrame
    head: tuple[str, str] | None = None  # ("node" or "edge", type)
    single: bool = True
    attached: bool = False  # the head's properties are columns ``p_<name>``
    labels: tuple[str, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()  # columns, ascending
    start: bool = False  # the one empty path
    keep: tuple[str, ...] = ()  # columns of enclosing operators
    history: bool = False  # the value is a history
    items: tuple[str, ...] | None = None  # columns of the path's elements; None: rows may differ in length
    once: tuple[str, ...] = ()  # labels with exactly one value in every row, which is the column ``v_<name>``

    def rs(self) -> Column:
        return F.array(R.span(F.col("f"), F.col("t"))) if self.single else F.col("rs")

    def set(self, df: DataFrame, **changes) -> Frame:
        return replace(self, df=df, start=False, **changes)

    def value(self, column: Column, history: bool = False) -> Frame:
        return replace(self, df=self.df.withColumn("result", column), history=history)

    def wide(self) -> Frame:
        """The same frame with a range set."""
        if not self.single:
            return self
        return replace(self, df=self.df.withColumn("rs", self.rs()).drop("f", "t"), single=False)

    def narrow_to(self, rs: Column) -> Frame:
        """Restrict the head to ``rs``, already cut to its ranges; paths with nothing left go."""
        df = self.df.withColumn("rs", rs).filter(F.size("rs") > 0)
        return replace(self, df=df.drop("f", "t") if self.single else df, single=False)

    def walked(self, df: DataFrame, *elements: Column) -> Frame:
        """The frame over ``df`` with these elements put on the path."""
        if self.items is None:
            return self.set(df.withColumn("path", F.concat("path", F.array(*elements))))
        more = tuple(f"at{len(self.items) + i}" for i in range(len(elements)))
        df = df.withColumns(dict(zip(more, elements)))
        return self.set(df.withColumn("path", F.array(*self.items, *more)), items=(*self.items, *more))

    def loose(self) -> Frame:
        """The same frame without columns that hold only while all rows are alike."""
        return replace(self, df=self.df.drop(*(self.items or ()), *(f"v_{n}" for n in self.once)), items=None, once=())

    def head_type(self, kind: str | None = None) -> str:
        if self.head is None or (kind and self.head[0] != kind):
            raise TraversalError(f"needs {'an ' if kind == 'edge' else 'a '}{kind or 'path'} at the head, has {self.head}")
        return self.head[1]

    def table(self) -> Elements:
        kind, name = self.head or (None, None)
        if kind is None:
            raise TraversalError("an empty path has no head")
        return (self.graph.nodes if kind == "node" else self.graph.edges)[name]

    def attach(self) -> Frame:
        """Join the head's properties, once for each head."""
        if self.attached:
            return self
        of = self.table()
        own = of.df.select(F.col("id").alias("_own"), *(f"p_{p}" for p in of.properties))
        base = self.df.drop(*(c for c in self.df.columns if c.startswith("p_")))
        return self.set(base.join(own, base["hid"] == own["_own"]).drop("_own"), attached=True)


def _element(kind: str, name: str, id_: Column, forward: bool, rs: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("type"), id_.alias("id"), F.lit(forward).alias("fwd"), rs.cast(R.RANGES).alias("rs"))


def _path_type(graph: Graph) -> str:
    return f"array<struct<kind:string,type:string,id:{graph.id_type.simpleString()},fwd:boolean,rs:{R.RANGES}>>"


def start(graph: Graph) -> Frame:
    """The frame with the one empty path."""
    one = graph.spark.range(1).select(
        F.array().cast(_path_type(graph)).alias("path"), F.array().cast("array<int>").alias("branch"), F.lit(None).cast(graph.id_type).alias("hid"),
        F.lit(0).alias("f"), F.lit(R.HEAD).alias("t"), F.lit(None).cast("int").alias("result"),
    )
    return Frame(graph, one, start=True, items=())


def _branch(frame: Frame, number: int) -> Frame:
    """Mark which way of a choice a path took: with the path itself this makes rows distinct."""
    return replace(frame, df=frame.df.withColumn("branch", F.concat("branch", F.array(F.lit(number)))))


def _row_id() -> Column:
    """128 bits over what makes a row distinct; the same whenever the row is computed again."""
    return F.struct(F.xxhash64("path", "branch").alias("a"), F.xxhash64(F.lit(1), "branch", "path").alias("b"))


def _match_ranges(frames: list[Frame]) -> list[Frame]:
    return frames if len({f.single for f in frames}) == 1 else [f.wide() for f in frames]


def _union(frames: list[Frame]) -> Frame:
    frames = _match_ranges([f.loose() for f in frames])
    first = frames[0]
    if any(f.head != first.head for f in frames):
        raise TraversalError("the ways of a choice must end at one element type")
    attached = all(f.attached for f in frames)
    plain = [f.df if attached else f.df.drop(*(c for c in f.df.columns if c.startswith("p_"))) for f in frames]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), plain)
    labels = tuple(dict.fromkeys(name for f in frames for name in f.labels))
    return Frame(first.graph, df, first.head, first.single, attached, labels, first.order if all(f.order == first.order for f in frames) else (), False, first.keep, all(f.history for f in frames))


class Traversal:
    """A plan node.  ``then`` may be written ``a >> b``; a choice ``a | b``; filters take ``Column -> Column``."""

    def run(self, frame: Frame) -> Frame:
        raise NotImplementedError

    # -- composition
    def __rshift__(self, other: Traversal) -> Traversal:
        return Then(self, other)

    def __or__(self, other: Traversal) -> Traversal:
        return Choice((self, other))

    def then(self, other: Traversal) -> Traversal:
        return Then(self, other)

    def pair(self, other: Traversal) -> Traversal:
        """Both in turn; the value is the pair of their values."""
        return Pair(self, other, "both")

    def then_keep(self, other: Traversal) -> Traversal:
        """Both in turn; the value is the first one's, the state the second one's."""
        return Pair(self, other, "left")

    def map(self, f: Callable[[Column], Column]) -> Traversal:
        return Then(self, _Own(lambda fr: fr.value(f(F.col("result")))))

    def filter(self, predicate: Callable[[Column], Column]) -> Traversal:
        return Then(self, _Own(lambda fr: fr.set(fr.df.filter(predicate(F.col("result"))))))

    with_filter = filter

    def flat_map(self, f: Callable[[Column], Traversal]) -> Traversal:
        """Go on with the traversal that ``f`` makes of the current value, a column that stays readable in it."""
        return FlatMap(self, f)

    def switch(self, cases: list[tuple[Callable[[Column], Column], Traversal]]) -> Traversal:
        """Go on by the value: each case is a predicate and the traversal for the paths that satisfy it."""
        return Then(self, Switch(tuple(cases)))

    # -- labels
    def label(self, name: str) -> Traversal:
        return Then(self, Label(name))

    def same_as(self, name: str) -> Traversal:
        return Then(self, _Own(lambda fr: _same_as(fr, name)))

    # -- repetition and scoped operators
    def many(self, limit: int | None = None) -> Traversal:
        """Zero or more steps; they end by themselves, ``limit`` refuses more of them."""
        return Repeat(self, True, limit)

    def many1(self, limit: int | None = None) -> Traversal:
        return Repeat(self, False, limit)

    def opt(self) -> Traversal:
        return Opt(self)

    def take(self, n: int) -> Traversal:
        return Take(self, n)

    def ascending(self, key: Callable[[Column], Column] = lambda v: v) -> Traversal:
        return Order(self, key, True)

    def descending(self, key: Callable[[Column], Column] = lambda v: v) -> Traversal:
        return Order(self, key, False)

    # -- temporal filters on the value
    def filter_v(self, predicate: Callable[[Column], Column]) -> Traversal:
        return Then(self, _Own(lambda fr: _filter_v(fr, lambda h: R.normalize(R.keep(h, predicate)))))

    def filter_versioned(self, hit: Callable[[Column], Column]) -> Traversal:
        """Restrict the head to the range set that ``hit`` makes of the value's history."""
        return Then(self, _Own(lambda fr: _filter_v(fr, hit)))

    def subs(self) -> Traversal:
        """One path for each distinct value of the history: value ``struct<rs,v>``, state as before."""
        return Subs(self)


@dataclass(frozen=True)
class Step(Traversal):
    """Any function of frames: how users add traversals of their own."""

    f: Callable[[Frame], Frame]

    def run(self, frame: Frame) -> Frame:
        return self.f(frame.loose())


class _Own(Step):
    """A step of this module, which leaves the path alone or puts elements on it by ``walked``."""

    def run(self, frame: Frame) -> Frame:
        return self.f(frame)


@dataclass(frozen=True)
class Then(Traversal):
    first: Traversal
    second: Traversal

    def run(self, frame: Frame) -> Frame:
        return self.second.run(self.first.run(frame))


@dataclass(frozen=True)
class Pair(Traversal):
    first: Traversal
    second: Traversal
    mode: str

    def run(self, frame: Frame) -> Frame:
        held = f"_v{next(_serial)}"
        one = self.first.run(frame)
        one = replace(one, df=one.df.withColumn(held, F.col("result")), keep=(*one.keep, held))
        two = self.second.run(one)
        left = F.col(held)
        value = F.struct(left.alias("_1"), F.col("result").alias("_2")) if self.mode == "both" else left
        out = two.value(value, self.mode == "left" and one.history)
        return replace(out, df=out.df.drop(held), keep=tuple(k for k in out.keep if k != held))


@dataclass(frozen=True)
class FlatMap(Traversal):
    first: Traversal
    f: Callable[[Column], Traversal]

    def run(self, frame: Frame) -> Frame:
        held = f"_v{next(_serial)}"
        one = self.first.run(frame)
        one = replace(one, df=one.df.withColumn(held, F.col("result")), keep=(*one.keep, held))
        return self.f(F.col(held)).run(one)


@dataclass(frozen=True)
class Choice(Traversal):
    ways: tuple[Traversal, ...]

    def run(self, frame: Frame) -> Frame:
        return _union([_branch(way.run(frame), i) for i, way in enumerate(self.ways)])


@dataclass(frozen=True)
class Switch(Traversal):
    cases: tuple

    def run(self, frame: Frame) -> Frame:
        return _union([_branch(way.run(replace(frame, df=frame.df.filter(p(F.col("result"))))), i) for i, (p, way) in enumerate(self.cases)])


@dataclass(frozen=True)
class Opt(Traversal):
    """The path as it was, without a value, and every path that follows: not an outer join."""

    way: Traversal

    def run(self, frame: Frame) -> Frame:
        went = self.way.run(frame)
        kind = went.df.schema["result"].dataType
        stayed = frame.value(F.lit(None).cast(kind), went.history)
        if stayed.head != went.head:
            raise TraversalError("an optional traversal must end where it begins")
        return _union([_branch(stayed, 0), _branch(went, 1)])


def _scan(kind: str, name: str) -> Traversal:
    def run(frame: Frame) -> Frame:
        tables = frame.graph.nodes if kind == "node" else frame.graph.edges
        if name not in tables:
            raise TraversalError(f"no {kind} type {name}")
        of = tables[name]
        own = of.df.select(F.col("id").alias("_id"), *([F.col("f").alias("_f"), F.col("t").alias("_t")] if of.single else [F.col("rs").alias("_rs")]), *(f"p_{p}" for p in of.properties))
        before = frame.df.drop("f", "t", "rs", "hid", "result", *(c for c in frame.df.columns if c.startswith("p_")))
        rs = F.array(R.span(F.col("_f"), F.col("_t"))) if of.single else F.col("_rs")
        item = _element(kind, name, F.col("_id"), True, rs)
        if frame.start:  # nothing to cross with: the scan is the frame
            empty = {c: F.lit(None).cast(t) for c, t in before.dtypes}
            df = own.withColumns(empty | {"path": F.array().cast(_path_type(frame.graph)), "branch": F.array().cast("array<int>")})
        else:
            df = before.crossJoin(own)
        frame = frame.walked(df, item)
        df = frame.df.withColumns({"hid": F.col("_id"), "result": item} | ({"f": F.col("_f"), "t": F.col("_t")} if of.single else {"rs": F.col("_rs")}))
        return frame.set(df.drop("_id", "_f", "_t", "_rs"), head=(kind, name), single=of.single, attached=True, history=False)

    return _Own(run)


def V(name: str) -> Traversal:
    """All nodes of a type; later in a path a cross product that takes on the new node's own ranges."""
    return _scan("node", name)


def E(name: str) -> Traversal:
    return _scan("edge", name)


def _edge_hop(name: str, forward: bool) -> Traversal:
    def run(frame: Frame) -> Frame:
        spec = frame.graph.schema.edge(name)
        here = frame.head_type("node")
        if here != (spec.source if forward else spec.target):
            raise TraversalError(f"{name} does not {'start' if forward else 'end'} at {here}")
        of = frame.graph.edges[name]
        near = "src" if forward else "dst"
        own = of.df.select(F.col("id").alias("_id"), F.col(near).alias("_near"), F.col("dst" if forward else "src").alias("_far"), *([F.col("f").alias("_f"), F.col("t").alias("_t")] if of.single else [F.col("rs").alias("_rs")]), *(f"p_{p}" for p in of.properties))
        base = frame.df.drop("result", *(c for c in frame.df.columns if c.startswith("p_")))
        df = base.join(own, base["hid"] == own["_near"])
        single = frame.single and of.single
        if single:
            df = df.filter((F.col("f") <= F.col("_t")) & (F.col("_f") <= F.col("t"))).withColumns({"f": F.greatest("f", "_f"), "t": F.least("t", "_t")})
            rs = F.array(R.span(F.col("f"), F.col("t")))
        else:
            there = F.array(R.span(F.col("_f"), F.col("_t"))) if of.single else F.col("_rs")
            df = df.withColumn("rs", R.isect(frame.rs(), there)).filter(F.size("rs") > 0).drop("f", "t")
            rs = F.col("rs")
        item = _element("edge", name, F.col("_id"), forward, rs)
        frame = frame.walked(df, item)
        df = frame.df.withColumns({"hid": F.col("_id"), "result": item, "_to": F.col("_far")})
        if "_to" not in frame.keep:
            frame = replace(frame, keep=(*frame.keep, "_to"))
        return frame.set(df.drop("_id", "_near", "_far", "_f", "_t", "_rs"), head=("edge", name), single=single, attached=True, history=False)

    return _Own(run)


def out_e(name: str) -> Traversal:
    """Outgoing edges of the head; ranges are cut to the head's."""
    return _edge_hop(name, True)


def in_e(name: str) -> Traversal:
    """Incoming edges, walked backwards."""
    return _edge_hop(name, False)


def _end(target: bool) -> Traversal:
    def run(frame: Frame) -> Frame:
        name = frame.head_type("edge")
        spec = frame.graph.schema.edge(name)
        # the hop already knows the far end; the near one, and both after a scan, come from the edge table
        own = frame.graph.edges[name].df.select(F.col("id").alias("_e"), F.col("dst" if target else "src").alias("_end"))
        base = frame.df.drop("result", *(c for c in frame.df.columns if c.startswith("p_")))
        df = base.join(own, base["hid"] == own["_e"]).drop("_e")
        return _arrive(frame, df, spec.target if target else spec.source, "_end")

    return _Own(run)


def _arrive(frame: Frame, df: DataFrame, node: str, id_column: str) -> Frame:
    rs = F.array(R.span(F.col("f"), F.col("t"))) if frame.single else F.col("rs")
    item = _element("node", node, F.col(id_column), True, rs)
    frame = frame.walked(df, item)
    df = frame.df.withColumns({"hid": F.col(id_column), "result": item})
    return frame.set(df.drop(id_column), head=("node", node), attached=False, history=False)


def _known_end(forward: bool) -> Traversal:
    """The far node of a hop just made: no join, the ranges are the edge's."""

    def run(frame: Frame) -> Frame:
        spec = frame.graph.schema.edge(frame.head_type("edge"))
        base = frame.df.drop("result", *(c for c in frame.df.columns if c.startswith("p_")))
        return _arrive(frame, base, spec.target if forward else spec.source, "_to")

    return _Own(run)


def in_v() -> Traversal:
    """The target of the head edge, with exactly the edge's ranges."""
    return _end(True)


def out_v() -> Traversal:
    """The source of the head edge, with exactly the edge's ranges."""
    return _end(False)


def out(name: str) -> Traversal:
    return Then(out_e(name), _known_end(True))


def in_(name: str) -> Traversal:
    return Then(in_e(name), _known_end(False))


def chain(*hops: tuple[str, bool], parts: int = 1) -> Traversal:
    """``out`` (edge, True) and ``in_`` (edge, False) in turn, joined from the far end: the same paths as one after the other.

    The later hops are looked up once for each edge of the first and not once for each path, which pays where nodes have
    very many edges of the first hop.  ``parts``: the paths at one node are dealt out over so many groups, each with a copy
    of the node's edges, so that few nodes do not mean few tasks.
    """

    def run(frame: Frame) -> Frame:
        here, far, all_single = frame.head_type("node"), None, True
        for i, (name, forward) in enumerate(hops):
            spec, of = frame.graph.schema.edge(name), frame.graph.edges[name]
            if here != (spec.source if forward else spec.target):
                raise TraversalError(f"{name} does not {'start' if forward else 'end'} at {here}")
            here, single = spec.target if forward else spec.source, all_single and of.single
            ends = [F.col("src" if forward else "dst").alias(f"_near{i}"), F.col("dst" if forward else "src").alias(f"_far{i}")]
            bounds = [F.col("f").alias(f"_f{i}"), F.col("t").alias(f"_t{i}")] if single else [of.rs().alias(f"_rs{i}")]
            own = of.df.select(F.col("id").alias(f"_id{i}"), *ends, *bounds)
            if far is None:
                far = own
            else:
                if all_single and not single:
                    far = far.withColumns({f"_rs{j}": F.array(R.span(F.col(f"_f{j}"), F.col(f"_t{j}"))) for j in range(i)})
                far = far.join(own, far[f"_far{i - 1}"] == own[f"_near{i}"])
                if single:
                    far = far.withColumns({f"_f{i}": F.greatest(f"_f{i - 1}", f"_f{i}"), f"_t{i}": F.least(f"_t{i - 1}", f"_t{i}")}).filter(F.col(f"_f{i}") <= F.col(f"_t{i}"))
                else:
                    far = far.withColumn(f"_rs{i}", R.isect(F.col(f"_rs{i - 1}"), F.col(f"_rs{i}"))).filter(F.size(f"_rs{i}") > 0)
            all_single = single
        last = len(hops) - 1
        base = frame.df.drop("result", *(c for c in frame.df.columns if c.startswith("p_")))
        on = F.col("hid") == F.col("_near0")
        if parts > 1:
            n = int(frame.graph.spark.conf.get("spark.sql.shuffle.partitions"))
            told = [F.col(f"{c}.id") for c in frame.items] if frame.items else [F.col("path")]
            base = base.withColumn("_part", F.pmod(F.xxhash64(*told), F.lit(parts)).cast("int")).repartition(n, "hid", "_part")
            far = far.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(n, "_near0", "_copy")
            on = on & (F.col("_part") == F.col("_copy"))
        df = base.join(far, on)
        single = frame.single and all_single
        if single:
            df = df.filter((F.col("f") <= F.col(f"_t{last}")) & (F.col(f"_f{last}") <= F.col("t")))
            cut = [F.array(R.span(F.greatest("f", f"_f{i}"), F.least("t", f"_t{i}"))) for i in range(len(hops))]
        else:
            there = lambda i: F.array(R.span(F.col(f"_f{i}"), F.col(f"_t{i}"))) if all_single else F.col(f"_rs{i}")
            df = df.withColumns({f"_cut{i}": R.isect(frame.rs(), there(i)) for i in range(len(hops))}).filter(F.size(f"_cut{last}") > 0)
            cut = [F.col(f"_cut{i}") for i in range(len(hops))]
        elements = []
        for i, (name, forward) in enumerate(hops):
            spec = frame.graph.schema.edge(name)
            elements += [_element("edge", name, F.col(f"_id{i}"), forward, cut[i]), _element("node", spec.target if forward else spec.source, F.col(f"_far{i}"), True, cut[i])]
        gone = [c for c in df.columns if c in ("_part", "_copy") or c.rstrip("0123456789") in ("_near", "_far", "_id", "_f", "_t", "_rs", "_cut")]
        frame = frame.walked(df, *elements)
        df = frame.df.withColumns({"hid": F.col(f"_far{last}"), "result": elements[-1]})
        if single:
            df = df.withColumns({"f": F.greatest("f", f"_f{last}"), "t": F.least("t", f"_t{last}")})
        else:
            df = df.drop("f", "t").withColumn("rs", cut[last])
        return frame.set(df.drop(*gone), head=("node", here), single=single, attached=False, history=False)

    return _Own(run)


def get(prop: str) -> Traversal:
    """The history of a property, cut to the head's ranges."""

    def run(frame: Frame) -> Frame:
        frame = frame.attach()
        of = frame.table()
        if prop not in of.properties:
            raise TraversalError(f"{frame.head[1]} has no property {prop}")
        column = F.col(f"p_{prop}")
        return frame.value(R.stamp(frame.rs(), column) if prop in of.constant else R.limit(column, frame.rs()), True)

    return _Own(run)


def _filter_v(frame: Frame, hit: Callable[[Column], Column]) -> Frame:
    if not frame.history:
        raise TraversalError("the value has no history")
    wide = frame.wide()
    wide = wide.narrow_to(R.isect(F.col("rs"), hit(F.col("result"))))
    return wide.value(R.limit(F.col("result"), F.col("rs")), True)


def where(prop: str, predicate: Callable[[Column], Column]) -> Traversal:
    """Restrict the head to the versions in which a property satisfies a predicate.

    A property that is constant for the element is an ordinary filter, which the scan can apply.
    """

    def run(frame: Frame) -> Frame:
        frame = frame.attach()
        of = frame.table()
        if prop in of.constant:
            return get(prop).run(frame.set(frame.df.filter(predicate(F.col(f"p_{prop}")))))
        return get(prop).filter_v(predicate).run(frame)

    return _Own(run)


def path() -> Traversal:
    """The elements of the path, head first."""
    return _Own(lambda fr: fr.value(F.reverse("path")))


def success(value) -> Traversal:
    return _Own(lambda fr: fr.value(value if isinstance(value, Column) else F.lit(value)))


def fail() -> Traversal:
    return _Own(lambda fr: fr.set(fr.df.filter(F.lit(False))))


def get_state() -> Traversal:
    """The state as the value: path, ranges and labels."""
    return _Own(lambda fr: fr.value(F.struct("path", fr.rs().alias("rs"), *(F.col(f"r_{n}").alias(n) for n in fr.labels))))


def update_state(f: Callable[[Frame], Frame]) -> Traversal:
    return Step(f)


def intersect(*versions: tuple[int, int]) -> Traversal:
    """Restrict the head to literal ranges; the value is what is left."""

    def run(frame: Frame) -> Frame:
        if frame.single and len(versions) == 1:
            (a, b), = versions
            df = frame.df.filter((F.col("f") <= b) & (F.col("t") >= a)).withColumns({"f": F.greatest("f", F.lit(a)), "t": F.least("t", F.lit(b))})
            frame = frame.set(df)
        else:
            frame = frame.narrow_to(R.isect(frame.rs(), R.normalize(R.ranges(*versions))))
        return frame.value(frame.rs())

    return _Own(run)


def versions() -> Traversal:
    return _Own(lambda fr: fr.value(fr.rs()))


def added() -> Traversal:
    """The first version of the head's (restricted) ranges."""
    return _Own(lambda fr: fr.value(F.col("f") if fr.single else R.first_version(F.col("rs"))))


def removed() -> Traversal:
    """The last version of the head's ranges; ``HEAD`` while it holds."""
    return _Own(lambda fr: fr.value(F.col("t") if fr.single else R.last_version(F.col("rs"))))


def added_after(version: int) -> Traversal:
    return added().filter(lambda v: v > version)


def added_before(version: int) -> Traversal:
    return added().filter(lambda v: v < version)


def removed_after(version: int) -> Traversal:
    return removed().filter(lambda v: v > version)


def removed_before(version: int) -> Traversal:
    return removed().filter(lambda v: v < version)


# -- labels


@dataclass(frozen=True)
class Label(Traversal):
    """Put the value before those the label already has: ``r_`` holds values as they were, ``l_`` their histories."""

    name: str

    def run(self, frame: Frame) -> Frame:
        hist = R.limit(F.col("result"), frame.rs()) if frame.history else R.stamp(frame.rs(), F.col("result"))
        raw, of = f"r_{self.name}", f"l_{self.name}"
        known = self.name in frame.labels
        if known:
            was = frame.df.schema[raw].dataType.elementType
            if was.simpleString() != frame.df.schema["result"].dataType.simpleString():
                raise TraversalError(f"label {self.name} has values of type {was.simpleString()}")
        put = lambda new, c: F.concat(F.array(new), F.coalesce(F.col(c), F.slice(F.array(new), 1, 0))) if known else F.array(new)
        df = frame.df.withColumns({raw: put(F.col("result"), raw), of: put(hist, of)})
        one = f"v_{self.name}"
        df = df.drop(one) if known else df.withColumn(one, F.col("result"))
        once = tuple(n for n in frame.once if n != self.name) if known else (*frame.once, self.name)
        return replace(frame, df=df, start=False, labels=frame.labels if known else (*frame.labels, self.name), once=once)


def get_label(name: str) -> Traversal:
    """The values of a label, newest first; empty if it was never given."""
    return _Own(lambda fr: fr.value(F.coalesce(F.col(f"r_{name}"), F.slice(F.col(f"r_{name}"), 1, 0), F.array()) if name in fr.labels else F.array().cast("array<string>")))


def _same_as(frame: Frame, name: str) -> Frame:
    if name not in frame.labels:
        return frame.value(F.lit(False))
    kind, was = frame.df.schema["result"].dataType, F.col(f"v_{name}")
    if name in frame.once and isinstance(kind, StructType) and frame.df.schema[f"v_{name}"].dataType.simpleString() == kind.simpleString():
        # part by part, so that no struct is made for each row
        same = reduce(Column.__and__, (was[x].eqNullSafe(F.col("result")[x]) for x in kind.names))
        return frame.value(was.isNotNull() & F.col("result").isNotNull() & same)
    return frame.value(F.coalesce(F.array_contains(F.col(f"r_{name}"), F.col("result")), F.lit(False)))


def ex(prop: str, prefix: str = "") -> Traversal:
    return get(prop).label(prefix + prop)


def ex_all(prefix: str = "") -> Traversal:
    """Label every property of the head; an element without properties is passed on."""

    def run(frame: Frame) -> Frame:
        for prop in frame.table().properties:
            frame = ex(prop, prefix).run(frame)
        return frame

    return _Own(run)


# -- repetition


@dataclass(frozen=True)
class Repeat(Traversal):
    """Zero (``with_none``) or one or more steps along trails.

    A path may not repeat a slice, which is all that one step pushed on the path: elements, directions and ranges.  A
    walk round a ring goes on while the ranges still shrink.  The value is the list of the steps' values.  Each level is
    written to the shared folder, so plans do not grow and a lost executor costs one level.
    """

    step: Traversal
    with_none: bool
    limit: int | None

    def run(self, frame: Frame) -> Frame:
        n = next(_serial)
        cuts, acc = f"_cuts{n}", f"_acc{n}"  # lengths of the path before each step, and the steps' values
        frame = replace(frame.loose(), keep=(*frame.keep, cuts), start=False)
        level = replace(frame, df=frame.df.withColumn(cuts, F.array(F.size("path"))))
        probe = self.step.run(level)
        if probe.head != frame.head:
            raise TraversalError("a repeated traversal must end where it begins")
        kind = probe.df.schema["result"].dataType.simpleString()
        none = F.array().cast(f"array<{kind}>")
        level = replace(level, df=level.df.withColumn(acc, none), keep=(*level.keep, acc))
        done = [_branch(level, 0)] if self.with_none else []
        before = lambda i: F.element_at(F.col(cuts), i)
        piece = F.slice(F.col("path"), before(-1) + 1, F.greatest(F.size("path") - before(-1), F.lit(0)))
        earlier = F.filter(F.sequence(F.lit(1), F.size(cuts)), lambda i: i < F.size(cuts))
        again = F.exists(earlier, lambda i: F.slice(F.col("path"), before(i) + 1, before(i + 1) - before(i)) == piece)
        for depth in count(1):
            went = self.step.run(level)
            df = went.df.filter(~again).withColumns({cuts: F.concat(F.col(cuts), F.array(F.size("path"))), acc: F.concat(F.col(acc), F.array("result"))})
            df = df.drop(*(c for c in df.columns if c.startswith("p_")), "_to")
            went = replace(went, df=materialize(df, "level"), attached=False)
            if went.df.isEmpty():
                break
            if self.limit is not None and depth > self.limit:
                raise TraversalError(f"more than {self.limit} repetitions")
            level = went
            done.append(_branch(went, depth))
        if not done:
            done = [_branch(replace(level, df=level.df.filter(F.lit(False))), 0)]
        out = _union(done).value(F.col(acc))
        return replace(out, df=out.df.drop(cuts, acc), keep=tuple(k for k in out.keep if k not in (cuts, acc)))


# -- operators that look at each incoming path


def _scoped(frame: Frame, way: Traversal) -> tuple[str, Frame, Frame]:
    rid = f"_rid{next(_serial)}"
    entered = replace(frame, df=frame.df.withColumn(rid, _row_id()), keep=(*frame.keep, rid), order=(), start=False)
    return rid, entered, way.run(entered)


def _ordering(frame: Frame) -> list[Column]:
    keys = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in frame.order]
    return [*keys, F.col("path").asc(), F.col("branch").asc()]


@dataclass(frozen=True)
class Take(Traversal):
    """The first n paths for each incoming path; of paths that no order tells apart those with the smallest elements."""

    way: Traversal
    n: int

    def run(self, frame: Frame) -> Frame:
        if frame.start:
            got = self.way.run(frame)
            return got.set(got.df.orderBy(*_ordering(got)).limit(self.n))
        rid, _, got = _scoped(frame, self.way)
        place = F.row_number().over(Window.partitionBy(rid).orderBy(*_ordering(got)))
        df = got.df.withColumn("_place", place).filter(F.col("_place") <= self.n).drop("_place", rid)
        return got.set(df, keep=tuple(k for k in got.keep if k != rid))


@dataclass(frozen=True)
class Order(Traversal):
    """Sort by the value, for each incoming path; earlier orders break ties."""

    way: Traversal
    key: Callable[[Column], Column]
    up: bool

    def run(self, frame: Frame) -> Frame:
        got = self.way.run(frame)
        name = f"_ord{next(_serial)}"
        return replace(got, df=got.df.withColumn(name, self.key(F.col("result"))), order=((name, self.up), *got.order), keep=(*got.keep, name))


@dataclass(frozen=True)
class Sub(Traversal):
    """Run a traversal on the side: the value is the list of its values, the state stays."""

    way: Traversal

    def run(self, frame: Frame) -> Frame:
        rid, entered, got = _scoped(frame, self.way)
        kind = got.df.schema["result"].dataType.simpleString()
        keys = [(F.col(c), up) for c, up in got.order]
        if keys:
            place = F.row_number().over(Window.partitionBy(rid).orderBy(*_ordering(got)))
            lists = got.df.withColumn("_place", place).groupBy(rid).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", F.struct("result").alias("r")))), lambda x: x["r"]["result"]).alias("_list"))
        else:
            lists = got.df.groupBy(rid).agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "branch", F.struct("result").alias("r")))), lambda x: x["r"]["result"]).alias("_list"))
        lists = lists.withColumnRenamed(rid, "_key")
        df = entered.df.join(lists, entered.df[rid] == lists["_key"], "left").withColumn("result", F.coalesce("_list", F.array().cast(f"array<{kind}>"))).drop("_list", "_key", rid)
        return replace(frame, df=df, start=False, history=False)


@dataclass(frozen=True)
class Matches(Traversal):
    """Whether a traversal finds anything from here: ``value`` makes it the value, else paths are kept or dropped."""

    way: Traversal
    mode: str = "value"

    def run(self, frame: Frame) -> Frame:
        rid, entered, got = _scoped(frame, self.way)
        found = got.df.select(F.col(rid).alias("_key"))
        on = entered.df[rid] == found["_key"]
        if self.mode != "value":
            return replace(frame, df=entered.df.join(found, on, "left_semi" if self.mode == "some" else "left_anti").drop(rid), start=False)
        df = entered.df.join(found.distinct(), on, "left").withColumn("result", F.col("_key").isNotNull()).drop("_key", rid)
        return replace(frame, df=df, start=False, history=False)


def sub(way: Traversal) -> Traversal:
    return Sub(way)


def matches(way: Traversal) -> Traversal:
    return Matches(way)


def matches_not(way: Traversal) -> Traversal:
    return Then(Matches(way), _Own(lambda fr: fr.value(~F.col("result"))))


def having(way: Traversal) -> Traversal:
    """Only the paths from which ``way`` finds something: a semi-join."""
    return Matches(way, "some")


def having_no(way: Traversal) -> Traversal:
    return Matches(way, "none")


@dataclass(frozen=True)
class Subs(Traversal):
    way: Traversal

    def run(self, frame: Frame) -> Frame:
        rid, entered, got = _scoped(frame, self.way)
        if not got.history:
            raise TraversalError("the value has no history")
        parts = got.df.select(F.col(rid).alias("_key"), F.posexplode(R.extract(F.col("result"))).alias("_no", "_part"))
        df = entered.df.join(parts, entered.df[rid] == parts["_key"]).withColumns({"result": F.col("_part"), "branch": F.concat("branch", F.array("_no"))})
        return replace(frame, df=df.drop("_key", "_part", "_no", rid), start=False, history=False)


def deg() -> Traversal:
    """Edges at the head by edge type: ``map<string,int>`` over all types that touch it, both directions together."""

    def run(frame: Frame) -> Frame:
        here = frame.head_type("node")
        touching = [(e.name, forward) for e in frame.graph.schema.edges for forward, end in ((True, e.source), (False, e.target)) if end == here]
        rid = f"_rid{next(_serial)}"
        base = frame.df.withColumn(rid, _row_id())
        entered = replace(frame, df=base, keep=(*frame.keep, rid), start=False)
        parts = [_edge_hop(name, forward).run(entered).df.select(F.col(rid).alias("_key"), F.lit(name).alias("e")) for name, forward in touching]
        zero = F.create_map(*(x for name in dict.fromkeys(n for n, _ in touching) for x in (F.lit(name), F.lit(0)))) if touching else F.create_map().cast("map<string,int>")
        if not parts:
            return frame.value(zero)
        counts = reduce(DataFrame.unionByName, parts).groupBy("_key", "e").agg(F.count(F.lit(1)).cast("int").alias("n"))
        degrees = counts.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("e", "n"))).alias("_deg"))
        df = base.join(degrees, base[rid] == degrees["_key"], "left")
        df = df.withColumn("result", F.map_from_entries(F.transform(F.map_entries(zero), lambda z: F.struct(z["key"].alias("key"), F.coalesce(F.try_element_at(F.col("_deg"), z["key"]), z["value"]).alias("value")))))
        return replace(frame, df=df.drop("_deg", "_key", rid), start=False, history=False)

    return _Own(run)


def execute(graph: Graph, traversal: Traversal) -> Frame:
    return traversal.run(start(graph))


def paths(graph: Graph, traversal: Traversal) -> DataFrame:
    """``path`` (first to last), ``rs`` and ``value`` of every path found, in the order the traversal asked for."""
    got = execute(graph, traversal)
    df = got.df.orderBy(*_ordering(got)) if got.order else got.df
    return df.select("path", got.rs().alias("rs"), F.col("result").alias("value"), *(F.col(f"r_{n}").alias(n) for n in got.labels))
