"""Interval-set algebra as Column expressions.

A range is ``struct<f:int,t:int>``, closed at both ends; a range set is an array of ranges in normal form (sorted,
disjoint, not adjacent); a history is ``array<struct<f:int,t:int,v:T>>``, sorted and disjoint.  ``HEAD`` is the open end.
Adjacency is tested as ``previous.t >= next.f - 1``, which cannot overflow at ``HEAD``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HEAD = 2147483647
RANGE = "struct<f:int,t:int>"
RANGES = f"array<{RANGE}>"
ALL = ((0, HEAD),)
HEAD_ONLY = ((HEAD, HEAD),)


def span(f, t) -> Column:
    as_int = lambda x: F.lit(x).cast("int") if isinstance(x, int) else x.cast("int")
    return F.struct(as_int(f).alias("f"), as_int(t).alias("t"))


def ranges(*pairs: tuple[int, int]) -> Column:
    """A literal range set from (from, to) pairs."""
    for f, t in pairs:
        if f > t:
            raise ValueError(f"range {f}..{t} is reversed")
    return F.array(*(span(f, t) for f, t in pairs)) if pairs else F.array().cast(RANGES)


def at(version: int) -> Column:
    return ranges((version, version))


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def isect(a: Column, b: Column) -> Column:
    """Intersection; of sets in normal form it is in normal form."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(F.greatest(x["f"], y["f"]).alias("f"), F.least(x["t"], y["t"]).alias("t")))))
    return F.filter(pairs, lambda z: z["f"] <= z["t"])


def normalize(a: Column) -> Column:
    """Sort and fuse overlapping and adjacent ranges."""
    empty = F.array().cast(RANGES)

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["f"].alias("f"), F.greatest(last["t"], x["t"]).alias("t"))
        fits = F.coalesce(last["t"] >= x["f"] - 1, F.lit(False))
        return F.when(fits, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(F.transform(a, lambda r: F.struct(r["f"].alias("f"), r["t"].alias("t")))), empty, step)


def union(a: Column, b: Column) -> Column:
    return normalize(F.concat(a, b))


def contains(a: Column, version) -> Column:
    return F.exists(a, lambda r: (r["f"] <= version) & (F.lit(version) <= r["t"]))


def valid_at_head(a: Column) -> Column:
    return F.exists(a, lambda r: r["t"] == HEAD)


def first_version(a: Column) -> Column:
    return F.get(a, F.lit(0))["f"]


def last_version(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))["t"]


def previous(version: Column) -> Column:
    return version - 1


def following(version: Column) -> Column:
    return version + 1


def stamp(a: Column, value: Column) -> Column:
    """The history that has one value over a range set."""
    return F.transform(a, lambda r: F.struct(r["f"].alias("f"), r["t"].alias("t"), value.alias("v")))


def history(entries: Column) -> Column:
    """Normal form of a history: sorted, adjacent entries fused when their values are equal."""

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["f"].alias("f"), F.greatest(last["t"], x["t"]).alias("t"), last["v"].alias("v"))
        fits = F.coalesce((last["t"] >= x["f"] - 1) & last["v"].eqNullSafe(x["v"]), F.lit(False))
        return F.when(fits, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return let(F.sort_array(entries), lambda e: F.aggregate(e, F.slice(e, 1, 0), step))


def limit(hist: Column, a: Column) -> Column:
    """A history clipped to a range set."""
    cut = F.flatten(F.transform(hist, lambda h: F.transform(a, lambda r: F.struct(F.greatest(h["f"], r["f"]).alias("f"), F.least(h["t"], r["t"]).alias("t"), h["v"].alias("v")))))
    return F.filter(cut, lambda z: z["f"] <= z["t"])


def as_of(hist: Column, version) -> Column:
    """The value at a version, null where there is none."""
    return F.get(F.filter(hist, lambda h: (h["f"] <= version) & (F.lit(version) <= h["t"])), F.lit(0))["v"]


def keep(hist: Column, predicate) -> Column:
    """The entries whose value satisfies ``predicate``."""
    return F.filter(hist, lambda h: F.coalesce(predicate(h["v"]), F.lit(False)))


def values(hist: Column) -> Column:
    return F.transform(hist, lambda h: h["v"])


def versions(hist: Column) -> Column:
    return normalize(hist)


def extract(hist: Column) -> Column:
    """Distinct values with the range set of each: ``array<struct<rs,v>>``."""
    return F.transform(F.array_distinct(values(hist)), lambda v: F.struct(normalize(F.filter(hist, lambda h: h["v"].eqNullSafe(v))).alias("rs"), v.alias("v")))


def split(hist: Column) -> Column:
    """``extract`` with one entry for each range."""
    return F.flatten(F.transform(extract(hist), lambda e: F.transform(e["rs"], lambda r: F.struct(r["f"].alias("f"), r["t"].alias("t"), e["v"].alias("v")))))


#: Sort keys of histories; an empty history sorts first.
by_from = first_version
by_to = last_version


def by_oldest_value(hist: Column) -> Column:
    return F.get(hist, F.lit(0))["v"]


def by_newest_value(hist: Column) -> Column:
    return F.try_element_at(hist, F.lit(-1))["v"]


def by_min_value(hist: Column) -> Column:
    return F.array_min(values(hist))


def by_max_value(hist: Column) -> Column:
    return F.array_max(values(hist))
