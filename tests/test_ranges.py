import pytest
from pyspark.sql import functions as F

from palimpsest.functions import ranges as R

H = R.HEAD


def _value(spark, column):
    got = spark.range(1).select(column.alias("x")).first()["x"]
    return [tuple(r) for r in got]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ([(2, 15), (16, 20)], [(2, 20)]), ([(2, 12), (8, 15)], [(2, 15)]), ([(2, 7), (8, 15), (17, 20), (21, 30)], [(2, 15), (17, 30)]),
        ([(17, 20), (2, 7), (9, 15)], [(2, 7), (9, 15), (17, 20)]), ([], []), ([(5, H), (1, 4)], [(1, H)]), ([(0, H), (3, H)], [(0, H)]),
    ],
)
def test_normalize(spark, given, wanted):
    assert _value(spark, R.normalize(R.ranges(*given))) == wanted


@pytest.mark.parametrize(
    ("a", "b", "wanted"),
    [
        ([(2, 7), (12, 15)], [(5, 10), (14, 20)], [(5, 7), (14, 15)]), ([(2, 7), (12, 15)], [(0, 5), (9, 13)], [(2, 5), (12, 13)]), ([(2, 7), (12, 15)], [(4, 13)], [(4, 7), (12, 13)]),
        ([(10, 20)], [(5, 6), (8, 15), (21, 30)], [(10, 15)]), ([(0, H)], [], []),
    ],
)
def test_intersect(spark, a, b, wanted):
    assert _value(spark, R.isect(R.ranges(*a), R.ranges(*b))) == wanted
    assert _value(spark, R.isect(R.ranges(*b), R.ranges(*a))) == wanted


@pytest.mark.parametrize(
    ("a", "b", "wanted"),
    [
        ([(10, 20), (30, 40)], [(10, 29)], [(10, 40)]), ([(10, 20)], [(21, 30)], [(10, 30)]), ([(1, 5)], [(1, 7), (9, 9)], [(1, 7), (9, 9)]),
        ([(1, 4), (7, H)], [(5, H)], [(1, H)]), ([], [], []),
    ],
)
def test_union(spark, a, b, wanted):
    assert _value(spark, R.union(R.ranges(*a), R.ranges(*b))) == wanted


def _history(*entries):
    return F.array(*(F.struct(F.lit(f).alias("f"), F.lit(t).alias("t"), F.lit(v).alias("v")) for f, t, v in entries))


def test_histories(spark):
    h = _history((1, 1, "A"), (2, 3, "B"), (4, H, "C"))
    assert [spark.range(1).select(R.as_of(h, v)).first()[0] for v in (0, 1, 2, 3, 4)] == [None, "A", "B", "B", "C"]
    same = R.history(_history((4, 4, "A"), (2, 2, "A"), (1, 1, "A")))
    assert _value(spark, same) == [(1, 2, "A"), (4, 4, "A")]
    assert _value(spark, R.limit(h, R.ranges((2, 2), (5, 9)))) == [(2, 2, "B"), (5, 9, "C")]
    found = spark.range(1).select(R.extract(_history((1, 1, "A"), (2, 2, "B"), (3, 4, "A"))).alias("x")).first()["x"]
    assert {(e["v"], tuple(map(tuple, e["rs"]))) for e in found} == {("A", ((1, 1), (3, 4))), ("B", ((2, 2),))}
    assert sorted(_value(spark, R.split(_history((1, 1, "A"), (3, 4, "A"))))) == [(1, 1, "A"), (3, 4, "A")]
    assert _value(spark, R.versions(h)) == [(1, H)]
    assert spark.range(1).select(R.valid_at_head(R.ranges((1, 2), (5, H))), R.contains(R.ranges((1, 2)), 2), R.contains(R.ranges((1, 2)), 3)).first()[:] == (True, True, False)


def test_reversed_ranges_are_refused():
    with pytest.raises(ValueError):
        R.ranges((3, 2))
