"""Multi-part and holed polygons, concave borders, coordinates in metres."""

import itertools

import pytest
from pyspark.sql import functions as F

from terraloom.functions import geometry as g

EDGE = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
CONCAVE = [(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6)]


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def shape(*rings, at=(0, 0), scale=1):
    return [(float(at[0] + a[0] * scale), float(at[1] + a[1] * scale), float(at[0] + b[0] * scale), float(at[1] + b[1] * scale)) for r in rings for a, b in zip(r, [*r[1:], r[0]])]


CASES = [  # p, q, intersect, touch, p within q
    ([box(10, 10, 11, 11), box(1, 1, 2, 2)], [box(0, 0, 5, 5)], True, False, False),  # the second part lies inside
    ([box(1, 1, 2, 2), box(3, 3, 4, 4)], [box(0, 0, 5, 5)], True, False, True),
    ([box(2, 2, 4, 4)], [box(0, 0, 6, 6), box(1, 1, 5, 5)], False, False, False),  # in the hole
    ([box(.5, .5, 5.5, 5.5)], [box(0, 0, 6, 6), box(1, 1, 5, 5)], True, False, False),  # around the hole
    ([box(1, 1, 5, 5)], [box(0, 0, 6, 6), box(1, 1, 5, 5)], True, True, False),  # fills the hole
    ([CONCAVE], [box(2, 2, 4, 6)], True, True, False),  # fills the notch
    ([CONCAVE], [box(2, 1, 4, 6)], True, False, False),  # shares borders and overlaps below them
    ([CONCAVE], [CONCAVE], True, False, False),
    ([box(0, 0, 1, 1)], [box(1, 1, 2, 2)], True, True, False),  # one corner
    ([box(0, 0, 1, 1)], [box(1.01, 0, 2, 1)], False, False, False),
    ([[(0, 0), (10, 0), (0, 10)]], [[(10, 0), (0, 10), (10, 10)]], True, True, False),
    ([[(0, 0), (3, 1), (0, 2)]], [[(3, 1), (6, 0), (6, 2)], box(20, 20, 21, 21)], True, True, False),
]


@pytest.mark.parametrize("at,scale", [((0, 0), 1), ((702140, 9317080), 1), ((702140.3, 9317080.7), 137.7), ((0.1, 0.3), 1e-3)])
def test_predicates(spark, at, scale):
    rows = [(i, shape(*p, at=at, scale=scale), shape(*q, at=at, scale=scale)) for i, (p, q, *_) in enumerate(CASES)]
    p, q = F.col("p"), F.col("q")
    got = spark.createDataFrame(rows, f"i int, p {EDGE}, q {EDGE}").select(
        "i", g.polygons_intersect(p, q).alias("a"), g.polygons_intersect(q, p).alias("b"), g.polygons_touch(p, q).alias("c"),
        g.polygons_touch(q, p).alias("d"), g.within(p, q).alias("e")).collect()
    for r in got:
        meets, touches, inside = CASES[r["i"]][2:]
        assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == (meets, meets, touches, touches, inside), CASES[r["i"]]


def test_line_in_second_part(spark):
    line, poly = shape([(20.2, 20.2), (20.8, 20.8)])[:1], shape(box(0, 0, 1, 1), box(20, 20, 21, 21))
    df = spark.createDataFrame([(line, poly)], f"l {EDGE}, p {EDGE}")
    assert df.select(g.line_meets_polygon(F.col("l"), F.col("p")).alias("m")).first()["m"]


def test_overlap_against_sampling(spark):
    """Rectilinear shapes from unit squares: interiors overlap when they share a square."""
    cells = [[(0, 0)], [(0, 0), (1, 0)], [(1, 1)], [(0, 0), (2, 2)], [(2, 0), (0, 2)], [(1, 0), (1, 1)]]
    pairs = list(itertools.product(cells, cells))
    rows = [(i, shape(*[box(x, y, x + 1, y + 1) for x, y in p], at=(7e5, 9e6)), shape(*[box(x, y, x + 1, y + 1) for x, y in q], at=(7e5, 9e6))) for i, (p, q) in enumerate(pairs)]
    got = spark.createDataFrame(rows, f"i int, p {EDGE}, q {EDGE}").select("i", g.interiors_overlap(F.col("p"), F.col("q")).alias("o")).collect()
    for r in got:
        p, q = pairs[r["i"]]
        assert r["o"] == bool(set(p) & set(q)), (p, q)
