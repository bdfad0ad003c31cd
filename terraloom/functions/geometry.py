"""Planar geometry on struct and array columns.

A ring is ``array<struct<x,y>>`` (closed); ``edges`` is ``array<struct<x0,y0,x1,y1>>``
and holds all rings of a polygon, or the parts of a line.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TOL = 1e-10  # share of the size of the coordinates within which places count as equal


def edge(x0, y0, x1, y1) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Closed counter-clockwise ring of a rectangle."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0))


def ring_edges(ring: Column) -> Column:
    return F.zip_with(
        F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1),
        lambda a, b: edge(a["x"], a["y"], b["x"], b["y"]))


def rings_edges(rings: Column) -> Column:
    """Edges of an outer ring and its holes."""
    return F.flatten(F.transform(rings, ring_edges))


def edges_box(edges: Column) -> list[Column]:
    """x0, y0, x1, y1 of the bounding box."""
    lo = lambda a, b: F.array_min(F.transform(edges, lambda e: F.least(e[a], e[b])))
    hi = lambda a, b: F.array_max(F.transform(edges, lambda e: F.greatest(e[a], e[b])))
    return [lo("x0", "x1").alias("x0"), lo("y0", "y1").alias("y0"), hi("x0", "x1").alias("x1"), hi("y0", "y1").alias("y1")]


def _sum(edges: Column, fn) -> Column:
    return F.aggregate(edges, F.lit(0e0), lambda acc, e: acc + fn(e))


def _signed_area(edges: Column) -> Column:
    return _sum(edges, lambda e: e["x0"] * e["y1"] - e["x1"] * e["y0"]) / 2


def rings_area(rings: Column) -> Column:
    """Area of a multipolygon with counter-clockwise outer rings and clockwise holes."""
    return F.aggregate(rings, F.lit(0e0), lambda acc, r: acc + _signed_area(ring_edges(r)))


def polygon_area(edges: Column) -> Column:
    return F.abs(_signed_area(edges))


def centroid(edges: Column) -> tuple[Column, Column]:
    six = 6 * _signed_area(edges)
    w = lambda e: e["x0"] * e["y1"] - e["x1"] * e["y0"]
    return _sum(edges, lambda e: (e["x0"] + e["x1"]) * w(e)) / six, _sum(edges, lambda e: (e["y0"] + e["y1"]) * w(e)) / six


def point_in_edges(x: Column, y: Column, edges: Column) -> Column:
    """Crossing parity: a point is inside when a ray to the right meets an odd number of edges."""
    hits = F.aggregate(edges, F.lit(0), lambda acc, e: acc + F.when(
        ((e["y0"] > y) != (e["y1"] > y)) & (x < (e["x1"] - e["x0"]) * (y - e["y0"]) / F.nullif(e["y1"] - e["y0"], F.lit(0e0)) + e["x0"]), 1
    ).otherwise(0))
    return hits % 2 == 1


def _magnitude(*coordinates) -> Column:
    return F.greatest(*[F.abs(c) for c in coordinates])


def side(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area of a, b, c; zero when c is off the line by no more than the tolerance."""
    dx, dy = bx - ax, by - ay
    v = dx * (cy - ay) - dy * (cx - ax)
    return F.when(F.abs(v) <= TOL * _magnitude(ax, ay, bx, by, cx, cy) * (F.abs(dx) + F.abs(dy)), 0e0).otherwise(v)


def segments_cross(a: Column, b: Column) -> Column:
    """Proper crossing in the interior of both segments."""
    s1, s2 = side(a["x0"], a["y0"], a["x1"], a["y1"], b["x0"], b["y0"]), side(a["x0"], a["y0"], a["x1"], a["y1"], b["x1"], b["y1"])
    s3, s4 = side(b["x0"], b["y0"], b["x1"], b["y1"], a["x0"], a["y0"]), side(b["x0"], b["y0"], b["x1"], b["y1"], a["x1"], a["y1"])
    return (s1 * s2 < 0) & (s3 * s4 < 0)


def _on(e: Column, x: Column, y: Column) -> Column:
    tol = TOL * _magnitude(e["x0"], e["y0"], e["x1"], e["y1"], x, y)
    return (
        (side(e["x0"], e["y0"], e["x1"], e["y1"], x, y) == 0)
        & (x >= F.least(e["x0"], e["x1"]) - tol) & (x <= F.greatest(e["x0"], e["x1"]) + tol)
        & (y >= F.least(e["y0"], e["y1"]) - tol) & (y <= F.greatest(e["y0"], e["y1"]) + tol))


def segments_meet(a: Column, b: Column) -> Column:
    """Crossing, touching or overlapping; segments whose boxes lie apart by more than the tolerance are told first."""
    tol = TOL * _magnitude(*[e[c] for e in (a, b) for c in ("x0", "y0", "x1", "y1")])
    before = lambda p, q, c: F.greatest(p[f"{c}0"], p[f"{c}1"]) + tol < F.least(q[f"{c}0"], q[f"{c}1"])
    apart = before(a, b, "x") | before(b, a, "x") | before(a, b, "y") | before(b, a, "y")
    return ~apart & (
        segments_cross(a, b) | _on(a, b["x0"], b["y0"]) | _on(a, b["x1"], b["y1"]) | _on(b, a["x0"], a["y0"]) | _on(b, a["x1"], a["y1"]))


def _any(p: Column, q: Column, test) -> Column:
    return F.exists(p, lambda a: F.exists(q, lambda b: test(a, b)))


def strictly_inside(x: Column, y: Column, edges: Column) -> Column:
    return point_in_edges(x, y, edges) & ~F.exists(edges, lambda e: _on(e, x, y))


def _vertex_in(p: Column, q: Column) -> Column:
    """Some vertex of any part or ring of ``p`` lies in ``q``."""
    return F.exists(p, lambda e: point_in_edges(e["x0"], e["y0"], q))


def polygons_intersect(p: Column, q: Column) -> Column:
    """Any part of one meets or lies in a part of the other; holes are outside."""
    return _any(p, q, segments_meet) | _vertex_in(p, q) | _vertex_in(q, p)


def line_meets_polygon(line: Column, poly: Column) -> Column:
    return _any(line, poly, segments_meet) | _vertex_in(line, poly)


def _middles(e: Column, q: Column) -> Column:
    """Middle points of the pieces into which the edges of ``q`` can cut ``e``, with a small step to its left."""
    dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
    length2 = dx * dx + dy * dy

    def places(f: Column) -> Column:
        fx, fy = f["x1"] - f["x0"], f["y1"] - f["y0"]
        along = lambda x, y: F.try_divide((x - e["x0"]) * dx + (y - e["y0"]) * dy, length2)
        cross = F.try_divide((f["x0"] - e["x0"]) * fy - (f["y0"] - e["y0"]) * fx, dx * fy - dy * fx)
        return F.array(cross, along(f["x0"], f["y0"]), along(f["x1"], f["y1"]))

    inner = F.filter(F.flatten(F.transform(q, places)), lambda t: (t > 0) & (t < 1))
    ends = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0e0), F.lit(1e0)), inner)))
    pieces = F.zip_with(F.slice(ends, 1, F.size(ends) - 1), F.slice(ends, 2, F.size(ends) - 1), lambda s, t: F.struct(
        ((s + t) / 2).alias("t"), ((t - s) / 1000).alias("h")))
    return F.transform(pieces, lambda m: F.struct(
        (e["x0"] + m["t"] * dx).alias("x"), (e["y0"] + m["t"] * dy).alias("y"), (-dy * m["h"]).alias("hx"), (dx * m["h"]).alias("hy")))


def cut_places(e: Column, f: Column) -> Column:
    """Where ``f`` cuts ``e``: array of (t, x, y) with the share t of the way along ``e``, ends of ``e`` left out."""
    dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
    length2 = dx * dx + dy * dy

    def vertex(x: Column, y: Column) -> Column:
        t = F.try_divide((x - e["x0"]) * dx + (y - e["y0"]) * dy, length2)
        return F.when(_on(e, x, y), F.struct(t.alias("t"), x.alias("x"), y.alias("y")))

    p, q = F.least(e, f), F.greatest(e, f)  # one order, so both edges get the same place
    px, py, qx, qy = p["x1"] - p["x0"], p["y1"] - p["y0"], q["x1"] - q["x0"], q["y1"] - q["y0"]
    along = F.try_divide((q["x0"] - p["x0"]) * qy - (q["y0"] - p["y0"]) * qx, px * qy - py * qx)
    x, y = p["x0"] + along * px, p["y0"] + along * py
    crossing = F.when(segments_cross(e, f), F.struct(F.try_divide((x - e["x0"]) * dx + (y - e["y0"]) * dy, length2).alias("t"), x.alias("x"), y.alias("y")))
    found = F.array(vertex(f["x0"], f["y0"]), vertex(f["x1"], f["y1"]), crossing)
    return F.filter(found, lambda c: c.isNotNull() & (c["t"] > TOL) & (c["t"] < 1 - TOL))


def interiors_overlap(p: Column, q: Column) -> Column:
    """Some piece of an edge lies inside the other polygon, or both lie on the same side of a shared piece.

    Each edge is cut wherever the other polygon can meet it, so a piece is inside, outside
    or on the boundary as a whole.
    """
    def reach(a: Column, b: Column) -> Column:
        inside = lambda m: strictly_inside(m["x"], m["y"], b)
        shared = lambda m: F.exists(F.array(F.lit(1e0), F.lit(-1e0)), lambda s: point_in_edges(m["x"] + s * m["hx"], m["y"] + s * m["hy"], a) & point_in_edges(
            m["x"] + s * m["hx"], m["y"] + s * m["hy"], b))
        on = lambda m: F.exists(b, lambda f: _on(f, m["x"], m["y"]))
        return F.exists(a, lambda e: F.exists(_middles(e, b), lambda m: inside(m) | (on(m) & shared(m))))

    return _any(p, q, segments_cross) | reach(p, q) | reach(q, p)


def polygons_touch(p: Column, q: Column) -> Column:
    """Boundaries meet, interiors do not; where the boxes share no area, neither do the interiors."""
    (px0, py0, px1, py1), (qx0, qy0, qx1, qy1) = edges_box(p), edges_box(q)
    beside = (px1 <= qx0) | (qx1 <= px0) | (py1 <= qy0) | (qy1 <= py0)
    return _any(p, q, segments_meet) & (beside | ~interiors_overlap(p, q))


def within(inner: Column, outer: Column) -> Column:
    """All parts completely inside: no contact with the outer boundary, and no ring of it (as of a hole) inside."""
    parts = F.forall(inner, lambda e: point_in_edges(e["x0"], e["y0"], outer))
    return parts & ~_any(inner, outer, segments_meet) & ~_vertex_in(outer, inner)


def point_segment_d2(x: Column, y: Column, e: Column) -> Column:
    """Squared distance from a point to a segment."""
    dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
    t = F.coalesce(F.try_divide((x - e["x0"]) * dx + (y - e["y0"]) * dy, dx * dx + dy * dy), F.lit(0e0))
    t = F.least(F.greatest(t, F.lit(0e0)), F.lit(1e0))
    px, py = e["x0"] + t * dx - x, e["y0"] + t * dy - y
    return px * px + py * py


def segments_d2(a: Column, b: Column) -> Column:
    """Squared distance between two segments."""
    return F.when(segments_meet(a, b), 0e0).otherwise(F.least(
        point_segment_d2(a["x0"], a["y0"], b), point_segment_d2(a["x1"], a["y1"], b),
        point_segment_d2(b["x0"], b["y0"], a), point_segment_d2(b["x1"], b["y1"], a)))


def buffer_bbox(box, d: float) -> list[Column]:
    x0, y0, x1, y1 = (F.col(c) for c in box)
    return [(x0 - d).alias("x0"), (y0 - d).alias("y0"), (x1 + d).alias("x1"), (y1 + d).alias("y1")]
