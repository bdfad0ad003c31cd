"""Operators without SQL, and hard cases, against plain Python on small data."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terraloom.functions import geometry as geo, scalars as sc
from terraloom.functions.hexgrid import assign_cell, cell_center, offsets
from terraloom.operators import (
    classify as cl, grids as gr, hexgraph as hg, irrigation as ir, joins as jn, network as nw, occurrence as oc, raster as rs, spatial as sp, tables as tb,
)


def ring(*pts):
    return [{"x": float(x), "y": float(y)} for x, y in [*pts, pts[0]]]


RING = "array<struct<x:double,y:double>>"


def shapes(spark, named):
    df = spark.createDataFrame([(k, v) for k, v in named.items()], f"id string, ring {RING}")
    return sp.as_shape(df, geo.ring_edges(F.col("ring"))).drop("ring")


# --- geometry ---------------------------------------------------------------------------

def test_nearest_in_clustered_data(spark):
    rng = np.random.default_rng(2)
    tight = rng.normal(0, 1e-6, (400, 2))  # most targets in one tiny spot
    wide = rng.uniform(-50, 50, (60, 2))
    same = np.zeros((50, 2))
    right = np.vstack([tight, wide, same])
    left = np.vstack([rng.uniform(-60, 60, (80, 2)), rng.normal(0, 1e-6, (20, 2))])
    r = spark.createDataFrame(pd.DataFrame({"rid": np.arange(len(right)), "x": right[:, 0], "y": right[:, 1]}))
    q = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(left)), "x": left[:, 0], "y": left[:, 1]}))
    got = sp.nearest(sp.point_box(q), sp.point_box(r), "rid", leaf=16).toPandas().sort_values("id")
    d = np.hypot(left[:, None, 0] - right[None, :, 0], left[:, None, 1] - right[None, :, 1])
    assert len(got) == len(left)
    assert np.allclose(got["near_dist"], d.min(axis=1), atol=1e-12)
    picked = d[np.arange(len(left)), got["near_id"].to_numpy()]
    assert np.allclose(picked, d.min(axis=1), atol=1e-12)


def test_count_within_a_crowd(spark):
    rng = np.random.default_rng(12)
    pts = np.vstack([rng.normal(3, 1e-5, (500, 2)), rng.uniform(0, 10, (150, 2)), np.full((200, 2), 7.0)])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(pts)), "x": pts[:, 0], "y": pts[:, 1]}))
    got = sp.count_within(df, df, 0.8, leaf=8).toPandas().sort_values("id")["n_within"]
    d = np.hypot(pts[:, None, 0] - pts[None, :, 0], pts[:, None, 1] - pts[None, :, 1])
    assert (got.to_numpy() == (d <= 0.8).sum(axis=1)).all()


def _crosses(a, b):
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    p, q, r, t = (a[0], a[1]), (a[2], a[3]), (b[0], b[1]), (b[2], b[3])
    return side(p, q, r) * side(p, q, t) < 0 and side(r, t, p) * side(r, t, q) < 0


def test_segments_of_all_sizes_in_metres(spark):
    """From one metre to fifty kilometres, a crowd in one place: every crossing once, a handful of tiles a shape."""
    rng = np.random.default_rng(13)
    size = 10 ** rng.uniform(0, 4.7, 250)
    at = np.where(rng.random((250, 1)) < 0.5, rng.normal(520_000, 30, (250, 2)), rng.uniform(500_000, 560_000, (250, 2)))
    step = rng.normal(0, 1, (250, 2)) * size[:, None]
    a = np.hstack([at, at + step])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(a)), "x0": a[:, 0], "y0": a[:, 1], "x1": a[:, 2], "y1": a[:, 3]}))
    seg = sp.as_shape(df, F.array(geo.edge(*[F.col(c) for c in sp.BOX])))
    got = [tuple(r) for r in sp.segment_pairs(seg, seg, "id", "id", geo.segments_cross, ordered=True).collect()]
    want = [(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if _crosses(a[i], a[j])]
    assert sorted(got) == want and len(want) > 100


def test_tiles_follow_the_size_of_a_shape(spark):
    """A box of 5 km and a line of 7 km in metres make at most four tiles each, at their own level."""
    from terraloom.operators.levels import KEY, tile_pairs

    box = spark.createDataFrame([(1, 700_000.0, 9_200_000.0, 705_000.0, 9_205_000.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    line = spark.createDataFrame([(2, 701_000.0, 9_201_000.0, 707_500.0, 9_203_500.0), (3, 701_000.0, 9_201_000.0, 701_001.0, 9_201_000.0), (
        4, 702_000.0, 9_202_000.0, 702_000.0, 9_202_000.0)], box.schema)
    a, b = tile_pairs(box, sp.BOX, line, sp.BOX)
    assert a.where("lv = _own_a").count() <= 4 and a.count() <= 4
    assert b.groupBy("id", "lv").count().agg(F.max("count")).first()[0] <= 4 and b.count() <= 16
    assert {r["lv"] for r in b.where("id = 4").collect()} >= {r["lv"] for r in a.collect()}
    assert a.join(b, KEY).count() >= 3


def test_points_in_triangles_in_metres(spark):
    rng = np.random.default_rng(3)
    centre, size = rng.uniform(500_000, 503_000, (60, 2)), 10 ** rng.uniform(0.5, 3.5, 60)
    tri = centre[:, None, :] + rng.normal(0, 1, (60, 3, 2)) * size[:, None, None]
    polys = shapes(spark, {str(i): ring(*map(tuple, t.tolist())) for i, t in enumerate(tri)})
    pts = np.vstack([rng.uniform(499_000, 504_000, (400, 2)), tri.mean(axis=1)])
    points = spark.createDataFrame(pd.DataFrame({"pid": np.arange(len(pts)), "x": pts[:, 0], "y": pts[:, 1]}))
    got = sorted((r["pid"], int(r["id"])) for r in sp.points_in_polygons(points, polys.select("id", "edges", *sp.BOX)).collect())

    def inside(p, t):
        s = [(t[(k + 1) % 3][0] - t[k][0]) * (p[1] - t[k][1]) - (t[(k + 1) % 3][1] - t[k][1]) * (p[0] - t[k][0]) for k in range(3)]
        return all(x > 0 for x in s) or all(x < 0 for x in s)

    want = sorted((i, j) for i, p in enumerate(pts) for j, t in enumerate(tri) if inside(p, t))
    assert got == want and len(want) > 150


def test_nearest_with_no_right_side(spark):
    q = sp.point_box(spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double"))
    assert sp.nearest(q, q.where("id > 5").withColumnRenamed("id", "rid"), "rid").first()["near_id"] is None


def test_point_in_concave_polygon_with_hole(spark):
    outer = ring((0, 0), (10, 0), (10, 10), (5, 4), (0, 10))
    hole = ring((1, 1), (2, 1), (2, 2), (1, 2))
    df = spark.createDataFrame([([outer, hole],)], f"rings array<{RING}>").select(geo.rings_edges(F.col("rings")).alias("e"))
    for x, y, inside in [(5, 3, True), (5, 8, False), (1.5, 1.5, False), (9, 8, True), (-1, 5, False)]:
        assert df.select(geo.point_in_edges(F.lit(float(x)), F.lit(float(y)), F.col("e"))).first()[0] == inside


def test_polygon_relations(spark):
    s = shapes(spark, {
        "a": ring((0, 0), (4, 0), (4, 4), (0, 4)), "touching": ring((4, 0), (6, 0), (6, 4), (4, 4)), "corner": ring((4, 4), (5, 4), (5, 5), (4, 5)),
        "inside": ring((1, 1), (2, 1), (2, 2), (1, 2)), "over": ring((3, 3), (5, 3), (5, 6), (3, 6)), "far": ring((20, 20), (21, 20), (21, 21)),
        "same": ring((0, 0), (4, 0), (4, 4), (0, 4)), "cross": ring((-1, 1), (5, 1), (5, 2), (-1, 2)),
    })
    one = s.where("id = 'a'")
    rel = lambda test: {r["b"] for r in sp.shape_pairs(one, s, "id", "id", test).collect()} - {"a"}
    assert rel(geo.polygons_touch) == {"touching", "corner"}
    assert rel(geo.polygons_intersect) == {"touching", "corner", "inside", "over", "same", "cross"}
    assert {r["a"] for r in sp.shape_pairs(s, one, "id", "id", geo.within).collect()} == {"inside"}


def test_dissolve_against_a_raster(spark):
    """Boxes that overlap, share parts of edges, meet in corners and enclose holes: outline length and area as counted on unit squares."""
    rng = np.random.default_rng(21)
    rows, want = [], {}
    for key in range(12):
        grid = np.zeros((14, 14), bool)
        for k in range(rng.integers(2, 9)):
            x, y, wide, high = (int(v) for v in rng.integers(1, 6, 4) + [rng.integers(0, 3), rng.integers(0, 3), 0, 0])
            rows.append((f"{key}-{k}", key, ring((x, y), (x + wide, y), (x + wide, y + high), (x, y + high))))
            grid[x : x + wide, y : y + high] = True
        want[key] = (int(grid.sum()), int(sum((grid != np.roll(grid, 1, axis)).sum() for axis in (0, 1))))
    df = spark.createDataFrame(rows, f"id string, k int, r {RING}")
    polys = sp.as_shape(df, geo.ring_edges(F.col("r"))).drop("r")
    out = sp.dissolve(polys, "k")
    length = {r["k"]: r["s"] for r in out.groupBy("k").agg(F.sum(F.abs(F.col("x1") - F.col("x0")) + F.abs(F.col("y1") - F.col("y0"))).alias("s")).collect()}
    rings = sp.outline_rings(out, "k").collect()
    area = {r["k"]: r["a"] for r in sp.outline_rings(out, "k").select("k", geo.rings_area(F.col("rings")).alias("a")).collect()}
    assert {k: (area[k], length[k]) for k in want} == {k: (float(a), float(b)) for k, (a, b) in want.items()}
    for r in rings:
        for line in r["rings"]:
            assert line[0] == line[-1] and len({(p["x"], p["y"]) for p in line}) == len(line) - 1  # closed and simple


def test_dissolve_of_slanted_parts(spark):
    """A triangle set against part of a slanted border, in metres: one ring, the shared part gone."""
    base = (500_000.0, 9_200_000.0)
    at = lambda x, y: (base[0] + x, base[1] + y)
    polys = shapes(spark, {"a": ring(at(0, 0), at(300, 0), at(0, 300)), "b": ring(at(200, 100), at(300, 300), at(100, 200))}).withColumn("k", F.lit(1))
    out = sp.outline_rings(sp.dissolve(polys, "k"), "k").first()["rings"]
    assert len(out) == 1 and len(out[0]) == 8 - 1
    area = spark.createDataFrame([(out,)], f"r array<{RING}>").select(geo.rings_area(F.col("r"))).first()[0]
    assert abs(area - (45_000 + 15_000)) < 1e-2


def test_connected_lines(spark):
    rows = [(1, 500_000.0, 10.0, 530_000.0, 20.0), (2, 530_000.0, 20.0, 530_001.0, 21.0), (3, 530_001.0, 21.0, 530_000.0, 20.0), (4, 1.0, 1.0, 2.0, 2.0), (5, 530_000.00001, 20.0, 9.0, 9.0), (6, 530_000.1, 20.0, 8.0, 8.0)]
    got = sp.connected_lines(spark.createDataFrame(rows, "id int, x0 double, y0 double, x1 double, y1 double"), "id")
    assert sorted(map(tuple, got.collect())) == [(1, 2), (1, 3), (1, 5), (2, 3), (2, 5), (3, 5)]


def test_segment_distance(spark):
    row = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0, 0.5, 2.0, 0.5, 1.0)], "a double,b double,c double,d double,e double,f double,g double,h double")
    c = [F.col(x) for x in "abcdefgh"]
    p, q = geo.edge(*c[:4]), geo.edge(*c[4:])
    assert row.select(geo.segments_d2(p, q)).first()[0] == pytest.approx(1.0)
    assert row.select(geo.segments_d2(p, p)).first()[0] == 0


def test_project_utm_known_point(spark):
    e, n = sc.project_utm(F.lit(105.0), F.lit(0.0), 48)
    x, y = spark.range(1).select(e, n).first()
    assert x == pytest.approx(500000) and y == pytest.approx(0)
    e, n = sc.project_utm(F.lit(106.8272), F.lit(-6.1754), 48, south=True)  # one published city-centre fix
    x, y = spark.range(1).select(e, n).first()
    assert abs(x - 702140) < 300 and abs(y - 9317080) < 400


def test_contour_of_a_plane(spark):
    px = spark.range(25).select((F.col("id") / 5).cast("bigint").alias("r"), (F.col("id") % 5).alias("c")).withColumn("z", F.col("c") * 10.0 + 5.0)
    rows = rs.contour(px, "z", 10.0).collect()
    assert len(rows) == 16 and {r["level"] for r in rows} == {10.0, 20.0, 30.0, 40.0}
    assert all(r["x0"] == pytest.approx(r["level"] / 10 - 0.5) == pytest.approx(r["x1"]) for r in rows)


def test_contour_segments_lie_on_the_level(spark):
    rng = np.random.default_rng(3)
    z = rng.uniform(0, 100, (8, 8))
    px = spark.createDataFrame(pd.DataFrame([(r, c, z[r, c]) for r in range(8) for c in range(8)], columns=["r", "c", "z"]))
    n = 0
    for s in rs.contour(px, "z", 20.0).collect():
        for x, y in ((s["x0"], s["y0"]), (s["x1"], s["y1"])):
            r, c = int(math.floor(y)), int(math.floor(x))
            v = z[r, c] + (z[r, c + 1] - z[r, c]) * (x - c) if y == r and x != c else z[r, c] if y == r else z[r, c] + (z[r + 1, c] - z[r, c]) * (y - r)
            assert v == pytest.approx(s["level"])
        n += 1
    want = 0
    for r, c in itertools.product(range(7), range(7)):
        for level in (20.0, 40.0, 60.0, 80.0, 100.0):
            b = [z[r, c] >= level, z[r, c + 1] >= level, z[r + 1, c + 1] >= level, z[r + 1, c] >= level]
            want += sum(b[i] != b[i - 1] for i in range(4)) // 2
    assert n == want


# --- rasters ----------------------------------------------------------------------------

def test_tiles_do_not_change_results(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(0, 1, (20, 23))
    px = spark.createDataFrame(pd.DataFrame([(r, c, z[r, c]) for r in range(20) for c in range(23)], columns=["r", "c", "z"]))
    for shape in ("square", "circle"):
        got = rs.focal(px, ["z"], 3, "mean", shape=shape, tile=7).toPandas()
        assert len(got) == z.size
        for row in got.itertuples():
            near = [z[i, j] for i in range(20) for j in range(23) if max(abs(i - row.r), abs(j - row.c)) <= 3
                    and (shape == "square" or (i - row.r) ** 2 + (j - row.c) ** 2 <= 9)]
            assert row.mean_z == pytest.approx(np.mean(near))


def test_cubic_resampling(spark):
    rng = np.random.default_rng(5)
    z = rng.uniform(0, 1, (9, 9))
    px = spark.createDataFrame(pd.DataFrame([(r, c, z[r, c]) for r in range(9) for c in range(9)], columns=["r", "c", "z"]))
    got = rs.resample(px, "z", 3, "cubic", tile=4).toPandas().set_index(["r", "c"])["z"]
    k = lambda x: 1.5 * x**3 - 2.5 * x**2 + 1 if x <= 1 else (-0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0)
    for R, C in itertools.product(range(27), range(27)):
        y, x = (R + 0.5) / 3 - 0.5, (C + 0.5) / 3 - 0.5
        num = den = 0.0
        for i, j in itertools.product(range(9), range(9)):
            w = k(abs(y - i)) * k(abs(x - j))
            num, den = num + w * z[i, j], den + w
        assert got[(R, C)] == pytest.approx(num / den)


def test_random_patches_are_valid_and_repeatable(spark):
    rng = np.random.default_rng(6)
    v = (rng.random((40, 40)) > 0.08).astype(float)
    px = spark.createDataFrame(pd.DataFrame([(0, r, c, v[r, c]) for r in range(40) for c in range(40)], columns=["scene", "r", "c", "b"]))
    a = gr.random_patches(px, ["b"], 8, 6, seed=9).collect()
    assert a == gr.random_patches(px, ["b"], 8, 6, seed=9).collect() and len(a) == 6
    for p in a:
        share = v[p.y0:p.y0 + 8, p.x0:p.x0 + 8].mean()
        assert share >= 0.9 or (p.y0, p.x0) == (16, 16)


def test_augment_is_a_permutation(spark):
    n = 6
    df = spark.createDataFrame(pd.DataFrame([(s, 0, 0, i, j, float(i * n + j)) for s in range(12) for i in range(n) for j in range(n)],
                                            columns=["scene", "y0", "x0", "pr", "pc", "v"]))
    out = rs.augment(df, n, 3).toPandas()
    for _, g in out.groupby("scene"):
        a = np.full((n, n), np.nan)
        a[g["pr"], g["pc"]] = g["v"]
        base = np.arange(n * n).reshape(n, n)
        assert any((a == np.rot90(f, k)).all() for f in (base, base[::-1], base[:, ::-1], base[::-1, ::-1]) for k in range(4))


def test_interpolation(spark):
    rows = [("p", "2024-01-01", 1.0), ("p", "2024-01-11", 11.0), ("p", "2024-01-14", None), ("p", "2024-01-21", 1.0), ("q", "2024-01-05", 7.0)]
    px = spark.createDataFrame(rows, "pix string, dt string, v double").withColumn("dt", F.col("dt").cast("date"))
    got = {(r.pix, r.step): r.v for r in rs.interpolate_linear(px, ["v"], 5).collect()}
    assert got[("p", 0)] == 1 and got[("p", 5)] == 6 and got[("p", 10)] == 11 and got[("p", 15)] == pytest.approx(6)
    assert got[("q", 0)] is None and got[("q", 5)] is None


# --- graphs ------------------------------------------------------------------------------

def components_of(nodes, edges):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_with_a_hub_and_a_long_path(spark):
    rng = np.random.default_rng(7)
    nodes = list(range(300))
    edges = [(0, i) for i in range(1, 80)] + [(i, i + 1) for i in range(100, 180)] + [tuple(map(int, rng.integers(200, 300, 2))) for _ in range(60)]
    got = nw.connected_components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "src long, dst long"))
    assert {r.node: r.component for r in got.collect()} == components_of(nodes, edges)


def test_betweenness(spark):
    edges = [(0, 1), (1, 2), (2, 3), (3, 0), (2, 4), (4, 5), (4, 6), (7, 8)]
    n = 9
    adj = {i: set() for i in range(n)}
    for a, b in edges:
        adj[a].add(b), adj[b].add(a)

    def paths(s, t):
        best, todo = [], [[s]]
        while todo:
            nxt = []
            for p in todo:
                if p[-1] == t:
                    best.append(p)
                nxt += [p + [m] for m in adj[p[-1]] if m not in p]
            if best:
                return best
            todo = nxt
        return best

    want = dict.fromkeys(range(n), 0.0)
    for s, t in itertools.permutations(range(n), 2):
        ps = paths(s, t)
        for p in ps:
            for m in p[1:-1]:
                want[m] += 1 / len(ps) / ((n - 1) * (n - 2))
    got = nw.betweenness(spark.createDataFrame([(i,) for i in range(n)], "node long"), spark.createDataFrame(edges, "src long, dst long"))
    for r in got.collect():
        assert r.betweenness == pytest.approx(want[r.node])


def test_projection_round_trip_below_a_millimetre(spark):
    rng = np.random.default_rng(6)
    at = pd.DataFrame({"lon": rng.uniform(102, 108, 500), "lat": rng.uniform(-80, 80, 500)})
    df = spark.createDataFrame(at)
    for srid in (32648, 32748):
        x, y = sc.to_srid(F.col("lon"), F.col("lat"), 4326, srid)
        lon, lat = sc.to_srid(F.col("x"), F.col("y"), srid, 4326)
        got = df.withColumns({"x": x, "y": y}).select(F.max(F.abs(lon - F.col("lon")) * 111_320 * F.cos(F.radians("lat"))), F.max(F.abs(lat - F.col("lat")) * 111_320)).first()
        assert got[0] < 1e-3 and got[1] < 1e-3
    with pytest.raises(ValueError):
        sc.to_srid(F.lit(0.0), F.lit(0.0), 4326, 3857)


def test_service_area_on_a_long_road(spark):
    """Many rounds with shortcuts found late: distances equal Dijkstra's."""
    import heapq

    rng = np.random.default_rng(2)
    edges = [(i, i + 1, 1.0) for i in range(40)] + [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 40, 25), rng.integers(0, 40, 25), rng.uniform(2, 30, 25))]
    got = nw.service_area(spark.createDataFrame(edges, "src long, dst long, length double"), spark.createDataFrame([(0,)], "node long"), 33.5, merge_every=3)
    near, dist, todo = {}, {}, [(0.0, 0)]
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    while todo:
        d, n = heapq.heappop(todo)
        if n in dist or d > 33.5:
            continue
        dist[n] = d
        for b, w in near.get(n, []):
            heapq.heappush(todo, (d + w, b))
    assert {r["node"]: pytest.approx(r["dist"]) for r in got.collect()} == dist


def test_betweenness_in_batches_and_two_components(spark):
    edges = [(0, 1), (1, 2), (2, 3), (3, 0), (2, 4), (4, 5), (10, 11), (11, 12), (11, 13)]
    nodes = spark.createDataFrame([(i,) for i in [*range(6), *range(10, 14), 20]], "node long")
    table = spark.createDataFrame(edges, "src long, dst long")
    local = {r["node"]: r["betweenness"] for r in nw.betweenness(nodes, table).collect()}
    spread = {r["node"]: r["betweenness"] for r in nw.betweenness(nodes, table, local_edges=0, state=40).collect()}
    assert local == pytest.approx(spread) and local[20] == 0 and local[11] == pytest.approx(6 / 90) and len(local) == 11


def test_service_area(spark):
    edges = [(0, 1, 2.0), (1, 2, 2.0), (0, 2, 5.0), (2, 3, 9.0)]
    got = nw.service_area(spark.createDataFrame(edges, "src long, dst long, length double"), spark.createDataFrame([(0,)], "node long"), 6.0)
    assert {r.node: r.dist for r in got.collect()} == {0: 0.0, 1: 2.0, 2: 4.0}


# --- statistics --------------------------------------------------------------------------

def test_student_p_against_integration(spark):
    for df_, rho in [(1, 0.5), (2, -0.3), (3, 0.8), (4, 0.95), (7, 0.6), (12, -0.45), (1, 1.0)]:
        t = np.inf if abs(rho) == 1 else abs(rho) * math.sqrt(df_ / (1 - rho * rho))
        c = math.gamma((df_ + 1) / 2) / (math.sqrt(df_ * math.pi) * math.gamma(df_ / 2))
        if np.isinf(t):
            want = 0.0
        else:
            x = np.linspace(0, t, 200_001)
            y = c * (1 + x * x / df_) ** (-(df_ + 1) / 2)
            want = 1 - 2 * np.trapezoid(y, x)
        got = spark.range(1).select(oc.student_p(F.lit(rho), F.lit(df_))).first()[0]
        assert got == pytest.approx(want, abs=1e-6)


def test_jenks_against_brute_force(spark):
    v = [1, 2, 2, 3, 10, 11, 12, 30, 31, 33, 33, 50]
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = cl.class_breaks(df, "v", 3, "jenks").first()["breaks"]
    d = sorted(set(v))
    dev = lambda part: sum((x - np.mean(part)) ** 2 for x in part)
    best = min(itertools.combinations(range(1, len(d)), 2),
               key=lambda cut: sum(dev([x for x in v if lo <= x <= hi]) for lo, hi in
                                   [(d[0], d[cut[0] - 1]), (d[cut[0]], d[cut[1] - 1]), (d[cut[1]], d[-1])]))
    assert got == [d[0], d[best[0] - 1], d[best[1] - 1], d[-1]]


@pytest.mark.parametrize("task", [7, 40])
def test_jenks_in_small_tasks(spark, task):
    """Ranges far above the size of a task are split by Spark; same limits as in one task."""
    rng = np.random.default_rng(task)
    values = np.round(np.concatenate([rng.normal(5, 1, 60), rng.normal(20, 3, 50), rng.exponential(40, 40)]), 1)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    one = cl.jenks_breaks(df, "v", 5).first()["breaks"]
    assert cl.jenks_breaks(df, "v", 5, task=task).first()["breaks"] == one and len(one) == 6
    assert cl.jenks_breaks(df.where("v is null"), "v", 5).count() == 0
    assert cl.jenks_breaks(df.limit(1), "v", 5).first()["breaks"] == [float(values[0])] * 2


def test_jenks_is_exact_beyond_any_size(spark):
    values = [float(v) for v in [*range(1000), *range(2000, 3000), 1_000_000]]
    b = cl.class_breaks(spark.createDataFrame([(v,) for v in values], "v double"), "v", 4, "jenks").first()["breaks"]
    halves = [[499.0, 999.0, 2999.0, 1e6], [999.0, 2499.0, 2999.0, 1e6]]
    assert b[0] == 0 and b[1:] in halves


def test_diversity_by_hand(spark):
    rows = [(1, "a", 2000), (2, "a", 2001), (3, "b", 2001), (4, "c", 2002), (5, "c", 2002), (6, "c", None)]
    occ = spark.createDataFrame(rows, "rid long, species string, yr int").withColumns({"q": F.lit(0), "r": F.lit(0)})
    d = oc.diversity(occ).first()
    p = np.array([2, 1, 3]) / 6
    assert (d.s, d.n, d.dominant_species, d.trend) == (3, 6, "c", "Stable")
    assert d.shannon_h == pytest.approx(round(-(p * np.log(p)).sum(), 4)) and d.simpson_d == pytest.approx(round(1 - (p**2).sum(), 4))
    c = oc.chao1(occ).first()
    assert (c.f1, c.f2, c.chao1, c.survey_years) == (1, 1, 3.5, "2000, 2001, 2002")


def test_compact_rows_give_the_same_statistics(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"rid": np.arange(500), "species": rng.choice(list("abcdefg"), 500), "yr": rng.integers(2015, 2024, 500),
                        "method": "m", "q": np.where(rng.random(500) < 0.5, 0, rng.integers(0, 9, 500)), "r": 1})
    occ = spark.createDataFrame(pdf)
    small = oc.species_years(occ)
    for fn in (oc.diversity, oc.chao1, oc.linear_trend):
        assert sorted(map(str, fn(occ).collect())) == sorted(map(str, fn(small).collect()))
    g = hg.build_grid(occ)
    for fn in (oc.cell_summary, oc.temporal_turnover, oc.temporal_matrix):
        assert sorted(map(str, fn(occ, g).collect())) == sorted(map(str, fn(small, g).collect()))
    total = oc.cell_summary(occ, g).agg(F.sum("total_records"), F.sum(sum((F.col(c) for c in oc.cell_summary(occ, g).columns if c.startswith("records_")), F.lit(0)))).first()
    assert total[0] == total[1] == 500
    m = oc.chao1(occ).where("chao1 < s_obs").count()
    assert m == 0


def test_hex_cells(spark):
    rng = np.random.default_rng(9)
    pts = spark.createDataFrame(pd.DataFrame({"x": rng.uniform(-5, 5, 400), "y": rng.uniform(-5, 5, 400)}))
    cx, cy = cell_center(0.7)
    out = assign_cell(pts, "x", "y", 0.7).withColumns({"cx": cx, "cy": cy}).toPandas()
    own = np.hypot(out.x - out.cx, out.y - out.cy)
    assert (own <= 0.7 + 1e-9).all()
    for dq, dr, _ in offsets(1, 1):
        ox, oy = (dq + dr / 2) * 0.7 * math.sqrt(3), dr * 0.7 * 1.5
        assert (own <= np.hypot(out.x - out.cx - ox, out.y - out.cy - oy) + 1e-9).all()
    assert [len(offsets(k)) for k in range(5)] == [1 + 3 * k * (k + 1) for k in range(5)]


# --- joins and tables ----------------------------------------------------------------------

def test_nearest_scene_rules(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    left = spark.createDataFrame([(1, "2023-06-15", 0, 0, 1, 1), (2, None, 0, 0, 1, 1), (3, "2020-01-01", 0, 0, 1, 1), (4, "2023-06-15", 9, 9, 10, 10)],
                                 f"id long, d string, {box.replace('double', 'int')}")
    right = spark.createDataFrame([(10, 1, None, 0.0, 0.0, 1.0, 1.0), (11, 2, "2023-06-20", 0.0, 0.0, 1.0, 1.0), (12, 3, "2023-06-12", 0.0, 0.0, 1.0, 1.0), (13, 4, "2023-06-15", 0.0, 0.0, 0.4, 1.0)],
                                  f"id long, ord long, d string, {box}")
    fix = lambda df: df.withColumn("dt", F.col("d").cast("date")).drop("d").withColumns({c: F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")})
    got = {r.id: (r.match_id, r.days) for r in jn.nearest_scene(fix(left), fix(right), 7).collect()}
    assert got == {1: (12, 3), 2: (10, None), 3: (10, None), 4: (None, None)}


def test_nearest_scene_looks_both_ways_and_places_dates_once(spark):
    box = ["x0", "y0", "x1", "y1"]
    fix = lambda df: df.withColumn("dt", F.col("d").cast("date")).drop("d").withColumns({b: F.lit(v) for b, v in zip(box, (0e0, 0e0, 1e0, 1e0))})
    left = fix(spark.createDataFrame([(i, f"2023-06-{d:02d}") for i, d in enumerate((1, 1, 5, 10, 12, 30))], "id long, d string"))
    right = fix(spark.createDataFrame([(20, 9, "2023-06-03"), (21, 8, "2023-06-07"), (22, 3, "2023-06-07"), (23, 4, "2023-06-14"), (24, 5, "2023-06-10")], "id long, ord long, d string"))
    out = jn.nearest_scene(left, right, 4)
    got = {r.id: (r.match_id, r.days) for r in out.collect()}
    assert got == {0: (20, 2), 1: (20, 2), 2: (22, 2), 3: (24, 0), 4: (23, 2), 5: (None, None)}
    # the dates of a footprint are sorted once, not listed in several buckets
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array((" not in plan and plan.count("lastvalue") + plan.count("last(") > 0


def test_tiered_pairs_prefer_stems(spark):
    df = lambda rows: spark.createDataFrame(rows, "name string, stem string, d string").withColumn("dt", F.col("d").cast("date")).drop("d")
    a = df([("a/x.tif", "x", "2020-01-01"), ("a/y.tif", "y", "2020-01-02")])
    b = df([("b/x.tif", "x", "2020-01-02")])
    assert [tuple(r) for r in jn.tiered_pairs(a, b).collect()] == [("a/x.tif", "b/x.tif", "stem")]


def test_growing_days_stop_at_the_series_end(spark):
    daily = spark.sql("select 1 norec, date_add(date'2023-12-01', d) dt, 2e0 et0 from (select explode(sequence(0, 59)) d)")
    dates = spark.createDataFrame([(1, 340)], "norec int, start_doy int")
    got = ir.crop_water_need(daily, dates).orderBy("dt").collect()
    assert [r.day for r in got] == list(range(1, 56)) and got[0].kc == 1.05 and got[39].kc == 1.15


def test_satisfaction_index_edges(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (-1.0, 2.0), (1.0, 2.0), (9.0, 2.0), (None, 2.0)], "eta double, cwr double")
    got = [r[0] for r in df.select(sc.satisfaction_index(F.col("eta"), F.col("cwr"))).collect()]
    assert got == [1.0, None, 0.0, pytest.approx(0.6), 1.0, None]


def test_split_sizes(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    n = {r.split: r.n for r in tb.split(df, ["k"], 0.1, 0.15, 42).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert n == {"train": 78, "val": 10, "test": 15}
    few = tb.split(spark.range(5).withColumnRenamed("id", "k"), ["k"], 0.1, 0.1, 1, at_least_one=True).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in few} == {"train": 3, "val": 1, "test": 1}


def test_no_banned_calls():
    """The library keeps to plain distributed calls."""
    import pathlib

    files = pathlib.Path(__file__).parents[1].joinpath("terraloom").rglob("*.py")
    text = "\n".join(p.read_text() for p in files if "llm" not in p.parts)  # there, broadcasts have a documented bound
    for word in ("localCheckpoint", "crossJoin(", "broadcast(", ".toPandas(", ".rdd"):
        assert word not in text
