"""Work that must not outgrow the input: rows placed, tasks that make rows, rounds of a search."""

import re

import numpy as np
from pyspark.sql import functions as F

from terraloom.functions import geometry as geo
from terraloom.operators import classify as cl, grids as gr, network as nw, occurrence as oc, spatial as sp


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_proximity_places_blocks_of_pixels(spark, monkeypatch):
    px = spark.range(2500).selectExpr("id div 50 - 7 r", "id % 50 c", "id % 97 = 5 hit").union(
        spark.sql("select * from values (60L, 300L, false), (60L, 300L, false), (null, 3L, true), (3L, null, false) t(r, c, hit)"))
    began, start = [], sp.TileTree.start
    monkeypatch.setattr(sp.TileTree, "start", lambda self, left: began.append(left.count()) or start(self, left))
    got = sorted(tuple(r) for r in sp.proximity(px, F.col("hit"), 0.5).collect())
    rows = [r for r in px.collect() if r.r is not None and r.c is not None]
    at = [(r.r, r.c) for r in rows if r.hit]
    want = sorted((r.r, r.c, min(((r.r - a) ** 2 + (r.c - b) ** 2) for a, b in at) ** 0.5 * 0.5) for r in rows)
    assert got == want and began[0] <= 21
    assert {r.distance for r in sp.proximity(px, F.lit(False)).collect()} == {None}


def test_jenks_looks_ranges_up_without_placing_the_layer(spark):
    layer = spark.range(1, 5001).selectExpr("id i", "id * 1e0 v")
    got = cl._within(layer, [(1, 10, 1, 5, 0.0, 0.0, 0.0), (90, 310, 1, 5, 0.0, 0.0, 0.0)], 100, "lo", "hi")
    assert sorted((r.sub, r.i) for r in got.collect()) == [(0, i) for i in range(1, 11)] + [(1, i) for i in range(90, 311)]
    assert "Exchange hashpartitioning" not in plan(got)


def test_touch_is_told_by_boxes_first(spark):
    """Where the boxes share no area, the costly test of interiors is not asked; the answers stay."""
    ring = lambda *at: geo.ring_edges(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in at]))
    box = lambda x, y, s=1: ring((x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y))
    shapes = {"side": box(1, 0), "corner": box(1, 1), "part": box(1, 0.5), "over": box(0.5, 0.5), "same": box(0, 0), "inner": box(0.25, 0.25, 0.5),
              "apart": box(3, 0), "nick": ring((1, 0.5), (2, 0), (2, 1), (1, 0.5)), "edge": box(0, 0, 0.5)}
    row = spark.range(1).select(*[geo.polygons_touch(box(0, 0), q).alias(k) for k, q in shapes.items()]).first()
    assert {k for k in shapes if row[k]} == {"side", "corner", "part", "nick"}
    asked = []
    old, geo.interiors_overlap = geo.interiors_overlap, lambda p, q: asked.append(1) or F.raise_error(F.lit("asked")).cast("boolean")
    try:
        assert spark.range(1).select(geo.polygons_touch(box(0, 0), F.when(F.col("id") < 1, box(1, 0))).alias("t")).first()["t"]
    finally:
        geo.interiors_overlap = old
    assert asked


def test_sources_of_betweenness_advance_together(monkeypatch):
    n = 300  # a path: one node on every frontier
    to = np.array([v for i in range(n) for v in (i - 1, i + 1) if 0 <= v < n])
    start = np.concatenate([[0], np.cumsum([(i > 0) + (i < n - 1) for i in range(n)])])
    hops, unique = [], np.unique
    monkeypatch.setattr(nw.np, "unique", lambda *a, **k: hops.append(1) or unique(*a, **k))
    got = nw._dependencies(start, to, n, np.arange(n))
    assert got.tolist() == [2.0 * i * (n - 1 - i) for i in range(n)]
    assert len(hops) <= 2 * n
    assert np.allclose(nw._dependencies(start, to, n, np.arange(n), room=1), got)


def test_frames_of_windows_are_made_in_many_tasks(spark):
    px = spark.range(40 * 30).selectExpr("id div 300 scene", "id % 300 div 20 r", "id % 20 c", "1e0 b")
    made = gr.random_patches(px, ["b"], 4, 3, 1)
    # adaptive execution keeps a given number of partitions
    assert re.search(r"Exchange hashpartitioning\(scene#\d+L?, _r#\d+L?, \d+\), REPARTITION_BY_NUM", plan(made))
    assert made.count() == 12


def test_target_pixels_bound_the_tasks_of_resampling(spark):
    px = spark.range(400).selectExpr("0L scene", "id div 20 r", "id % 20 c", "id * 1e0 b")
    grid = lambda n, d: spark.sql(f"select 0L scene, 0e0 x0, 0e0 y0, {d}e0 dx, {d}e0 dy, {n}L width, {n}L height")
    wide = gr.resample_to(px, ["b"], grid(20, 100), grid(4000, 1), "nearest")
    assert re.search(r"_tr#\d+L, _tc#\d+L, 32\), REPARTITION_BY_NUM", plan(wide))


def test_species_years_keep_their_partitions(spark):
    occ = spark.range(100).selectExpr("id rid", "cast(id % 5 as string) species", "cast(2000 + id % 3 as int) yr", "id % 7 q", "id % 4 r")
    assert "REPARTITION_BY_NUM" in plan(oc.species_years(occ))
