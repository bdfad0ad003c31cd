"""Percentiles of bands from counted bins, against sorted values; pixels are placed by scene, not by value."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from terraloom.operators import raster as rs
from terraloom.plans import jobs


def pixels(spark):
    rnd = random.Random(3)
    rows = [(0, i, 0, rnd.lognormvariate(0, 3) * rnd.choice([1, 1, -1, 0]), float(i % 3)) for i in range(500)]
    rows += [(1, i, 0, 7.0, None if i % 2 else 1e-310 * (i + 1)) for i in range(40)]
    rows += [(2, 0, 0, 0.0, -1.0), (2, 1, 0, None, 5.0), (None, 0, 0, 3.0, 4.0), (3, 0, 0, math.inf, math.nan), (3, 1, 0, 2.0, 1.0)]
    return spark.createDataFrame(rows, "scene long, r long, c long, b1 double, b2 double"), rows


def test_band_percentiles_are_exact(spark):
    px, rows = pixels(spark)
    got = {r.scene: r for r in rs.band_percentiles(px, ["b1", "b2"], {"a": 0.02, "b": 0.98}, ["scene"]).collect()}
    for scene in (0, 1):
        for k, band in ((3, "b1"), (4, "b2")):
            v = [r[k] for r in rows if r[0] == scene and r[k] is not None and r[k] > 0]
            assert np.allclose([got[scene][f"_a_{band}"], got[scene][f"_b_{band}"]], np.percentile(v, [2, 98]), rtol=1e-12, atol=0)
    assert got[2]._a_b1 is None and got[2]._b_b2 == 5.0


def test_wide_and_long_normalisation_agree(spark):
    px, _ = pixels(spark)
    px = px.where("scene < 3 or scene is null")
    for how in ("percentile", "minmax", "zscore", "none"):
        long = rs.normalize(rs.unstack_bands(px, ["b1", "b2"], ["scene", "r", "c"]), how)
        want = {(r.scene, r.r): (r.b1, r.b2) for r in rs.stack_bands(long, ["b1", "b2"], ["scene", "r", "c"]).collect()}
        got = {(r.scene, r.r): (r.b1, r.b2) for r in rs.normalize_bands(px, ["b1", "b2"], how).collect()}
        assert got.keys() == want.keys()
        for k, pair in want.items():
            for a, b in zip(pair, got[k]):
                assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)), (how, k)


def test_patches_of_pixels_that_come_twice(spark, tmp_path, monkeypatch):
    """Normalised pixels are not taken apart into a row per band, and a pixel listed twice counts once."""
    monkeypatch.setattr(rs, "unstack_bands", lambda *a: 1 / 0)
    px = spark.range(400).selectExpr("0L scene", "id div 20 r", "id % 20 c", "1e0 + id b1", "2e0 + id % 17 b2")
    once = sorted(tuple(r) for r in jobs.patch_preparation(px, px, ["b1", "b2"], str(tmp_path), size=5, scale=1, stride=5).collect())
    twice = px.unionByName(px.where("r < 5").withColumn("b1", F.lit(0.5)))
    more = jobs.patch_preparation(twice, twice, ["b1", "b2"], str(tmp_path), size=5, scale=1, stride=5)
    assert once and all(r[3] <= 1 and r[4] <= 1 for r in more.select("scene", "y0", "x0", "lr_valid", "hr_valid").collect())
