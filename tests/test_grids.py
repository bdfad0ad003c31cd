"""Resampling between grids, window shares and crops against plain numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terraloom.operators import grids as gr, metrics as mt


def image(spark, v, scene=0):
    rows = [(scene, r, c, None if np.isnan(v[r, c]) else float(v[r, c])) for r in range(v.shape[0]) for c in range(v.shape[1])]
    return spark.createDataFrame(rows, "scene int, r int, c int, b double")


def grid(spark, x0, y0, dx, dy, w, h, scene=0):
    return spark.createDataFrame([(scene, float(x0), float(y0), float(dx), float(dy), w, h)],
                                 "scene int, x0 double, y0 double, dx double, dy double, width int, height int")


def weight(x, how):
    if how == "nearest":
        return 1.0 if -0.5 <= x < 0.5 else 0.0
    x = abs(x)
    if how == "bilinear":
        return max(1 - x, 0)
    return 1.5 * x**3 - 2.5 * x**2 + 1 if x <= 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0


def plain(v, src, dst, how):
    """Reference by its definition: every source pixel against every target pixel."""
    out = {}
    h, w = v.shape
    for i in range(dst[5]):
        for j in range(dst[4]):
            p = [((dst[1] + (i + 0.5) * dst[3]) - src[1]) / src[3] - 0.5, ((dst[0] + (j + 0.5) * dst[2]) - src[0]) / src[2] - 0.5]
            if not (-0.5 <= p[0] < h - 0.5 and -0.5 <= p[1] < w - 0.5):
                continue
            s = [1, 1] if how == "nearest" else [max(dst[3] / src[3], 1), max(dst[2] / src[2], 1)]
            ws = {(r, c): weight((p[0] - r) / s[0], how) * weight((p[1] - c) / s[1], how) for r in range(h) for c in range(w)}
            num = sum(k * v[q] for q, k in ws.items() if not np.isnan(v[q]))
            den = sum(k for q, k in ws.items() if not np.isnan(v[q]))
            out[i, j] = num / den if den != 0 else None
    return out


@pytest.mark.parametrize("how", ["nearest", "bilinear", "cubic"])
@pytest.mark.parametrize("size,tile", [(1.1, 4), (2.7, 256), (0.7, 5)])
def test_resample_to_another_grid(spark, how, size, tile):
    rng = np.random.default_rng(3)
    v = rng.random((9, 11))
    v[2:7, 3:8] = np.nan  # a masked block wider than a kernel
    v[0, 0] = np.nan
    src, dst = (100.0, 50.0, 1.0, -1.0, 11, 9), (98.63, 51.37, size, -size, int(14 / size), int(12 / size))
    got = gr.resample_to(image(spark, v), ["b"], grid(spark, *src), grid(spark, *dst), how, tile=tile).collect()
    got = {(x.r, x.c): x.b for x in got}
    want = plain(v, src, dst, how)
    assert got.keys() == want.keys()
    for k, x in want.items():
        assert (x is None) == (got[k] is None)
        assert x is None or math.isclose(got[k], x, abs_tol=1e-9)


def test_resample_to_edge_cases(spark):
    g = grid(spark, 0, 0, 1, 1, 3, 3)
    px = image(spark, np.ones((3, 3)))
    assert gr.resample_to(px.limit(0), ["b"], g, g).count() == 0
    assert gr.resample_to(px, ["b"], g, grid(spark, 90, 90, 1, 1, 3, 3)).count() == 0  # apart
    assert gr.resample_to(px, ["b"], g, grid(spark, 0, 0, 1, 1, 3, 3, scene=7)).count() == 0  # no such image
    same = gr.resample_to(px, ["b"], g, g, "cubic")
    assert same.count() == 9 and same.agg(F.min("b"), F.max("b")).first() == (1.0, 1.0)


def test_resample_to_shuffles_pixels_once(spark):
    g = grid(spark, 0, 0, 1, 1, 3, 3)
    px = image(spark, np.ones((3, 3))).withColumn("b2", F.col("b") * 2)
    text = gr.resample_to(px, ["b", "b2"], g, g, "bilinear")._jdf.queryExecution().executedPlan().toString()
    assert sum("_tr" in line for line in text.splitlines() if "Exchange hashpartitioning" in line) == 1


@pytest.mark.parametrize("size,stride", [(6, 4), (5, 5), (7, 3)])
def test_window_shares(spark, size, stride):
    rng = np.random.default_rng(4)
    lo, hi = rng.integers(0, 2, (17, 20)).astype(float), rng.integers(0, 2, (34, 41)).astype(float)
    lo[3, 3] = np.nan
    a, b = image(spark, lo).where("r + c != 7"), image(spark, hi)  # a diagonal of pixels is missing
    got = gr.extract_patches(a, b, ["b"], size, 2, stride, min_valid=0.0).collect()
    for r in range(8):
        lo[r, 7 - r] = 0
    lo = np.nan_to_num(lo)
    assert {(x.y0, x.x0) for x in got} == {(y, x) for y in range(0, 18 - size, stride) for x in range(0, 21 - size, stride)}
    for x in got:
        assert math.isclose(x.lr_valid, lo[x.y0:x.y0 + size, x.x0:x.x0 + size].mean())
        y0, x0 = 2 * x.y0, 2 * x.x0
        assert math.isclose(x.hr_valid, hi[y0:y0 + 2 * size, x0:x0 + 2 * size].mean())


def test_random_pairs_are_valid_on_both_sides(spark):
    rng = np.random.default_rng(5)
    lo, hi = (rng.random((30, 30)) > 0.05).astype(float), (rng.random((90, 90)) > 0.08).astype(float)
    dead = np.zeros((30, 30))
    lr = image(spark, lo).unionByName(image(spark, dead, 1)).unionByName(image(spark, lo[:8, :8], 2))
    hr = image(spark, hi).unionByName(image(spark, hi, 1)).unionByName(image(spark, hi[:24, :24], 2))
    got = gr.random_patch_pairs(lr, hr, ["b"], 8, 6, seed=9).collect()
    assert sorted(got) == sorted(gr.random_patch_pairs(lr, hr, ["b"], 8, 6, seed=9).collect())
    assert [(x.y0, x.x0, x.valid) for x in got if x.scene == 1] == [(11, 11, False)]
    assert not [x for x in got if x.scene == 2]  # not larger than a patch
    first = [x for x in got if x.scene == 0]
    assert len(first) == 6
    for x in first:
        assert lo[x.y0:x.y0 + 8, x.x0:x.x0 + 8].mean() >= 0.9
        assert hi[3 * x.y0:3 * x.y0 + 24, 3 * x.x0:3 * x.x0 + 24].mean() >= 0.9


def test_random_crop_keeps_both_sides_together(spark):
    lr = spark.createDataFrame([(s, 0, 0, r, c) for s in range(5) for r in range(6) for c in range(6)], "scene int, y0 int, x0 int, pr int, pc int")
    hr = lr.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumns(
        {"v": F.col("pr") * 100 + F.col("pc"), "pr": F.col("pr") * 3 + F.col("i") % 3, "pc": F.col("pc") * 3 + F.floor(F.col("i") / 3).cast("int")})
    a, b = gr.random_crop(lr.withColumn("v", F.col("pr") * 100 + F.col("pc")), hr, 6, 12, seed=1)
    a, b = a.toPandas(), b.toPandas()
    assert len(a) == 5 * 16 and len(b) == 5 * 144
    low = a.set_index(["scene", "pr", "pc"])["v"]
    assert all(low[x.scene, x.pr // 3, x.pc // 3] == x.v for x in b.itertuples())
    assert gr.random_crop(lr, hr, 6, 0, seed=1) == (lr, hr)
    with pytest.raises(ValueError):
        gr.random_crop(lr, hr, 6, 21, seed=1)


def test_structural_similarity_of_small_images(spark):
    """Scenes of 2 to 9 pixels a side: windows of 3, 5 and 7 by their size, none below 3."""
    rng = np.random.default_rng(8)
    data = {s: (rng.random((s, s + 1)), rng.random((s, s + 1))) for s in range(2, 10)}
    rows = [(s, r, c, float(p[r, c]), float(t[r, c])) for s, (p, t) in data.items() for r in range(s) for c in range(s + 1)]
    pairs = spark.createDataFrame(pd.DataFrame(rows, columns=["scene", "r", "c", "p_b", "t_b"]))
    got = {x.scene: x.ssim for x in mt.ssim(pairs, ["b"]).collect()}
    assert got.keys() == set(range(3, 10))
    for s, value in got.items():
        p, t = data[s]
        n = max(3, min(7, s if s % 2 else s - 1))
        each = []
        for r in range(s - n + 1):
            for c in range(s + 2 - n):
                a, b = p[r:r + n, c:c + n].ravel(), t[r:r + n, c:c + n].ravel()
                cov = np.cov(a, b)
                each.append((2 * a.mean() * b.mean() + 1e-4) * (2 * cov[0, 1] + 9e-4) / (
                    (a.mean()**2 + b.mean()**2 + 1e-4) * (cov[0, 0] + cov[1, 1] + 9e-4)))
        assert math.isclose(value, np.mean(each), abs_tol=1e-9)


def test_clear_series_masks_clouds_shadows_and_other_sensors(spark):
    from terraloom.plans.jobs import clear_series

    rows = [("a", r, c, "2024-01-05", 10.0, 0.0, 4, 3000.0, 4000.0) for r in range(12) for c in range(12)]
    rows += [("late", 0, 0, "2024-03-05", 10.0, 0.0, 4, 1.0, 1.0), ("full", 0, 0, "2024-01-06", 80.0, 0.0, 4, 1.0, 1.0)]
    cols = "scene string, r int, c int, dt string, cloud double, azimuth double, scene_class int, red double, nir double"
    px = spark.createDataFrame(rows, cols).withColumn("dt", F.col("dt").cast("date")).withColumns(
        {"x0": F.lit(0e0), "y0": F.lit(0e0), "x1": F.lit(1e0), "y1": F.lit(1e0)})
    dark = px.withColumn("nir", F.when((F.col("r") < 6) & (F.col("c") == 5), 100.0).otherwise(F.col("nir")))
    prob = px.where("not (r = 11 and c = 11)").select("scene", "r", "c", F.lit(2).alias("product"), F.lit(99e0).alias("probability")).unionByName(
        px.where("not (r = 11 and c = 11)").select("scene", "r", "c", F.lit(1).alias("product"), F.when(
            F.col("r").between(6, 8) & F.col("c").between(4, 6), 90e0).otherwise(0e0).alias("probability")))
    other = spark.createDataFrame([(0, 0, "2024-01-07", 0, 20000.0, 20000.0), (0, 1, "2024-01-07", 8, 1.0, 1.0), (0, 2, "2024-05-07", 0, 1.0, 1.0)],
                                  "r int, c int, dt string, qa int, red double, nir double").withColumn("dt", F.col("dt").cast("date"))
    got = clear_series(dark, prob, [other], ["red", "nir"], (0, 0, 1, 1), "2024-01-01", "2024-02-01", max_steps=4, erode=0, dilate=0).toPandas()
    day = got["dt"].astype(str)
    image, rest = got[day == "2024-01-05"], got[day == "2024-01-07"].sort_values("c")
    masked = {(x.r, x.c) for x in image.itertuples() if np.isnan(x.red)}
    cloud = {(r, c) for r in (6, 7, 8) for c in (4, 5, 6)}
    assert masked == cloud | {(r, 5) for r in (2, 3, 4, 5)}  # sun in the north: dark pixels within four steps of a cloud
    assert len(image) == 143  # the pixel without a probability is gone, like the late and the cloudy scene
    assert math.isclose(rest.red.iloc[0], 20000 * 0.0000275 - 0.2) and np.isnan(rest.red.iloc[1]) and len(rest) == 2
