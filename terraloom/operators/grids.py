"""Rasters brought onto another grid, and the valid share of image windows.

A grid is a row per image: keys, ``x0, y0`` (outer corner of the first pixel), ``dx, dy``
(pixel size; ``dy`` is negative where rows run southwards), ``width, height``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from terraloom.operators.raster import TILE, seeded
from terraloom.scale import parts_for

REACH = {"nearest": 0.5, "bilinear": 1.0, "cubic": 2.0}


def _kernel(d: Column, how: str) -> Column:
    """Weight of a source pixel whose centre lies ``d`` source pixels before the target's."""
    if how == "nearest":
        return F.when((d >= -0.5) & (d < 0.5), 1e0).otherwise(0e0)
    x = F.abs(d)
    if how == "bilinear":
        return F.greatest(1 - x, F.lit(0e0))
    near, far = 1.5 * x * x * x - 2.5 * x * x + 1, -0.5 * x * x * x + 2.5 * x * x - 4 * x + 2
    return F.when(x <= 1, near).when(x < 2, far).otherwise(0e0)


def _scales(source: DataFrame, target: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Per image and axis: source position = step * target index + shift, the kernel's stretch and both lengths."""
    both = source.alias("s").join(target.alias("t"), list(keys))
    cols = [*keys]
    for axis, lo, d, n in (("r", "y0", "dy", "height"), ("c", "x0", "dx", "width")):
        step = F.col(f"t.{d}") / F.col(f"s.{d}")
        shift = (F.col(f"t.{lo}") + F.col(f"t.{d}") / 2 - F.col(f"s.{lo}")) / F.col(f"s.{d}") - 0.5
        wide = F.lit(1e0) if how == "nearest" else F.greatest(step, F.lit(1e0))
        cols += [step.alias(f"_{axis}a"), shift.alias(f"_{axis}b"), wide.alias(f"_{axis}s"),
                 F.col(f"s.{n}").alias(f"_{axis}n"), F.col(f"t.{n}").alias(f"_{axis}t")]
    return both.select(*cols)


def resample_to(
    px: DataFrame, values: Sequence[str], source: DataFrame, target: DataFrame, how: str = "bilinear",
    keys: Sequence[str] = ("scene",), tile: int = TILE,
) -> DataFrame:
    """All ``values`` of ``px`` (keys, r, c) on the target grid: nearest, bilinear or cubic (a = -0.5).

    Origins and pixel sizes may differ by any amount; both grids must run the same way.
    Where target pixels are larger than source pixels the kernel is stretched over them.
    Weights of masked (NULL) or missing sources are shared among the present ones.  Target
    pixels come back when their centre lies on the source image and a source pixel is near;
    their value is NULL if all near ones are masked.  Images without both grids are left out.

    Source pixels go once to each target tile they reach; the sums along columns and then
    along rows stay inside a tile, so there is one shuffle for all bands.
    """
    keys, reach = list(keys), REACH[how]
    t = px.select(*keys, "r", "c", *values).join(_scales(source, target, keys, how), keys)
    for axis in "rc":
        at, a, b, s = F.col(axis), F.col(f"_{axis}a"), F.col(f"_{axis}b"), F.col(f"_{axis}s")
        t = t.withColumns({
            f"_{axis}0": F.greatest(F.ceil((at - s * reach - b) / a), F.lit(0)),
            f"_{axis}1": F.least(F.floor((at + s * reach - b) / a), F.col(f"_{axis}t") - 1)})
    t = t.where("_r0 <= _r1 and _c0 <= _c1")
    for axis in "rc":
        first, last = F.floor(F.col(f"_{axis}0") / tile), F.floor(F.col(f"_{axis}1") / tile)
        t = t.withColumn(f"_t{axis}", F.explode(F.sequence(first, last)))
    place = [*keys, "_tr", "_tc"]
    size = target.agg(F.sum(F.col("width").cast("bigint") * F.col("height"))).first()[0] or 0
    t = t.repartition(parts_for(t.sparkSession, size), *place)

    def spread(df: DataFrame, axis: str) -> DataFrame:
        """One row per target index of the tile the source reaches, with its weight ``_w``."""
        low = F.greatest(F.col(f"_{axis}0"), F.col(f"_t{axis}") * tile)
        high = F.least(F.col(f"_{axis}1"), F.col(f"_t{axis}") * tile + (tile - 1))
        df = df.withColumn(f"_{axis}", F.explode(F.sequence(low, high)))
        pos = F.col(f"_{axis}") * F.col(f"_{axis}a") + F.col(f"_{axis}b")
        df = df.where((pos >= -0.5) & (pos < F.col(f"_{axis}n") - 0.5))
        return df.withColumn("_w", _kernel((pos - F.col(axis)) / F.col(f"_{axis}s"), how)).where("_w != 0")

    wide = spread(t, "c")
    wide = wide.groupBy(*place, "r", "_c", "_ra", "_rb", "_rs", "_rn", "_r0", "_r1").agg(
        *[F.sum(F.col("_w") * F.col(v)).alias(f"_n_{v}") for v in values],
        *[F.sum(F.when(F.col(v).isNotNull(), F.col("_w"))).alias(f"_d_{v}") for v in values])
    full = spread(wide, "r").groupBy(*place, "_r", "_c").agg(
        *[F.try_divide(F.sum(F.col("_w") * F.col(f"_n_{v}")), F.sum(F.col("_w") * F.col(f"_d_{v}"))).alias(v) for v in values])
    return full.select(*keys, F.col("_r").alias("r"), F.col("_c").alias("c"), *values)


# --- windows ---------------------------------------------------------------------------

def image_size(px: DataFrame) -> DataFrame:
    return px.groupBy("scene").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))


def common_size(lr: DataFrame, hr: DataFrame, scale: int) -> DataFrame:
    """(scene, h, w) in low-resolution pixels that both images cover."""
    a, b = image_size(lr).alias("a"), image_size(hr).alias("b")
    fit = lambda c: F.least(F.col(f"a.{c}"), F.floor(F.col(f"b.{c}") / scale)).cast("bigint").alias(c)
    return a.join(b, "scene").select("scene", fit("h"), fit("w"))


def window_shares(
    images: Mapping[str, tuple[DataFrame, int]], dims: DataFrame, bands: Sequence[str], size: int, stride: int = 1, nodata: float = 0.0,
) -> DataFrame:
    """(scene, h, w, y0, x0, <name> ...): valid share of each window of ``size`` that fits, per image.

    ``images``: name -> (pixels, pixels per unit of ``dims``).  Pixels are counted once,
    into blocks of the largest size that divides size and stride; windows are running sums
    of block counts along rows, then along columns.  Missing and NULL values are not valid.
    """
    g = math.gcd(size, stride)
    names = list(images)

    def counts(name: str) -> DataFrame:
        px, scale = images[name]
        ok = sum((F.coalesce((F.col(b) != nodata).cast("bigint"), F.lit(0)) for b in bands), F.lit(0).cast("bigint"))
        block = lambda c: F.floor(F.col(c) / (g * scale)).cast("bigint")
        return px.select("scene", block("r").alias("_r"), block("c").alias("_c"),
                         *[(ok if n == name else F.lit(0).cast("bigint")).alias(n) for n in names])

    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(c) - 1) / g).cast("bigint")))
    frame = dims.where((F.col("h") >= size) & (F.col("w") >= size)).select("scene", upto("h").alias("_r"), "w").repartition(
        parts_for(dims.sparkSession, 0), "scene", "_r").select("scene", "_r", upto("w").alias("_c"), *[F.lit(0).cast("bigint").alias(n) for n in names])
    blocks = reduce(DataFrame.unionByName, [counts(n) for n in names], frame).groupBy("scene", "_r", "_c").agg(
        *[F.sum(n).alias(n) for n in names])
    for across, on in (("_r", "_c"), ("_c", "_r")):
        run = W.partitionBy("scene", across).orderBy(on).rangeBetween(0, size // g - 1)
        blocks = blocks.withColumns({n: F.sum(n).over(run) for n in names})
    y, x = F.col("_r") * g, F.col("_c") * g
    fits = (y + size <= F.col("h")) & (x + size <= F.col("w")) & (y % stride == 0) & (x % stride == 0)
    return blocks.join(dims, "scene").where(fits).select(
        "scene", "h", "w", y.alias("y0"), x.alias("x0"),
        *[(F.col(n) / float((size * images[n][1]) ** 2 * len(bands))).alias(n) for n in names])


def draw_windows(shares: DataFrame, names: Sequence[str], size: int, n: int, seed: int, min_valid: float) -> DataFrame:
    """The ``n`` origins of each scene, valid in all of ``names``, with the smallest seeded number (all if fewer).

    A scene without any gets its centre, with ``valid`` false.
    """
    good = reduce(lambda a, b: a & b, [F.col(k) >= min_valid for k in names])
    number = seeded(seed, F.lit("o"), F.col("scene"), F.col("y0"), F.col("x0"))
    marked = shares.withColumn("_u", F.when(good, number))
    order = ["_u", "y0", "x0"]
    some = marked.where(F.col("_u").isNotNull()).withColumn("_part", F.pmod(F.col("y0"), F.lit(64)))
    few = some.withColumn("patch", F.row_number().over(W.partitionBy("scene", "_part").orderBy(*order))).where(F.col("patch") <= n)
    best = few.withColumn("patch", F.row_number().over(W.partitionBy("scene").orderBy(*order))).where(F.col("patch") <= n)
    centre = lambda c: (F.floor(F.col(c) / 2) - size // 2).cast("bigint")
    none = marked.groupBy("scene", "h", "w").agg(F.count("_u").alias("_n")).where("_n = 0")
    return best.select("scene", "patch", "y0", "x0", F.lit(True).alias("valid")).unionByName(
        none.select("scene", F.lit(1).alias("patch"), centre("h").alias("y0"), centre("w").alias("x0"), F.lit(False).alias("valid")))


def extract_patches(
    lr: DataFrame, hr: DataFrame, bands: Sequence[str], size: int = 64, scale: int = 3, stride: int | None = None,
    min_valid: float = 0.9, nodata: float = 0.0,
) -> DataFrame:
    """Origins (scene, y0, x0 in LR pixels) of patch pairs on a regular grid that are valid on both sides."""
    shares = window_shares({"lr_valid": (lr, 1), "hr_valid": (hr, scale)}, common_size(lr, hr, scale), bands, size, stride or size, nodata)
    return shares.where((F.col("lr_valid") >= min_valid) & (F.col("hr_valid") >= min_valid)).select(
        "scene", "y0", "x0", "lr_valid", "hr_valid")


def random_patches(
    px: DataFrame, bands: Sequence[str], size: int, n: int, seed: int, min_valid: float = 0.9, nodata: float = 0.0
) -> DataFrame:
    """Random valid origins of one image, as in ``draw_windows``; scenes no larger than a patch are left out."""
    dims = image_size(px).where((F.col("h") > size) & (F.col("w") > size))
    return draw_windows(window_shares({"share": (px, 1)}, dims, bands, size, 1, nodata), ["share"], size, n, seed, min_valid)


def random_patch_pairs(
    lr: DataFrame, hr: DataFrame, bands: Sequence[str], size: int, n: int, seed: int, scale: int = 3, min_valid: float = 0.9,
    nodata: float = 0.0,
) -> DataFrame:
    """Random origins (scene, patch, y0, x0 in LR pixels, valid) of patch pairs valid on both sides.

    As in ``draw_windows``.  Scenes no larger than a patch are left out.
    """
    dims = common_size(lr, hr, scale).where((F.col("h") > size) & (F.col("w") > size))
    shares = window_shares({"lr_valid": (lr, 1), "hr_valid": (hr, scale)}, dims, bands, size, 1, nodata)
    return draw_windows(shares, ["lr_valid", "hr_valid"], size, n, seed, min_valid)


def random_crop(
    lr: DataFrame, hr: DataFrame, size: int, crop: int, seed: int, scale: int = 3, key: Sequence[str] = ("scene", "y0", "x0"),
) -> tuple[DataFrame, DataFrame]:
    """The same seeded part of both sides of patch pairs (key, pr, pc): ``crop`` HR pixels, ``crop // scale`` LR pixels wide.

    ``size`` is the side of an LR patch.  ``crop`` of 0 or less keeps whole patches.
    """
    if crop <= 0:
        return lr, hr
    side = crop // scale
    if side > size:
        raise ValueError(f"crop of {side} pixels from patches of {size}")
    cols = [F.col(k) for k in key]
    top, left = (F.floor(seeded(seed, F.lit(t), *cols) * (size - side + 1)).cast("int") for t in ("top", "left"))

    def cut(px: DataFrame, n: int, m: int) -> DataFrame:
        p = px.withColumns({"pr": F.col("pr") - top * m, "pc": F.col("pc") - left * m})
        return p.where((F.col("pr") >= 0) & (F.col("pr") < n) & (F.col("pc") >= 0) & (F.col("pc") < n))

    return cut(lr, side, 1), cut(hr, crop, scale)
