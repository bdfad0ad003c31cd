"""Image-quality measures between predicted and target pixel tables (scene, r, c, bands)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from terraloom.operators.raster import tiled, untile
from terraloom.scale import shuffled

PIXEL = ["scene", "r", "c"]


def pair(pred: DataFrame, target: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Join both images per pixel: p_<band>, t_<band>."""
    p = pred.select(*PIXEL, *[F.col(b).alias(f"p_{b}") for b in bands])
    t = target.select(*PIXEL, *[F.col(b).alias(f"t_{b}") for b in bands])
    return p.join(shuffled(t), PIXEL)


def _p(b: str) -> Column:
    return F.col(f"p_{b}")


def _t(b: str) -> Column:
    return F.col(f"t_{b}")


def _sum(cols) -> Column:
    return sum(cols, F.lit(0e0))


def _mse(b: str) -> Column:
    return F.avg((_p(b) - _t(b)) * (_p(b) - _t(b)))


def psnr(bands: Sequence[str], max_val: float = 1.0) -> Column:
    """Aggregate: image-level PSNR, infinite for equal images."""
    mse = _sum(_mse(b) for b in bands) / len(bands)
    return F.when(mse == 0, float("inf")).otherwise(10 * F.log10(max_val * max_val / F.nullif(mse, F.lit(0e0))))


def psnr_per_band(bands: Sequence[str]) -> Column:
    """Aggregate: mean of band PSNRs, 100 where a band is (almost) equal."""
    return _sum(F.when(_mse(b) < 1e-10, 100e0).otherwise(10 * F.log10(1 / F.nullif(_mse(b), F.lit(0e0)))) for b in bands) / len(bands)


def pixel_angle(bands: Sequence[str], rule: str = "sum") -> Column:
    """Spectral angle of a pixel in radians; rules differ in where they guard small norms."""
    dot = _sum(_p(b) * _t(b) for b in bands)
    np_, nt = F.sqrt(_sum(_p(b) * _p(b) for b in bands)), F.sqrt(_sum(_t(b) * _t(b) for b in bands))
    if rule == "sum":
        cos, lim = dot / (np_ * nt + 1e-8), 1.0
    else:
        eps = 1e-8 if rule == "metric" else 1e-6
        cos, lim = dot / (F.greatest(np_, F.lit(eps)) * F.greatest(nt, F.lit(eps))), 1 - eps
    return F.acos(F.least(F.greatest(cos, F.lit(-lim)), F.lit(lim)))


def sam(bands: Sequence[str], rule: str = "sum", degrees: bool = True) -> Column:
    """Aggregate: mean spectral angle."""
    mean = F.avg(pixel_angle(bands, rule))
    return F.degrees(mean) if degrees else mean


def ergas(bands: Sequence[str], scale: int = 3, clamp: bool = False) -> Column:
    """Aggregate: relative global error; bands with mean <= 0 are skipped, or their mean clamped."""
    parts = []
    for b in bands:
        mu = F.avg(_t(b))
        if clamp:
            parts.append(_mse(b) / F.pow(F.greatest(mu, F.lit(1e-8)), 2))
        else:
            parts.append(F.when(mu > 0, _mse(b) / F.nullif(mu * mu, F.lit(0e0))).otherwise(0e0))
    return 100.0 / scale * F.sqrt(_sum(parts) / len(bands))


def l1(bands: Sequence[str]) -> Column:
    return _sum(F.avg(F.abs(_p(b) - _t(b))) for b in bands) / len(bands)


def charbonnier(bands: Sequence[str], eps: float = 1e-6) -> Column:
    return _sum(F.avg(F.sqrt(F.pow(_p(b) - _t(b), 2) + eps * eps)) for b in bands) / len(bands)


def combined(bands: Sequence[str], l1_weight: float = 1.0, sam_weight: float = 0.1, charbonnier_weight: float = 0.0) -> Column:
    return l1(bands) * l1_weight + sam(bands, "loss", False) * sam_weight + charbonnier(bands) * charbonnier_weight


def spectral_gradient(bands: Sequence[str]) -> Column:
    """Aggregate: mean absolute difference of the steps between successive bands."""
    steps = list(zip(bands, bands[1:]))
    return _sum(F.avg(F.abs((_p(b) - _p(a)) - (_t(b) - _t(a)))) for a, b in steps) / len(steps)


# name -> aggregate over a paired table
METRICS: dict[str, Callable[[Sequence[str]], Column]] = {
    "psnr": psnr, "psnr_per_band": psnr_per_band, "sam": sam, "ergas": ergas, "l1": l1, "charbonnier": charbonnier,
    "combined": combined, "spectral_gradient": spectral_gradient,
}


def register_metric(name: str, fn: Callable[[Sequence[str]], Column]) -> None:
    METRICS[name] = fn


def measure(paired: DataFrame, bands: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Named metrics per scene in one aggregation."""
    return paired.groupBy("scene").agg(*[METRICS[n](bands).alias(n) for n in names])


def ssim_half(height: Column, width: Column) -> Column:
    """Half the side of the largest odd window of at most 7 pixels that fits; at least 1 (a window of 3)."""
    return F.least(F.greatest(F.floor((F.least(height, width) - 1) / 2), F.lit(1)), F.lit(3))


def _window_sums(px: DataFrame, cols: Sequence[str], half: str) -> DataFrame:
    """Sums over each pixel's own window of 2 * half + 1 pixels, half in 1, 2, 3.

    Positions are stretched by 6 / half, so that one frame of 6 spans every window size.
    """
    for at, line in (("c", "r"), ("r", "c")):
        run = W.partitionBy("scene", "_tr", "_tc", line).orderBy("_at").rangeBetween(-6, 6)
        px = px.withColumn("_at", F.col(at) * (6 / F.col(half)).cast("bigint"))
        px = px.withColumns({k: F.sum(k).over(run) for k in cols})
    return px.drop("_at")


def ssim(paired: DataFrame, bands: Sequence[str], data_range: float | None = 1.0) -> DataFrame:
    """Structural similarity per scene, averaged over bands.

    Uniform windows of 7 x 7 pixels, shrunk to 5 or 3 for scenes too small for that, with
    sample covariance; windows that leave the image do not count.  Scenes with a side below
    3 have no row.  ``data_range=None`` takes each target band's own range.
    """
    spans = [] if data_range is not None else [(F.max(f"t_{b}") - F.min(f"t_{b}")).alias(f"span_{b}") for b in bands]
    scenes = paired.groupBy("scene").agg(
        ssim_half(F.max("r") - F.min("r") + 1, F.max("c") - F.min("c") + 1).alias("half"), *spans)
    cols = {"one": F.lit(1)}
    for b in bands:
        cols |= {f"a_{b}": _p(b), f"b_{b}": _t(b), f"aa_{b}": _p(b) * _p(b), f"bb_{b}": _t(b) * _t(b), f"ab_{b}": _p(b) * _t(b)}
    moments = paired.select(*PIXEL, *[v.alias(k) for k, v in cols.items()]).join(scenes, "scene")
    n = F.pow(2 * F.col("half") + 1, 2)
    win = untile(_window_sums(tiled(moments, 3, ["scene"]), list(cols), "half")).where(F.col("one") == n)
    aggs = []
    for b in bands:
        s = lambda k: F.col(f"{k}_{b}") / n
        ux, uy = s("a"), s("b")
        norm = n / (n - 1)
        vx, vy, vxy = norm * (s("aa") - ux * ux), norm * (s("bb") - uy * uy), norm * (s("ab") - ux * uy)
        r = F.lit(data_range) if data_range is not None else F.col(f"span_{b}")
        c1, c2 = F.pow(0.01 * r, 2), F.pow(0.03 * r, 2)
        aggs.append(F.avg((2 * ux * uy + c1) * (2 * vxy + c2) / ((ux * ux + uy * uy + c1) * (vx + vy + c2))))
    return win.groupBy("scene").agg((_sum(aggs) / len(bands)).alias("ssim"))


def evaluate(pred: DataFrame, target: DataFrame, bands: Sequence[str], scale: int = 3) -> DataFrame:
    """PSNR, SSIM, SAM and ERGAS per image."""
    paired = pair(pred, target, bands)
    one = paired.groupBy("scene").agg(
        psnr(bands).alias("psnr"), sam(bands).alias("sam"), ergas(bands, scale).alias("ergas"))
    return one.join(ssim(paired, bands, data_range=None), "scene", "left")


def dataset_mean(per_image: DataFrame) -> DataFrame:
    cols = [c for c, t in per_image.dtypes if t == "double"]
    return per_image.agg(*[F.avg(c).alias(c) for c in cols], F.count("*").alias("images"))
