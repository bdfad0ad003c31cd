"""Pixel-table operators.

A raster is a dense table of pixels keyed by optional ``keys`` (scene, band, ...) and
``r, c``; a masked pixel is a row with a NULL value.  Neighbourhood work runs inside
square tiles: each pixel is copied to the tiles whose halo it falls in, one shuffle
places tiles, and plain windows inside a tile replace wide self-joins.  A tile's size is
fixed, so one huge scene is spread like many small ones.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from terraloom.functions.fixed_values import RESISTANCE, RESISTANCE_DEFAULT, VALID_CLASSES
from terraloom.functions.scalars import seeded
from terraloom.scale import exact_percentiles, materialize, shuffled

TILE = 256


def tiled(px: DataFrame, k: int, keys: Sequence[str], tile: int = TILE) -> DataFrame:
    """Pixels copied to every tile (_tr, _tc) they or their ``k`` neighbours lie in, one shuffle."""
    def near(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - k) / tile), F.floor((F.col(c) + k) / tile)))

    return px.withColumn("_tr", near("r")).withColumn("_tc", near("c")).repartition(*keys, "_tr", "_tc")


def untile(df: DataFrame, tile: int = TILE) -> DataFrame:
    """Keep each pixel's own tile, drop halo copies."""
    own = (F.floor(F.col("r") / tile) == F.col("_tr")) & (F.floor(F.col("c") / tile) == F.col("_tc"))
    return df.where(own).drop("_tr", "_tc")


def _axes(keys: Sequence[str]):
    return W.partitionBy(*keys, "_tr", "_tc", "r").orderBy("c"), W.partitionBy(*keys, "_tr", "_tc", "c").orderBy("r")


def neighbours(px: DataFrame, value: str, k: int = 1, keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Add ``nb``: array of 2k+1 rows (north first) of 2k+1 values (west first); missing is NULL."""
    along, down = _axes(keys)
    t = tiled(px, k, keys, tile)
    row = F.array(*[F.first(value).over(along.rangeBetween(d, d)) for d in range(-k, k + 1)])
    t = t.withColumn("_row", row)
    t = t.withColumn("nb", F.array(*[F.first("_row").over(down.rangeBetween(d, d)) for d in range(-k, k + 1)]))
    return untile(t.drop("_row"), tile)


def focal(
    px: DataFrame, cols: Sequence[str], radius: int, how: str | Sequence[str], keys: Sequence[str] = (), shape: str = "square", tile: int = TILE
) -> DataFrame:
    """Moving-window min, max, mean, sum or count of the valid pixels within ``radius``; several from one placement in tiles."""
    hows = [how] if isinstance(how, str) else list(how)
    along, down = _axes(keys)
    t = tiled(px, radius, keys, tile)
    widths = {d: radius if shape == "square" else int(math.sqrt(radius * radius - d * d)) for d in range(-radius, radius + 1)}
    parts = {"min": ["min"], "max": ["max"], "sum": ["sum"], "count": ["count"], "mean": ["sum", "count"]}
    parts = list(dict.fromkeys(p for h in hows for p in parts[h]))
    fns = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
    t = t.withColumns({
        f"_h_{p}_{c}_{w}": fns[p](c).over(along.rangeBetween(-w, w)) for c in cols for p in parts for w in set(widths.values())})
    again = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.sum}

    def vertical(c: str, p: str) -> Column:
        if shape == "square":
            return again[p](f"_h_{p}_{c}_{radius}").over(down.rangeBetween(-radius, radius))
        hits = [F.first(f"_h_{p}_{c}_{w}").over(down.rangeBetween(d, d)) for d, w in widths.items()]
        if p in ("min", "max"):
            return (F.least if p == "min" else F.greatest)(*hits) if len(hits) > 1 else hits[0]
        return sum((F.coalesce(h, F.lit(0)) for h in hits), F.lit(0))

    out = t.withColumns({f"_v_{p}_{c}": vertical(c, p) for c in cols for p in parts})
    out = out.withColumns({
        f"{h}_{c}": F.try_divide(F.col(f"_v_sum_{c}"), F.col(f"_v_count_{c}").cast("double")) if h == "mean" else F.col(f"_v_{h}_{c}")
        for h in hows for c in cols})
    return untile(out.drop(*[c for c in out.columns if c.startswith(("_h_", "_v_"))]), tile)


def _gradient(df: DataFrame, cell: float) -> DataFrame:
    """Horn 3 x 3 gradient; NULL unless all nine pixels are valid."""
    z = lambda i, j: F.get(F.get(F.col("nb"), i), j)
    gx = ((z(0, 2) + 2 * z(1, 2) + z(2, 2)) - (z(0, 0) + 2 * z(1, 0) + z(2, 0))) / (8 * cell)
    gy = ((z(2, 0) + 2 * z(2, 1) + z(2, 2)) - (z(0, 0) + 2 * z(0, 1) + z(0, 2))) / (8 * cell)
    return df.withColumns({"_gx": gx, "_gy": gy})


def terrain(
    dem: DataFrame, layers: Sequence[str], value: str = "z", cell: float = 30.0, azimuth: float = 315.0, altitude: float = 45.0,
    z_factor: float = 1.0, keys: Sequence[str] = (),
) -> DataFrame:
    """Any of slope (degrees), slope_pct and hillshade (illumination 0..255), from one gradient."""
    g = _gradient(neighbours(dem, value, 1, keys), cell)
    rise = F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))
    gx, gy = F.col("_gx") * z_factor, F.col("_gy") * z_factor
    zenith, az = math.radians(90 - altitude), math.radians(360 - azimuth + 90)
    s = F.atan(F.sqrt(gx * gx + gy * gy))
    shade = math.cos(zenith) * F.cos(s) + math.sin(zenith) * F.sin(s) * F.cos(az - F.atan2(gy, -gx))
    made = {"slope": F.degrees(F.atan(rise)), "slope_pct": rise * 100, "hillshade": F.greatest(shade, F.when(shade.isNotNull(), 0e0)) * 255}
    return g.withColumns({name: made[name] for name in layers}).drop("nb", "_gx", "_gy")


def slope(dem: DataFrame, value: str = "z", cell: float = 30.0, percent: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    name = "slope_pct" if percent else "slope"
    return terrain(dem, [name], value, cell, keys=keys).withColumnRenamed(name, "slope")


def hillshade(
    dem: DataFrame, value: str = "z", cell: float = 30.0, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Illumination 0..255 of the surface."""
    return terrain(dem, ["hillshade"], value, cell, azimuth, altitude, z_factor, keys)


def _weights(factor: int, child: int, how: str) -> dict[int, float]:
    """Source offset -> weight for the ``child``-th target row inside a source pixel."""
    pos = (child + 0.5) / factor - 0.5
    if how == "nearest":
        return {0: 1.0}
    base = math.floor(pos)
    f = pos - base
    if how == "bilinear":
        w = {base: 1 - f, base + 1: f}
    else:  # cubic convolution, a = -0.5
        def k(x: float) -> float:
            x = abs(x)
            if x <= 1:
                return 1.5 * x**3 - 2.5 * x**2 + 1
            return -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0

        w = {base + i: k(f - i) for i in (-1, 0, 1, 2)}
    return {o: v for o, v in w.items() if v != 0}


def resample(px: DataFrame, value: str, factor: int, how: str = "bilinear", keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Pixels ``factor`` times smaller on the same origin.

    Every target pixel lies inside one source pixel, so its 1, 4 or 16 sources are that
    pixel's neighbours: one tile shuffle, then fixed weights.  Weights of missing sources
    are shared among the present ones.
    """
    k = {"nearest": 0, "bilinear": 1, "cubic": 2}[how]
    nb = neighbours(px, value, k, keys, tile)
    children = []
    for i in range(factor):
        for j in range(factor):
            num, den = F.lit(0e0), F.lit(0e0)
            for dr, wr in _weights(factor, i, how).items():
                for dc, wc in _weights(factor, j, how).items():
                    v = F.get(F.get(F.col("nb"), k + dr), k + dc)
                    num = num + F.coalesce(v * (wr * wc), F.lit(0e0))
                    den = den + F.when(v.isNotNull(), wr * wc).otherwise(0e0)
            children.append(F.struct(
                (F.col("r") * factor + i).alias("r"), (F.col("c") * factor + j).alias("c"),
                F.try_divide(num, den).alias(value)))
    return nb.select(*keys, F.explode(F.array(*children)).alias("t")).select(*keys, "t.*")


def project_shadow(
    px: DataFrame, azimuth: Column, max_steps: int = 20, step: float = 1.0, erode: int = 2, dilate: int = 5, keys: Sequence[str] = ("scene",)
) -> DataFrame:
    """Add ``masked``: cloud, or dark pixel in the direction the cloud's shadow falls.

    ``px`` has booleans cloud and dark and the solar azimuth in degrees.  The flag is
    eroded and then dilated before it is returned.
    """
    keys = list(keys)
    angle = F.radians(90 - azimuth)
    i = F.explode(F.sequence(F.lit(1), F.lit(max_steps)))
    cast = (
        px.where("cloud").select(*keys, "r", "c", angle.alias("a"), i.alias("i"))
        .select(
            *keys,
            (F.col("r") - F.floor(F.col("i") * step * F.sin("a") + 0.5)).alias("r"),
            (F.col("c") + F.floor(F.col("i") * step * F.cos("a") + 0.5)).alias("c"))
        .distinct().withColumn("_cast", F.lit(True))
    )
    joined = px.join(shuffled(cast), [*keys, "r", "c"], "left")
    flag = F.when(F.col("cloud") | (F.col("dark") & F.col("_cast").isNotNull()), 1).otherwise(0)
    flagged = joined.withColumn("flag", flag).drop("_cast")
    small = focal(flagged, ["flag"], erode, "min", keys, "circle")
    grown = focal(small, ["min_flag"], dilate, "max", keys, "circle")
    return grown.withColumn("masked", F.col("max_min_flag") == 1).drop("min_flag", "max_min_flag")


def apply_mask(px: DataFrame, bands: Sequence[str], masked: str = "masked") -> DataFrame:
    return px.withColumns({b: F.when(~F.col(masked), F.col(b)) for b in bands})


def clip(px: DataFrame, extent: tuple[int, int, int, int] | None = None, mask: DataFrame | None = None, on=("r", "c")) -> DataFrame:
    """Pixels of a window (r0, c0, r1, c1; end exclusive) and/or of a mask table."""
    if extent:
        r0, c0, r1, c1 = extent
        px = px.where((F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1))
    return px.join(shuffled(mask.select(*on)), list(on), "left_semi") if mask is not None else px


def overlay_cells(a: DataFrame, b: DataFrame, how: str, on=("r", "c")) -> DataFrame:
    """Clip, intersection, union or difference of rasterized layers."""
    on = list(on)
    if how == "clip":
        return a.join(shuffled(b.select(*on)), on, "left_semi")
    if how == "difference":
        return a.join(shuffled(b.select(*on)), on, "left_anti")
    return a.join(shuffled(b), on, {"intersection": "inner", "union": "full"}[how])


# --- time ------------------------------------------------------------------------------

def regular_dates(steps: DataFrame, first: str, step: str = "step") -> DataFrame:
    return steps.withColumn("date", F.date_add(F.lit(first).cast("date"), F.col(step).cast("int")))


def interpolate_linear(
    px: DataFrame, bands: Sequence[str], step_days: int, key: Sequence[str] = ("pix",), dt: str = "dt",
    span: tuple[str, str] | None = None,
) -> DataFrame:
    """Regular series per pixel: linear between the nearest valid dates on both sides.

    Steps run from the first date of the collection (or ``span``) to one day before the
    last; a step without both neighbours repeats the previous result.  Each observation
    itself produces the steps up to the next one, so pixels are placed once.  One row per
    pixel and date is expected, which bounds a pixel's window by the calendar.
    """
    key = list(key)
    if span:
        ends = F.struct(F.lit(span[0]).cast("date").alias("a"), F.lit(span[1]).cast("date").alias("b"))
    else:
        ends = px.agg(F.struct(F.min(dt).alias("a"), F.max(dt).alias("b"))).scalar()
    at = W.partitionBy(*key).orderBy(dt)
    seen = at.rowsBetween(W.unboundedPreceding, 0)
    # the mirrored order keeps the look-ahead a running frame, linear in the series length
    ahead = W.partitionBy(*key).orderBy(F.desc(dt)).rowsBetween(W.unboundedPreceding, -1)
    cols = {"_next": F.lead(dt).over(at), "_head": F.row_number().over(at) == 1}
    for b in bands:
        valid = F.when(F.col(b).isNotNull(), F.struct(F.unix_date(dt).alias("t"), F.col(b).alias("v")))
        cols[f"_lo_{b}"] = F.max(valid).over(seen)
        cols[f"_hi_{b}"] = F.min(valid).over(ahead)
    rows = px.select(*key, dt, *bands).withColumns(cols).withColumn("_s", ends)
    here, limit = F.datediff(dt, "_s.a"), F.datediff("_s.b", "_s.a") - 1
    first = F.when(F.col("_head"), 0).otherwise((F.ceil(here / step_days) * step_days).cast("int"))
    last = F.least(F.coalesce(F.datediff("_next", "_s.a") - 1, limit), limit)
    steps = rows.withColumns({"_first": first, "_last": last}).where("_first <= _last").withColumn(
        "step", F.explode(F.sequence("_first", "_last", F.lit(step_days))))
    steps = steps.withColumn("_day", F.unix_date("_s.a") + F.col("step"))
    fill = W.partitionBy(*key).orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    day, out = F.col("_day"), {}
    for b in bands:
        lo, hi = F.col(f"_lo_{b}"), F.col(f"_hi_{b}")
        value = F.when(day == lo["t"], lo["v"]).when(
            day > lo["t"], lo["v"] + (hi["v"] - lo["v"]) * (day - lo["t"]) / F.nullif(hi["t"] - lo["t"], F.lit(0)))
        out[b] = F.last(value, ignorenulls=True).over(fill)
    return steps.select(*key, "step", F.date_from_unix_date("_day").alias(dt), *[v.alias(b) for b, v in out.items()])


def composite(px: DataFrame, value: str, how: str, key: Sequence[str] = ("r", "c"), dt: str = "dt") -> DataFrame:
    """One value per pixel over time: max, min, sum, mean, mode, first or last valid."""
    key = list(key)
    valid = px.where(F.col(value).isNotNull())
    if how == "mode":
        counts = valid.groupBy(*key, value).agg(F.count("*").alias("_n"))
        return counts.groupBy(*key).agg(F.max_by(value, F.struct("_n", -F.col(value))).alias(value))
    agg = {
        "max": F.max(value), "min": F.min(value), "sum": F.sum(value), "mean": F.avg(value),
        "first": F.min_by(value, F.struct(dt, value)), "last": F.max_by(value, F.struct(dt, value)),
    }[how]
    return valid.groupBy(*key).agg(agg.alias(value))


def quality_mosaic(
    px: DataFrame, by: str, take: str, date_from: str, date_to: str, key: Sequence[str] = ("r", "c"), dt: str = "dt"
) -> DataFrame:
    """``take`` where ``by`` is largest in a half-open date window; ties go to the latest date."""
    inside = px.where((F.col(dt) >= F.lit(date_from).cast("date")) & (F.col(dt) < F.lit(date_to).cast("date")) & F.col(by).isNotNull())
    return inside.groupBy(*key).agg(F.max_by(take, F.struct(by, dt)).alias(take))


def land_cover_consensus(px: DataFrame, layers: Sequence[str], at_least: int = 7) -> DataFrame:
    """Votes of boolean layers (null counts as no) and the agreed mask."""
    votes = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in layers), F.lit(0))
    return px.withColumn("votes", votes).withColumn("agreed", F.col("votes") >= at_least)


# --- zones -----------------------------------------------------------------------------

def zonal_mean(px: DataFrame, zones: DataFrame, values: Sequence[str], zone: str = "zid", by: Sequence[str] = (), on=("r", "c")) -> DataFrame:
    """Mean per zone (and date); partial sums leave each task, not pixels."""
    return px.join(shuffled(zones), list(on)).groupBy(zone, *by).agg(*[F.avg(v).alias(v) for v in values])


def zonal_max(px: DataFrame, zones: DataFrame, value: str, zone: str = "zid", on=("r", "c")) -> DataFrame:
    """Zone maximum of the time-max composite."""
    top = px.groupBy(*on).agg(F.max(value).alias(value))
    return top.join(shuffled(zones), list(on)).groupBy(zone).agg(F.max(value).alias(value))


def permeability(
    px: DataFrame, zones: DataFrame | None, zone: Sequence[str], resistance: Mapping[int, float] = RESISTANCE, on=("r", "c"), value: str = "cls"
) -> DataFrame:
    """100 minus the mean resistance of the valid classes per zone; 50 where none is valid.

    Without ``zones`` the pixels carry the zone columns themselves.
    """
    table = F.create_map(*[F.lit(v) for kv in resistance.items() for v in kv])
    cost = F.coalesce(F.element_at(table, F.col(value)), F.lit(RESISTANCE_DEFAULT))
    ok = F.col(value).between(*VALID_CLASSES)
    if zones is None:
        counts = px.groupBy(*zone, F.when(ok, F.col(value)).alias(value)).agg(F.count_if(ok).alias("n"))
        m = counts.groupBy(*zone).agg(F.round(100 - F.sum(cost * F.col("n")) / F.nullif(F.sum("n"), F.lit(0)), 2).alias("permeability"))
        return m.fillna({"permeability": 50.0})
    valid = px.where(ok).join(shuffled(zones), list(on))
    counts = valid.groupBy(*zone, value).agg(F.count("*").alias("n"))
    m = counts.groupBy(*zone).agg(F.round(100 - F.sum(cost * F.col("n")) / F.sum("n"), 2).alias("permeability"))
    return zones.select(*zone).distinct().join(shuffled(m), list(zone), "left").fillna({"permeability": 50.0})


def global_band_stats(px: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Mean and population deviation of the positive values of all scenes per band, in one pass of sums."""
    aggs = []
    for b in bands:
        v = F.when(F.col(b) > 0, F.col(b))
        aggs += [F.avg(v).alias(f"m_{b}"), F.avg(v * v).alias(f"q_{b}"), F.count(v).alias(f"n_{b}")]
    one = px.agg(*aggs)
    rows = [F.struct(
        F.lit(b).alias("band"), F.col(f"n_{b}").alias("n"), F.col(f"m_{b}").alias("mean"),
        F.sqrt(F.greatest(F.col(f"q_{b}") - F.col(f"m_{b}") * F.col(f"m_{b}"), F.lit(0e0))).alias("std")) for b in bands]
    return one.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def range_limits(px: DataFrame, value: str, mode: str, k: float = 2.0) -> DataFrame:
    """Display range: cumulative 2-98 %, min/max or mean +- k deviations."""
    if mode == "cumulative":
        return exact_percentiles(px, value, {"lo": 0.02, "hi": 0.98})
    if mode == "minmax":
        return px.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    m, s = F.avg(value), F.stddev_pop(value)
    return px.agg((m - k * s).alias("lo"), (m + k * s).alias("hi"))


def stack_bands(px: DataFrame, bands: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Long (band, value) to one column per band in a fixed order."""
    return px.groupBy(*keys).agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in bands])


def unstack_bands(px: DataFrame, bands: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return px.unpivot(list(keys), list(bands), "band", "value")


def contour(px: DataFrame, value: str, interval: float, keys: Sequence[str] = ()) -> DataFrame:
    """Contour segments (level, x0, y0, x1, y1) from each 2 x 2 block of pixel centres."""
    nb = neighbours(px, value, 1, keys)
    z = lambda i, j: F.get(F.get(F.col("nb"), 1 + i), 1 + j)
    corners = nb.select(*keys, "r", "c", *[z(i, j).alias(f"z{i}{j}") for i in (0, 1) for j in (0, 1)]).dropna()
    zs = [F.col(n) for n in ("z00", "z01", "z10", "z11")]
    lo, hi = F.least(*zs), F.greatest(*zs)
    first, last = F.floor(lo / interval) + 1, F.floor(hi / interval)
    lv = corners.where(first <= last).withColumn("level", F.explode(F.sequence(first, last))).withColumn(
        "level", F.col("level") * F.lit(float(interval)))
    c, r, level = F.col("c"), F.col("r"), F.col("level")

    def cross(a: str, b: str, xa, ya, xb, yb) -> Column:
        za, zb = F.col(a), F.col(b)
        t = (level - za) / (zb - za)
        hit = (za >= level) != (zb >= level)
        return F.when(hit, F.struct((xa + (xb - xa) * t).alias("x"), (ya + (yb - ya) * t).alias("y")))

    top, bottom = cross("z00", "z01", c, r, c + 1, r), cross("z10", "z11", c, r + 1, c + 1, r + 1)
    left, right = cross("z00", "z10", c, r, c, r + 1), cross("z01", "z11", c + 1, r, c + 1, r + 1)
    seg = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    mid = (F.col("z00") + F.col("z01") + F.col("z10") + F.col("z11")) / 4
    all4 = top.isNotNull() & bottom.isNotNull() & left.isNotNull() & right.isNotNull()
    pts = F.array_compact(F.array(top, right, bottom, left))
    one = F.array(seg(F.get(pts, 0), F.get(pts, 1)))
    segs = F.when(all4 & ((F.col("z00") >= level) == (mid >= level)), F.array(seg(top, right), seg(bottom, left))).when(
        all4, F.array(seg(top, left), seg(bottom, right))).otherwise(one)
    return lv.select(*keys, "level", F.explode(segs).alias("s")).select(
        *keys, "level", F.col("s.p.x").alias("x0"), F.col("s.p.y").alias("y0"), F.col("s.q.x").alias("x1"), F.col("s.q.y").alias("y1"))


# --- patches ---------------------------------------------------------------------------

def normalize(px: DataFrame, how: str, keys: Sequence[str] = ("scene", "band"), value: str = "value", stats: DataFrame | None = None) -> DataFrame:
    """Scale values per (scene, band): minmax, percentile (2-98 of positive values), zscore or none.

    ``histogram`` uses the percentile rule.  ``stats`` (band, mean, std) replaces the
    scene's own statistics for zscore.
    """
    keys = list(keys)
    if how == "none":
        return px
    v = F.col(value)
    if how == "minmax":
        s = px.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    elif how in ("percentile", "histogram"):
        s = exact_percentiles(px.where(v > 0), value, {"_lo": 0.02, "_hi": 0.98}, keys)
    elif stats is not None:
        s = stats.select("band", F.col("mean").alias("_mean"), F.col("std").alias("_std"))
        keys = ["band"]
    else:
        s = px.groupBy(*keys).agg(
            F.coalesce(F.avg(F.when(v > 0, v)), F.lit(0e0)).alias("_mean"),
            F.coalesce(F.stddev_pop(F.when(v > 0, v)), F.lit(1e0)).alias("_std"))
    j = px.join(s, keys, "left")
    return j.withColumn(value, _scaled(v, how, *[F.col(c) for c in (("_mean", "_std") if how == "zscore" else ("_lo", "_hi"))])).select(*px.columns)


def _scaled(v: Column, how: str, a: Column, b: Column) -> Column:
    """``v`` from its group's mean and deviation (zscore) or limits."""
    if how == "zscore":
        return (v - a) / F.greatest(b, F.lit(1e-8))
    out = F.coalesce(F.try_divide(v - a, F.nullif(b - a, F.lit(0e0))), F.when(v.isNotNull(), 0e0))
    return out if how == "minmax" else F.least(F.greatest(out, F.lit(0e0)), F.lit(1e0))


def normalize_bands(px: DataFrame, bands: Sequence[str], how: str, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """``normalize`` for tables with a column per band: the pixels themselves are joined once to one row of statistics per key."""
    keys = list(keys)
    if how == "none":
        return px
    if how in ("percentile", "histogram"):
        s = band_percentiles(px, bands, {"a": 0.02, "b": 0.98}, keys)
    else:
        aggs = []
        for c in bands:
            v = F.when(F.col(c) > 0, F.col(c))
            aggs += [F.min(c).alias(f"_a_{c}"), F.max(c).alias(f"_b_{c}")] if how == "minmax" else [
                F.coalesce(F.avg(v), F.lit(0e0)).alias(f"_a_{c}"), F.coalesce(F.stddev_pop(v), F.lit(1e0)).alias(f"_b_{c}")]
        s = px.groupBy(*keys).agg(*aggs)
    j = px.join(shuffled(materialize(s)), keys, "left")
    return j.withColumns({c: _scaled(F.col(c), how, F.col(f"_a_{c}"), F.col(f"_b_{c}")) for c in bands}).select(*px.columns)


def band_percentiles(px: DataFrame, bands: Sequence[str], probs: Mapping[str, float], keys: Sequence[str]) -> DataFrame:
    """Exact percentiles (``_<name>_<band>``) of the positive values of each band, one row per key.

    Values are counted in fixed bins (64 to a power of two) before any shuffle; the counts
    tell which bins hold the wanted places, and only values of those bins are ordered.
    Pixels are placed once, for that look-up.
    """
    keys = list(keys)
    long = lambda df, *more: df.select(*keys, *more, F.explode(F.array(*[
        F.struct(F.lit(c).alias("_band"), F.col(c).cast("double").alias("_v")) for c in bands])).alias("_p")).select(*keys, *more, "_p.*").where("_v > 0")
    bin_ = F.when(F.isnan("_v"), F.lit(2**63 - 1)).otherwise(F.floor(F.log2("_v") * 64))
    group = [*keys, "_band"]
    counts = long(px).groupBy(*group, bin_.alias("_bin")).agg(F.count("*").alias("_n"))
    places = [end(F.lit(float(p)) * (F.col("_all") - 1)) for p in probs.values() for end in (F.floor, F.ceil)]
    cum = counts.withColumns({
        "_cum": F.sum("_n").over(W.partitionBy(*group).orderBy("_bin")), "_all": F.sum("_n").over(W.partitionBy(*group))})
    hit = F.lit(False)
    for at in places:
        hit = hit | ((at < F.col("_cum")) & (at >= F.col("_cum") - F.col("_n")))
    wanted = materialize(cum.where(hit).groupBy(*keys).agg(F.collect_list(F.struct("_band", "_bin", (F.col("_cum") - F.col("_n")).alias("_before"), "_all")).alias("_want")))
    found = long(px.select(*keys, *bands).join(shuffled(wanted), keys), "_want").withColumn("_bin", bin_)
    found = found.withColumn("_at", F.explode(F.filter("_want", lambda w: (w["_band"] == F.col("_band")) & (w["_bin"] == F.col("_bin")))))
    values = found.groupBy(*group, "_bin", "_at._before", "_at._all", "_v").agg(F.count("*").alias("_n"))
    values = values.withColumn("_cum", F.col("_before") + F.sum("_n").over(W.partitionBy(*group, "_bin").orderBy("_v")))
    picks = []
    for i, (name, p) in enumerate(probs.items()):
        pos = F.lit(float(p)) * (F.col("_all") - 1)
        for c in bands:
            of = F.col("_band") == c
            lo, hi = (F.min(F.when(of & (F.col("_cum") > at), F.col("_v"))) for at in places[2 * i:2 * i + 2])
            picks.append((lo + (hi - lo) * F.max(F.when(of, pos - F.floor(pos)))).alias(f"_{name}_{c}"))
    return values.groupBy(*keys).agg(*picks)


# --- patches ---------------------------------------------------------------------------

def patch_pixels(px: DataFrame, patches: DataFrame, size: int, scale: int = 1) -> DataFrame:
    """Pixels of each patch with coordinates inside the patch."""
    n = size * scale
    cells = patches.select("scene", "y0", "x0").withColumn("pr", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        "pc", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns(
        {"r": F.col("y0") * scale + F.col("pr"), "c": F.col("x0") * scale + F.col("pc")})
    return cells.join(shuffled(px), ["scene", "r", "c"])


def augment(patches: DataFrame, size: int, seed: int, key: Sequence[str] = ("scene", "y0", "x0")) -> DataFrame:
    """Seeded flips and quarter turns of (pr, pc); the same key turns both resolutions alike."""
    cols = [F.col(k) for k in key]
    p, q, m = F.col("pr"), F.col("pc"), size - 1
    p1 = F.when(seeded(seed, F.lit("v"), *cols) < 0.5, m - p).otherwise(p)
    q1 = F.when(seeded(seed, F.lit("h"), *cols) < 0.5, m - q).otherwise(q)
    k = F.floor(seeded(seed, F.lit("r"), *cols) * 4)
    out = patches.withColumns({"_p": p1, "_q": q1, "_k": k})
    a, b, k = F.col("_p"), F.col("_q"), F.col("_k")
    return out.withColumns({
        "pr": F.when(k == 0, a).when(k == 1, m - b).when(k == 2, m - a).otherwise(b),
        "pc": F.when(k == 0, b).when(k == 1, a).when(k == 2, m - b).otherwise(m - a),
    }).drop("_p", "_q", "_k")


def jitter(patches: DataFrame, bands: Sequence[str], seed: int, amount: float = 0.05, key: Sequence[str] = ("scene", "y0", "x0")) -> DataFrame:
    """Per-band gain in 1 +- amount; the same key gives both resolutions the same gain."""
    cols = [F.col(k) for k in key]
    return patches.withColumns({
        b: F.col(b) * (1 + (2 * seeded(seed, F.lit(b), *cols) - 1) * amount) for b in bands})


def cutout(
    patches: DataFrame, bands: Sequence[str], size: int, seed: int, fraction: float = 0.1, chance: float = 0.5,
    key: Sequence[str] = ("scene", "y0", "x0"),
) -> DataFrame:
    """Zero one seeded square hole, ``fraction`` of the side wide, in a ``chance`` share of the patches."""
    cols, hole = [F.col(k) for k in key], int(size * fraction)
    y, x = (F.floor(seeded(seed, F.lit(t), *cols) * (size - hole + 1)) for t in ("cy", "cx"))
    inside = (F.col("pr") >= y) & (F.col("pr") < y + hole) & (F.col("pc") >= x) & (F.col("pc") < x + hole)
    hit = inside & (seeded(seed, F.lit("cut"), *cols) < chance)
    return patches.withColumns({b: F.when(hit, 0e0).otherwise(F.col(b)) for b in bands})


def tile_origins(dims: DataFrame, size: int, overlap: int) -> DataFrame:
    """Overlapping tile origins, the last ones clamped to the edge, 0 for scenes smaller than a tile; dims = (scene, h, w)."""
    stride = size - overlap

    def starts(c: str) -> Column:
        n = F.greatest(F.lit(1), F.ceil((F.col(c) - overlap) / stride))
        return F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1), lambda i: F.greatest(F.least(i * stride, F.col(c) - size), F.lit(0))))

    return dims.withColumn("y0", starts("h")).withColumn("x0", starts("w"))


def blend_weight(pos: Column, size: int, overlap: int) -> Column:
    """Raised-cosine ramp at both ends of a tile."""
    if overlap <= 0:
        return F.lit(1e0)
    ramp = lambda i: 0.5 * (1 - F.cos(math.pi * i / float(max(overlap - 1, 1)))) if overlap > 1 else F.lit(0e0)
    left = F.when(pos < overlap, ramp(pos)).otherwise(1e0)
    right = F.when(pos >= size - overlap, ramp(size - 1 - pos)).otherwise(1e0)
    return left * right


def blend_tiles(tiles: DataFrame, values: Sequence[str], size: int, overlap: int) -> DataFrame:
    """Weighted mean of overlapping tile pixels (scene, y0, x0, pr, pc, values)."""
    w = blend_weight(F.col("pr"), size, overlap) * blend_weight(F.col("pc"), size, overlap)
    t = tiles.withColumn("_w", w)
    sums = t.groupBy("scene", (F.col("y0") + F.col("pr")).alias("r"), (F.col("x0") + F.col("pc")).alias("c")).agg(
        F.sum("_w").alias("_w"), *[F.sum(F.col("_w") * F.col(v)).alias(v) for v in values])
    return sums.select("scene", "r", "c", *[(F.col(v) / F.greatest(F.col("_w"), F.lit(1e-8))).alias(v) for v in values])
