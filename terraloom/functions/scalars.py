"""Column expressions: classification, dates, indices, climate and crop-water formulas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from terraloom.functions.fixed_values import (
    ALBEDO_WEIGHTS, CLOUD_PROBABILITY, CORRECTION, DARK_NIR, KC_CURVE, KC_DAYS, REFLECTANCE_SCALE,
    THERMAL_SCALE, WATER_CLASS,
)


# --- classes ---------------------------------------------------------------------------

def reclass(col: Column, breaks: Sequence[float], values: Sequence) -> Column:
    """``values[i]`` for the first upper bound the value does not exceed, else the last value."""
    out = F.when(col.isNull(), None)
    for b, v in zip(breaks, values):
        out = out.when(col <= b, v)
    return out.otherwise(values[-1])


def remap(col: Column, sources: Sequence, targets: Sequence) -> Column:
    """Recode listed values; anything else becomes null."""
    out = F.when(col == sources[0], targets[0])
    for s, t in zip(sources[1:], targets[1:]):
        out = out.when(col == s, t)
    return out


def classify_tier(col: Column, thresholds: Sequence[float], labels: Sequence[str], inclusive: bool = False) -> Column:
    """Label of the first threshold passed (highest first), else the last label."""
    out = None
    for t, label in zip(thresholds, labels):
        hit = col >= t if inclusive else col > t
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(labels[-1])


def weighted_overlay(factors: Mapping[str, float], maxima: Mapping[str, float], scale: float = 100.0) -> Column:
    """Weighted factor sum as a share of its largest possible value, times ``scale``."""
    top = sum((F.col(c) * F.lit(float(w)) for c, w in factors.items()), F.lit(0e0))
    return top / F.lit(float(sum(maxima[c] * w for c, w in factors.items()))) * F.lit(float(scale))


def linear_score(coefs: Mapping[str, float], intercept: float) -> Column:
    return sum((F.col(c) * F.lit(float(w)) for c, w in coefs.items()), F.lit(float(intercept)))


def raster_calc_mask(col: Column, threshold: float) -> Column:
    return (col >= threshold).cast("int")


# --- images ----------------------------------------------------------------------------

def qa_bits(col: Column, start: int, end: int) -> Column:
    mask = sum(1 << i for i in range(start, end + 1))
    return F.shiftright(col.bitwiseAND(F.lit(mask)), start)


def mask_clouds(df: DataFrame, bands: Sequence[str], qa: str = "qa") -> DataFrame:
    """Null every band where the cloud or the cloud-shadow bit is set."""
    clear = (qa_bits(F.col(qa), 3, 3) == 0) & (qa_bits(F.col(qa), 4, 4) == 0)
    return df.withColumns({b: F.when(clear, F.col(b)) for b in bands})


def scale_reflectance(
    df: DataFrame, bands: Sequence[str], thermal: Sequence[str] = (), clip_range: bool = False
) -> DataFrame:
    """Digital numbers to reflectance and to kelvin; the range mask is off by default."""
    gain, shift = REFLECTANCE_SCALE
    tgain, tshift = THERMAL_SCALE
    cols = {}
    for b in bands:
        v = F.col(b) * gain + shift
        if clip_range:
            v = F.when((v > 0 if b == "blue" else v >= 0) & (v < 1 if b == "blue" else v <= 1), v)
        cols[b] = v
    cols.update({b: F.col(b) * tgain + tshift for b in thermal})
    return df.withColumns(cols)


def spectral_index(kind: str, mask: bool = True) -> Column:
    """NDVI, NDWI, EVI, SAVI, GCI or albedo of columns blue..swir2."""
    b = {n: F.col(n) for n in ("blue", "green", "red", "nir", "swir1", "swir2")}
    if kind == "ndvi":
        v = F.try_divide(b["nir"] - b["red"], b["nir"] + b["red"])
        return F.when(v > -0.1, v) if mask else v
    if kind == "ndwi":
        v = F.try_divide(b["green"] - b["nir"], b["green"] + b["nir"])
        return F.when(v < 0.1, v) if mask else v
    if kind == "evi":
        v = 2.5 * F.try_divide(b["nir"] - b["red"], b["nir"] + 6 * b["red"] - 7.5 * b["blue"] + 1)
        return F.when(v < 1.3, v) if mask else v
    if kind == "savi":
        return F.try_divide(b["nir"] - b["red"], b["nir"] + b["red"] + 0.5) * 1.5
    if kind == "gci":
        return F.try_divide(b["nir"], b["green"])
    if kind == "albedo":
        return sum((b[n] * w for n, w in ALBEDO_WEIGHTS.items()), F.lit(0e0))
    raise ValueError(f"unknown index {kind}")


def cloud_shadow_flags(prob: Column, nir: Column, scene_class: Column) -> tuple[Column, Column]:
    """(cloud, dark pixel that is not water)."""
    return prob > CLOUD_PROBABILITY, (nir < DARK_NIR * 1e4) & (scene_class != WATER_CLASS)


def select_bands(df: DataFrame, names: Mapping[str, str], band: str = "band") -> DataFrame:
    """Keep the listed bands of a long pixel table under their new names."""
    pairs = [F.lit(v) for kv in names.items() for v in kv]
    return df.where(F.col(band).isin(*names)).withColumn(band, F.element_at(F.create_map(*pairs), F.col(band)))


def numbered_bands(order: Sequence[str], wanted: Sequence[str] | None = None) -> dict[int, str]:
    """Position (from 0) -> name of the wanted bands of a file whose bands come in ``order``."""
    return {order.index(b): b for b in wanted or order}


def rename_bands(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Wide pixel table with a sensor's band columns under shared names; its other listed columns stay."""
    keep = [c for c in df.columns if c not in names]
    return df.select(*keep, *[F.col(a).alias(b) for a, b in names.items()])


def target_grid(scenes: DataFrame, factor: int) -> DataFrame:
    """Same origin, pixels ``factor`` times smaller."""
    return scenes.withColumns({
        "dx": F.col("dx") / factor, "dy": F.col("dy") / factor,
        "width": F.col("width") * factor, "height": F.col("height") * factor,
    })


# --- climate and crop water --------------------------------------------------------------

def vapour_pressure(dew_c: Column) -> Column:
    return 6.11 * F.pow(F.lit(10e0), 7.5 * dew_c / (237.3 + dew_c)) / 10e0


def saturation_pressure(mean_c: Column) -> Column:
    return 0.6108 * F.exp(17.27 * mean_c / (mean_c + 237.3))


def reference_et0(temp_k: Column, dew_k: Column, u: Column, v: Column, pressure: Column, sw: Column, lw: Column) -> Column:
    """Penman-Monteith reference evapotranspiration in mm/day, no ground heat flux."""
    t = temp_k - 273.15
    ea, es = vapour_pressure(dew_k - 273.15), saturation_pressure(t)
    wind = F.sqrt(u * u + v * v)
    rnet = sw / 1e6 - lw / 1e6
    slope = 4090 * es / F.pow(t + 237.3, 2)
    psy = pressure * 0.001 * 0.000665
    return (0.408 * slope * rnet + psy * (900 / (t + 273)) * wind * (es - ea)) / (slope + psy * (0.34 * wind + 1))


def derive_climate(df: DataFrame) -> DataFrame:
    """Celsius, mm, kPa, W/m2 and PET from temp_k, dew_k, rain_m, rad, u, v, pressure, sw, lw."""
    c = F.col
    tmean, tdew = c("temp_k") - 273.15, c("dew_k") - 273.15
    ea, es = vapour_pressure(tdew), saturation_pressure(tmean)
    return df.withColumns({
        "tmean": tmean, "tdew": tdew, "rain": c("rain_m") * 1000, "ea": ea, "vpd": es - ea, "rad_w": c("rad") / 86400,
        "pet": reference_et0(c("temp_k"), c("dew_k"), c("u"), c("v"), c("pressure"), c("sw"), c("lw")),
    })


def kc_on(day: Column) -> Column:
    """Crop coefficient on a day after planting (1..110), rounded to 3 places; null outside."""
    out = F.when(day.isNull(), None)
    for first, last, a, b, span in KC_CURVE:
        out = out.when((day >= first) & (day <= last), F.round(F.lit(a) + (b - a) * (day - (first - 1)) / span, 3))
    return out


def kc_curve(spark) -> DataFrame:
    return spark.range(1, KC_DAYS + 1).select(F.col("id").cast("int").alias("day"), kc_on(F.col("id")).alias("kc"))


def satisfaction_index(eta: Column, cwr: Column, floor_zero: bool = True) -> Column:
    """1.2 ETa / CWR capped at 1; a positive value over zero need counts as 1, 0/0 as null."""
    v = F.coalesce(F.try_divide(eta * CORRECTION, cwr), F.when((cwr == 0) & (eta > 0), 1e0))
    v = F.when(v.isNotNull(), F.least(v, F.lit(1e0)))
    return F.when(v.isNotNull(), F.greatest(v, F.lit(0e0))) if floor_zero else v


def eta_adjusted(eta: Column, si: Column, cwr: Column) -> Column:
    """1.2 ETa, where a missing ETa is worked back from the index and the need."""
    return F.coalesce(eta, si * cwr / CORRECTION) * CORRECTION


def unit_scale(col: Column, mul: float, div: float) -> Column:
    return col * F.lit(float(mul)) / F.lit(float(div))


# --- dates -----------------------------------------------------------------------------

def date_parts(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns({
        "year": F.year(ts), "month": F.month(ts), "day": F.day(ts), "doy": F.dayofyear(ts),
        "date": F.date_format(ts, "yyyy-MM-dd"), "date_us": F.date_format(ts, "M/d/yyyy"),
    })


def to_doy(value: Column, default: int) -> Column:
    """Text or number to a day of year 1..366; dates use their day, nulls the default."""
    text = value.cast("string")
    num = text.try_cast("double")
    doy = (
        F.when(num.between(1, 366), F.floor(num))
        .when(num > 366, F.floor(num % 366) + 1)
        .when(num.isNotNull(), F.floor(F.abs(num) % 366) + 1)
        .otherwise(F.dayofyear(text.try_cast("date")))
    )
    return F.least(F.greatest(F.coalesce(doy, F.lit(default)), F.lit(1)), F.lit(366)).cast("int")


def season_length(start: Column, end: Column, wrap: bool = True) -> Column:
    d = end - start
    return F.when(d < 0, d + 365).otherwise(d) if wrap else d


def week_key(day: Column) -> Column:
    """Year and Sunday-started week number, e.g. 2023-W05."""
    week = F.floor((F.dayofyear(day) + 7 - F.dayofweek(day)) / 7e0)
    return F.concat(F.year(day).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def iso_week_key(day: Column) -> Column:
    """Calendar year and ISO week number, e.g. 2023_W52 on 1 January 2023."""
    return F.concat(F.year(day).cast("string"), F.lit("_W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def extract_date(name: Column) -> Column:
    """First of yyyymmdd, yyyy-mm-dd, yyyy_mm_dd in a name that is a valid date."""
    parts = [(r"(\d{8})", "yyyyMMdd"), (r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"), (r"(\d{4}_\d{2}_\d{2})", "yyyy_MM_dd")]
    return F.coalesce(*[
        F.try_to_timestamp(F.nullif(F.regexp_extract(name, p, 1), F.lit("")), F.lit(f)).cast("date") for p, f in parts
    ])


# --- projection ------------------------------------------------------------------------

def project_utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Longitude/latitude (WGS 84, degrees) to UTM metres: transverse Mercator series."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, lam = F.radians(lat), F.radians(lon - float(zone * 6 - 183))
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c, aa = F.pow(F.tan(phi), 2), ep2 * F.pow(F.cos(phi), 2), F.cos(phi) * lam
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    x = k0 * n * (aa + (1 - t + c) * F.pow(aa, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(aa, 5) / 120) + 500000.0
    y = k0 * (m + n * F.tan(phi) * (
        F.pow(aa, 2) / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(aa, 4) / 24
        + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(aa, 6) / 720))
    return x, y + (10000000.0 if south else 0.0)


def unproject_utm(x: Column, y: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """UTM metres to longitude/latitude (WGS 84, degrees): inverse transverse Mercator series, below 1 mm within a zone."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2, root = e2 / (1 - e2), (1 - e2) ** 0.5
    e1 = (1 - root) / (1 + root)
    mu = (y - (10000000.0 if south else 0.0)) / (k0 * a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    foot = (
        mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu)
        + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu))
    bend = 1 - e2 * F.pow(F.sin(foot), 2)
    n, r = a / F.sqrt(bend), a * (1 - e2) / F.pow(bend, 1.5)
    t, c = F.pow(F.tan(foot), 2), ep2 * F.pow(F.cos(foot), 2)
    d = (x - 500000.0) / (n * k0)
    lat = foot - n * F.tan(foot) / r * (
        F.pow(d, 2) / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * F.pow(d, 4) / 24
        + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * F.pow(d, 6) / 720)
    lon = (d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * F.pow(d, 5) / 120) / F.cos(foot)
    return F.degrees(lon) + float(zone * 6 - 183), F.degrees(lat)


def to_srid(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Coordinates of one reference system in another: 4326 (WGS 84) and its UTM zones, 32601-32660 north and 32701-32760 south."""
    def utm(srid: int) -> tuple[int, bool]:
        south, zone = divmod(srid - 32600, 100)
        if south not in (0, 1) or not 1 <= zone <= 60:
            raise ValueError(f"unknown reference system {srid}")
        return zone, bool(south)

    if source == target:
        return x, y
    if source != 4326:
        x, y = unproject_utm(x, y, *utm(source))
    return (x, y) if target == 4326 else project_utm(x, y, *utm(target))


def density(pop: Column, area: Column) -> Column:
    """Inhabitants per square kilometre from an area in square metres."""
    return 1e6 * pop / area


def seeded(seed: int, *key: Column) -> Column:
    """Uniform number in [0, 1) from a row's key: the same on every run and every retry."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
