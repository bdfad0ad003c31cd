"""End-to-end jobs: each is a function from input tables to stored or returned layers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from terraloom.functions import geometry as geo, scalars as sc
from terraloom.functions.fixed_values import PRIORITY_WEIGHTS
from terraloom.functions.hexgrid import assign_cell, cell_boundary
from terraloom.operators import (
    grids as gr, hexgraph as hg, irrigation as ir, joins as jn, models as md, network as nw, occurrence as oc, raster as rs, spatial as sp, tables as tb,
)
from terraloom.scale import materialize, shuffled
from terraloom.sources.layers import LayerStore, filter_collection, write_csv, write_stats_json

CELL = ["q", "r"]


# --- biodiversity ----------------------------------------------------------------------

def master_layers(occ: DataFrame, aoi: DataFrame, size: float, store: LayerStore, names: Mapping[str, str] | None = None) -> DataFrame:
    """Occurrences to stored layers: occurrences, cells (grid within the AOI), aoi.

    ``occ``: rid, species, yr, method, x, y; ``aoi``: id, edges, box.
    """
    if names:
        occ = oc.harmonize(occ, "species", names)
    occ = assign_cell(occ, "x", "y", size)
    small = materialize(oc.species_years(occ))
    grid = hg.build_grid(small)
    cells = sp.as_shape(grid.withColumn("cell", F.struct(*CELL)), geo.ring_edges(cell_boundary(size)))
    inside = sp.shape_pairs(cells, aoi, "cell", "id", geo.polygons_intersect).select("a.q", "a.r").distinct()
    return store.write_layers({"occurrences": occ, "cells": oc.cell_summary(small, materialize(inside)), "aoi": aoi})


def grid_analyses(
    source: LayerStore, target: LayerStore, include: Sequence[str] | None, exclude: Sequence[str], threatened: Sequence[str],
    permeability: DataFrame | None = None, centrality: bool = True, common: Mapping[str, str] | None = None,
    weights: Mapping[str, float] = PRIORITY_WEIGHTS, recent_from: int = 2020,
) -> DataFrame:
    """Thirteen analysis layers from the stored master layers; returns row counts per layer.

    Raw occurrences are read twice: once to compact them, once to pass them on.  Layers that others build on are
    stored first; those that need no years share the species of each cell.
    """
    occ = source.read_layer("occurrences")
    if include is not None:
        occ = oc.filter_species(occ, include, exclude)
    small = materialize(oc.species_years(occ))
    seen = materialize(small.select(*CELL, "species").distinct())
    grid = source.read_layer("cells").select(*CELL)
    years = oc.survey_years(small)
    div = materialize(oc.diversity(small, common=common))
    conn = materialize(hg.connectivity(grid, seen))
    occupied = materialize(hg.occupied_cells(seen).select(*CELL))
    edges = hg.adjacency(occupied.join(shuffled(grid), CELL, "left_semi")).select(nw.cell_id().alias("src"), nw.cell_id("nq", "nr").alias("dst"))
    patches = nw.patch_ids(nw.connected_components(occupied.select(nw.cell_id().alias("node")), edges))
    all_cells = conn.withColumn("node", nw.cell_id()).join(shuffled(patches), "node", "left").fillna(0, ["patch_id"]).drop("node")
    perm = permeability if permeability is not None else occupied.withColumn("permeability", F.lit(50e0))
    parts = (
        div.select(*CELL, F.col("s").alias("richness"), F.col("shannon_h").alias("diversity"))
        .join(shuffled(conn.select(*CELL, F.col("k1").alias("connectivity"))), CELL, "left").fillna(0, ["connectivity"])
        .withColumn("co_occurrence", F.col("richness") * (F.col("richness") - 1) / 2e0)
        .join(shuffled(oc.threatened_count(seen, threatened)), CELL).join(shuffled(perm), CELL, "left").fillna({"permeability": 50.0})
    )
    priority = materialize(oc.priority_index(parts, weights))
    between = None
    if centrality:
        all_edges = hg.adjacency(grid).select(nw.cell_id().alias("src"), nw.cell_id("nq", "nr").alias("dst"))
        b = nw.betweenness(grid.select(nw.cell_id().alias("node")), all_edges)
        between = grid.withColumn("node", nw.cell_id()).join(shuffled(b), "node").select(*CELL, "betweenness")
    richness = materialize(oc.cell_summary(small, grid, years=years))
    turnover = materialize(oc.temporal_turnover(small, grid, recent_from=recent_from, years=years))
    chao = materialize(oc.chao1(small))
    isolation = materialize(hg.isolation_risk(grid, seen, priority))
    master = hg.master_join(
        richness.where("total_records > 0"),
        [(div, ""), (priority, "_pri"), (turnover, "_temp"), (chao, "_chao"), (isolation, "_iso")])
    return target.write_layers({
        "all_cells": all_cells, "richness_summary": richness, "diversity": div, "priority": priority,
        "temporal_traj": turnover, "temporal_matrix": oc.temporal_matrix(small, grid, years=years), "chao1": chao,
        "corridor_gaps": hg.corridor_gaps(grid, seen, between), "isolation_risk": isolation,
        "survey_gaps": hg.survey_gaps(grid, seen), "master_occupied": master, "occurrences": occ,
        "aoi": source.read_layer("aoi"),
    })


def validation_tables(occ: DataFrame, priority: DataFrame, path: str, since: int = 2020, common: Mapping[str, str] | None = None) -> dict[str, str]:
    """Write the five validation CSVs; returns their folders by name."""
    small = materialize(oc.species_years(occ, [*CELL, "method"]))
    parts = ["richness", "diversity", "connectivity", "co_occurrence", "threatened"]
    tables = {
        "chao1_per_period": oc.chao1_per_period(small),
        "chao1_comparison": oc.chao1_comparison(small, since, f"Recent ({since}+)"),
        "spearman_trends": oc.spearman_trend(small, common),
        "effort_per_period": oc.effort_per_period(small),
        "cpi_correlation_matrix": oc.spearman_matrix(priority, CELL, parts),
    }
    for name, df in tables.items():
        write_csv(df, f"{path}/{name}")
    return {name: f"{path}/{name}" for name in tables}


# --- irrigation --------------------------------------------------------------------------

def clear_series(
    images: DataFrame, probability: DataFrame, others: Sequence[DataFrame], bands: Sequence[str], bbox: Sequence[float],
    date_from: str, date_to: str, max_cloud: float = 60, max_steps: int = 20, step: float = 1.0, erode: int = 2, dilate: int = 5,
) -> DataFrame:
    """Pixels (r, c, dt, bands) of several sensors in one series, NULL under clouds and shadows.

    ``images``: scene, r, c, dt, x0, y0, x1, y1, cloud (percent of the scene), azimuth,
    scene_class and bands; scenes outside the box, the half-open dates or the cloud limit
    go.  Each pixel takes its first ``probability`` row (scene, r, c, product, probability);
    pixels without any go.  Clouds, and dark pixels that are not water in the direction of
    a cloud's shadow, are masked after the flag has shrunk and grown.  ``others``: r, c, dt,
    qa bits and bands as digital numbers, masked by their bits and scaled.
    """
    near = filter_collection(images, bbox, date_from, date_to, max_cloud)
    known = jn.first_match_join(near, probability, ["scene", "r", "c"], ["product"])
    cloud, dark = sc.cloud_shadow_flags(F.col("probability"), F.col("nir"), F.col("scene_class"))
    flagged = known.select("scene", "r", "c", "dt", "azimuth", *bands, cloud.alias("cloud"), dark.alias("dark"))
    masked = rs.project_shadow(flagged, F.col("azimuth"), max_steps, step, erode, dilate)
    clear = [rs.apply_mask(masked, bands).select("r", "c", "dt", *bands)]
    start, end = (F.lit(day).cast("date") for day in (date_from, date_to))
    for px in others:
        inside = px.where((F.col("dt") >= start) & (F.col("dt") < end))
        clear.append(sc.scale_reflectance(sc.mask_clouds(inside, bands, "qa"), bands).select("r", "c", "dt", *bands))
    return tb.merge_collections(*clear)


def transplanting_dates(
    px: DataFrame, zones: DataFrame, key: Sequence[str], flood: tuple[str, str], peak: tuple[str, str],
    step_days: int = 8, cropland: DataFrame | None = None, zone: str = "norec",
) -> DataFrame:
    """Mean day of year of the wettest and the greenest date per block, and the days between.

    ``px``: key columns, dt, green, red, nir (masked bands NULL); ``cropland``: key, agreed.
    """
    series = rs.interpolate_linear(px, ["green", "red", "nir"], step_days, key)
    idx = series.withColumns({
        "ndvi": sc.spectral_index("ndvi"), "ndwi": sc.spectral_index("ndwi"), "doy": F.dayofyear("dt")})
    idx = materialize(idx.select(*key, "dt", "ndvi", "ndwi", "doy"))
    wet = rs.quality_mosaic(idx, "ndwi", "doy", *flood, key).withColumnRenamed("doy", "ndwi_doy")
    green = rs.quality_mosaic(idx, "ndvi", "doy", *peak, key).withColumnRenamed("doy", "ndvi_doy")
    dates = wet.join(shuffled(green), list(key), "full")
    if cropland is not None:
        dates = dates.join(shuffled(cropland.where("agreed").select(*key)), list(key), "left_semi")
    means = rs.zonal_mean(dates, zones, ["ndwi_doy", "ndvi_doy"], zone, on=key)
    out = zones.select(zone).distinct().join(means, zone, "left")
    return out.select(
        zone, sc.to_doy(F.col("ndwi_doy"), 300).alias("ndwi_doy"), sc.to_doy(F.col("ndvi_doy"), 100).alias("ndvi_doy")
    ).withColumn("length", sc.season_length(F.col("ndwi_doy"), F.col("ndvi_doy")))


def block_et0_series(weather: DataFrame, zones: DataFrame, key: Sequence[str], zone: str = "norec") -> DataFrame:
    """Daily reference evapotranspiration per block from pixel weather."""
    c = F.col
    et0 = sc.reference_et0(c("temp_k"), c("dew_k"), c("u"), c("v"), c("pressure"), c("sw"), c("lw"))
    return rs.zonal_mean(weather.withColumn("et0", et0), zones, ["et0"], zone, ["dt"], on=key)


def block_eta_series(
    px: DataFrame, climate: DataFrame, training: DataFrame, features: Sequence[str], zones: DataFrame,
    key: Sequence[str], trees: int = 150, zone: str = "norec", label: str = "eta",
) -> DataFrame:
    """Daily actual evapotranspiration per block: interpolate, add climate, apply a forest.

    ``climate`` has one row per date (start, end, ...); the forest learns from a repeatable
    20 % sample of ``training``.
    """
    bands = [c for c in px.columns if c not in (*key, "dt")]
    daily = rs.interpolate_linear(px, bands, 1, key)
    met = jn.tolerance_join(daily, climate, 1, (), ("dt", "dt"), ("start", "end"))
    rest = [c for c in climate.columns if c not in ("start", "end")]
    same_day = met.where(F.col("dt") == F.col("r.start")).select(*daily.columns, *[F.col(f"r.{c}").alias(c) for c in rest])
    full = sc.derive_climate(same_day).withColumns({
        "ndvi": sc.spectral_index("ndvi", mask=False), "doy": F.dayofyear("dt").cast("double")})
    model = md.train_forest(tb.sample(training, ["k"], 0.2, 1), label, features, trees)
    scored = md.apply_model(model, full, features).withColumnRenamed("prediction", "eta")
    return rs.zonal_mean(scored, zones, ["eta"], zone, ["dt"], on=key)


def water_performance(daily: DataFrame, dates: DataFrame, store: LayerStore, zones: DataFrame | None = None) -> DataFrame:
    """Satisfaction, uniformity and reliability layers of irrigation blocks; returns row counts.

    ``daily``: norec, dt, et0, eta; ``dates``: norec, start_doy.
    """
    si = store.cached_layer("daily_si", lambda: ir.daily_satisfaction(daily, dates))
    weekly = store.cached_layer("weekly_si", lambda: ir.weekly_si(si))
    blocks, reliable = ir.block_uniformity(weekly), ir.reliability_threshold(weekly)
    layers = {
        "weekly_uniformity": ir.weekly_uniformity(weekly), "block_uniformity": blocks,
        "reliability": reliable, "summary": ir.performance_summary(weekly),
    }
    if zones is not None:
        layers["block_map"] = ir.block_map(blocks, reliable, zones)
    return store.write_layers(layers)


# --- image patches -----------------------------------------------------------------------

def patch_preparation(
    lr: DataFrame, hr: DataFrame, bands: Sequence[str], path: str, size: int = 64, scale: int = 3, stride: int | None = None,
    val: float = 0.1, test: float = 0.1, seed: int = 42, how: str | None = "percentile",
    grids: tuple[DataFrame, DataFrame] | None = None, resampling: str = "cubic",
) -> DataFrame:
    """Scene split, band statistics and valid patch origins (split, scene, y0, x0).

    ``grids``: the grids of both images; ``hr`` is then brought onto the LR grid with
    pixels ``scale`` times smaller.  Values are normalized per scene and band before
    validity is tested, unless ``how`` is None.
    """
    for name, px in (("lr", lr), ("hr", hr)):
        write_stats_json(rs.global_band_stats(px, bands), f"{path}/stats_{name}")
    keys = ["scene", "r", "c"]
    if how:
        lr = rs.normalize_bands(lr, bands, how).groupBy(*keys).agg(*[F.max(b).alias(b) for b in bands])
    if grids is not None:
        # in order, positions take next to no room in the table and where it is placed by scene
        hr = materialize(gr.resample_to(hr, bands, grids[1], sc.target_grid(grids[0], scale), resampling).sortWithinPartitions(*keys))
    if how:
        hr = rs.normalize_bands(hr, bands, how)
        if grids is None:  # resampled pixels are unique
            hr = hr.groupBy(*keys).agg(*[F.max(b).alias(b) for b in bands])
    scenes = lr.select("scene").distinct().join(hr.select("scene").distinct(), "scene")
    parts = tb.split(materialize(scenes), ["scene"], val, test, seed, at_least_one=True)
    return gr.extract_patches(lr, hr, bands, size, scale, stride).join(parts, "scene")


# --- suitability -------------------------------------------------------------------------

def suitability_study(
    zones: DataFrame, sites: DataFrame, points: DataFrame, blocks: DataFrame, cell: float, limit: float = 50.0,
    weights: Mapping[str, float] = {"zone_rank": 0.4, "near_rank": 0.35, "dense_rank": 0.25},
) -> dict[str, DataFrame]:
    """Five stages: rasterize zones, density and proximity; rank; overlay; mask and outline; select blocks.

    Returns ``score`` (r, c, score), ``regions`` (r, c, region), ``outline`` (edge rows) and
    ``blocks`` (ids of blocks that touch a suitable pixel).
    """
    base = sp.rasterize(zones, F.col("grp"), F.col("zid"), cell).withColumnRenamed("value", "zone_rank")
    heat = sp.heatmap(points, cell * 4, cell, "quartic")
    pin = sites.select(F.floor(F.col("y") / cell).alias("r"), F.floor(F.col("x") / cell).alias("c")).distinct().withColumn("site", F.lit(True))
    marked = base.join(shuffled(pin), ["r", "c"], "left")
    near = sp.proximity(materialize(marked), F.col("site"), cell)
    grid = base.join(shuffled(heat), ["r", "c"], "left").join(shuffled(near), ["r", "c"], "left").fillna(0.0, ["density"])
    ranked = grid.withColumns({
        "near_rank": sc.reclass(F.col("distance"), [0.5, 1.0, 2.0, 4.0], [5, 4, 3, 2, 1]),
        "dense_rank": sc.reclass(F.col("density"), [0.5, 1.5, 3.0, 6.0], [1, 2, 3, 4, 5])})
    score = materialize(ranked.withColumn(
        "score", sc.weighted_overlay(weights, {"zone_rank": 4, "near_rank": 5, "dense_rank": 5})).select("r", "c", "score"))
    best = score.withColumn("m", sc.raster_calc_mask(F.col("score"), limit)).where("m = 1")
    regions = nw.pixel_regions(best, "m").drop("m")
    unit = geo.box_ring(F.col("c") * cell, F.col("r") * cell, (F.col("c") + 1) * cell, (F.col("r") + 1) * cell)
    squares = sp.as_shape(best.withColumn("px", F.struct("r", "c")), geo.ring_edges(unit))
    chosen = sp.shape_pairs(squares, blocks, "px", "id", geo.polygons_intersect).select(F.col("b").alias("id")).distinct()
    return {"score": score, "regions": regions, "outline": sp.pixel_outline(regions, "region"), "blocks": chosen}
