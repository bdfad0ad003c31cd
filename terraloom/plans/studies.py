"""Queries that run the end-to-end jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terraloom.functions.hexgrid import assign_cell
from terraloom.functions.scalars import derive_climate
from terraloom.operators import grids as gr, hexgraph as hg, occurrence as oc
from terraloom.plans import jobs
from terraloom.plans.ecology import COMMON, PRIORITY, THREATENED, WEIGHTS, _SUMMARY, compact, occ, parts
from terraloom.plans.imagery import _INT, rd, square
from terraloom.plans.registry import ORACLES, query
from terraloom.plans.sqltext import YEARS, d, disk, grid, hexed
from terraloom.plans.vector import HEX, sat, zone
from terraloom.plans.water import CLIMATE, _BLOCK, _CLIP, _ET0, _REL, _ST, WEEK
from terraloom.scale import materialize, work_dir
from terraloom.sources.fixtures import view, with_views
from terraloom.sources.layers import LayerStore


def store(spark) -> LayerStore:
    return LayerStore(spark, f"{work_dir(spark)}/{uuid.uuid4().hex}")


def aoi(spark, sf):
    return zone(spark, sf).where("grp < 3").withColumnRenamed("zid", "id")


_AOI = ", " + with_views("zone")[len("with recursive "):] + ", "
_GRID_AOI = grid().replace(", grid as", ", grid0 as", 1) + _AOI + f"grid as (select distinct q, r from grid0 join (select * from zone where grp<3) on {sat(0.5)})"


@query("master_layers", HEX + _GRID_AOI + _SUMMARY)
def _(spark, sf):
    s = store(spark)
    jobs.master_layers(view(spark, sf, "occ"), aoi(spark, sf), 0.5, s)
    out = s.read_layer("cells")
    # the job makes a column per year in the data; the SQL lists some years and adds up the others
    named = [f"records_{y}" for y in YEARS]
    missing = {c: F.lit(0).cast("bigint") for c in named if c not in out.columns}
    other = [c for c in out.columns if c.startswith("records_") and c not in named]
    total = sum((F.col(c) for c in other), F.lit(0).cast("bigint"))
    return out.withColumns({**missing, "records_other": total}).drop(*other)


_SIZE = 1.5
_CHOSEN = "','".join(n for n in dict.fromkeys([*THREATENED, *COMMON]) if n != "Brand#3")
_LAYERS = {
    "grid": ["all_cells", "richness_summary", "temporal_traj", "temporal_matrix"],
    "oc": ["diversity", "priority", "chao1", "isolation_risk"],
    "(select q from grid anti join oc using(q,r))": ["corridor_gaps", "survey_gaps"],
    "(select q from grid semi join oc using(q,r))": ["master_occupied"], "chosen": ["occurrences"], "(select * from zone where grp<3)": ["aoi"],
}


@query("grid_analyses", with_views("occ", "zone") + ", " + hexed("occ", _SIZE) + f""", chosen as (select * from occ_c where species in ('{_CHOSEN}')),
    oc as (select distinct q, r from chosen), g0 as (select distinct q+dq q, r+dr r from (select distinct q, r from occ_c) cross join {disk(2)}),
    grid as (select distinct q, r from g0 join (select * from zone where grp<3) on {sat(_SIZE)}) """ + " union all ".join(
    f"select '{name}' layer, (select count(*) from {src}) n" for src, names in _LAYERS.items() for name in names))
def _(spark, sf):
    src, out = store(spark), store(spark)
    jobs.master_layers(view(spark, sf, "occ"), aoi(spark, sf), _SIZE, src)
    return jobs.grid_analyses(src, out, THREATENED + list(COMMON), ["Brand#3"], THREATENED, common=COMMON, recent_from=2000)


@query("validation_tables", with_views("occ") + """ select 'chao1_per_period' name, count(distinct yr) n from occ union all select 'chao1_comparison', 2
    union all select 'spearman_trends', (select count(*) from (select species from occ group by 1 having count(distinct yr)>=3))
    union all select 'effort_per_period', (select count(distinct yr) from occ) union all select 'cpi_correlation_matrix', 15""")
def _(spark, sf):
    o = assign_cell(view(spark, sf, "occ"), "x", "y", 0.5)
    pri = oc.priority_index(parts(compact(spark, sf)), WEIGHTS)
    made = jobs.validation_tables(o, pri, f"{work_dir(spark)}/{uuid.uuid4().hex}", 1999, COMMON)
    out = None
    for name, path in made.items():
        n = spark.read.csv(path, header=True).select(F.lit(name).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


def measures(layers, sources, keys):
    """Long form (layer, key, measure, value) of tables: ``layers`` maps a layer to its number columns, ``sources`` to its table."""
    out = None
    for name, cols in layers.items():
        key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys[name]])
        long = sources(name).select(key.alias("key"), *[F.col(c).cast("double").alias(c) for c in cols]).unpivot("key", cols, "measure", "value")
        long = long.select(F.lit(name).alias("layer"), "key", "measure", F.round("value", 6).alias("value"))
        out = long if out is None else out.unionByName(long)
    return out


def measures_sql(layers, oracles, keys) -> str:
    """The same from the SQL of the single queries."""
    texts = {**ORACLES, "priority_five_parts": PRIORITY + " select * from pri"}  # the job is run with the weights of five parts
    ctes = ", ".join(f"t_{name} as materialized ({texts[oracles[name]]})" for name in layers)
    rows = [f"select '{name}' layer, concat_ws('|',{','.join(f'cast({k} as varchar)' for k in keys[name])}) \"key\", '{c}' measure, round(cast({c} as double),6) \"value\" from t_{name}"
            for name, cols in layers.items() for c in cols]
    return f"with {ctes} " + " union all ".join(rows)


_VALUES = {
    "all_cells": ["k1", "k2", "species_k2", "eco_score"], "richness_summary": ["total_records"],
    "diversity": ["s", "n", "shannon_h", "simpson_d", "pielou_j", "berger_parker", "trend_slope"],
    "priority": ["richness", "connectivity", "threatened", "co_occurrence", "priority_index", "priority_rank"],
    "temporal_traj": ["first_detected", "last_detected", "years_detected", "colonisations", "extinctions", "mean_beta", "species_ever"],
    "temporal_matrix": ["total_records", "years_with_data"],
    "chao1": ["n", "s_obs", "f1", "f2", "chao1", "completeness_pct", "undetected", "years_surveyed"],
    "corridor_gaps": ["k1", "k2_richness", "dist", "candidate", "score"],
    "isolation_risk": ["richness", "direct", "gaps", "extra", "total", "priority_index"],
    "survey_gaps": ["k1", "k2", "k1_richness", "k2_richness", "dist_km", "candidate", "score"],
}
_SINGLE = {
    "all_cells": "connectivity", "richness_summary": "cell_summary", "diversity": "diversity_by_cell", "priority": "priority_five_parts",
    "temporal_traj": "temporal_turnover", "chao1": "chao1_by_cell"}
_CELLS = dict.fromkeys(_VALUES, ("q", "r"))


@query("grid_analyses_values", measures_sql(_VALUES, {n: _SINGLE.get(n, n) for n in _VALUES}, _CELLS))
def _(spark, sf):
    src, out = store(spark), store(spark)
    src.write_layers({"occurrences": occ(spark, sf), "aoi": aoi(spark, sf)})
    src.write_layers({"cells": hg.build_grid(src.read_layer("occurrences"))})
    jobs.grid_analyses(src, out, None, [], THREATENED, centrality=False, common=COMMON, weights=WEIGHTS, recent_from=2000)
    return measures(_VALUES, out.read_layer, _CELLS)


_TABLES = {
    "chao1_per_period": ["n", "s_obs", "f1", "f2", "chao1", "completeness_pct", "coverage"],
    "chao1_comparison": ["n", "s_obs", "f1", "f2", "chao1", "completeness_pct"],
    "spearman_trends": ["rho", "p_value"], "effort_per_period": ["records", "n_species", "n_cells", "n_methods"], "cpi_correlation_matrix": ["rho"],
}
_ROWS = {"chao1_per_period": ("yr",), "chao1_comparison": ("dataset",), "spearman_trends": ("species",), "effort_per_period": ("yr",),
         "cpi_correlation_matrix": ("least(a,b)", "greatest(a,b)")}


@query("validation_tables_values", measures_sql(_TABLES, {n: {"spearman_trends": "spearman_trend", "cpi_correlation_matrix": "spearman_matrix"}.get(n, n) for n in _TABLES}, _ROWS))
def _(spark, sf):
    pri = oc.priority_index(parts(compact(spark, sf)), WEIGHTS)
    made = jobs.validation_tables(occ(spark, sf), pri, f"{work_dir(spark)}/{uuid.uuid4().hex}", 1999, COMMON)
    keys = {**_ROWS, "cpi_correlation_matrix": ("lo", "hi")}

    def read(name):
        df = spark.read.csv(made[name], header=True)
        return df.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}) if "rho" in df.columns and "a" in df.columns else df

    return measures(_TABLES, read, keys)


_TD = _INT + """,
    ix as (select pix, dt, dayofyear(dt) doy, case when (nir-red)/nullif(nir+red,0)>-1e-1 then (nir-red)/nullif(nir+red,0) end ndvi,
        case when ((nir+red)/2e0-nir)/nullif((nir+red)/2e0+nir,0)<1e-1 then ((nir+red)/2e0-nir)/nullif((nir+red)/2e0+nir,0) end ndwi from interp),
    we as (select pix, arg_max(doy, row(ndwi,dt)) a from ix where dt>=date '2024-01-01' and dt<date '2024-01-20' and ndwi is not null group by 1),
    gn as (select pix, arg_max(doy, row(ndvi,dt)) b from ix where dt>=date '2024-01-08' and dt<date '2024-04-01' and ndvi is not null group by 1),
    al as (select pix, a, b from we full join gn using(pix)), z as (select distinct pix, cast(floor(pix/5e0) as bigint) norec from px_ts),
    zm as (select norec, avg(a) a, avg(b) b from z left join al using(pix) group by 1),
    zz as (select norec, cast(coalesce(floor(a),300) as int) ndwi_doy, cast(coalesce(floor(b),100) as int) ndvi_doy from zm)
    select *, case when ndvi_doy<ndwi_doy then ndvi_doy-ndwi_doy+365 else ndvi_doy-ndwi_doy end length from zz"""


@query("transplanting_dates", _TD)
def _(spark, sf):
    ts = view(spark, sf, "px_ts").withColumn("green", (F.col("nir") + F.col("red")) / 2e0).select("pix", "dt", "green", "red", "nir")
    z = ts.select("pix").distinct().withColumn("norec", F.floor(F.col("pix") / 5))
    return jobs.transplanting_dates(ts, z, ["pix"], ("2024-01-01", "2024-01-20"), ("2024-01-08", "2024-04-01"))


def collections(spark, sf):
    """Images with their cloud probabilities, and images of a second sensor two days later."""
    img = view(spark, sf, "img")
    day = F.expr("date_add(date'2024-01-01', cast(scene * 5 as int))")
    one = img.select(
        "scene", "r", "c", day.alias("dt"), F.lit(0e0).alias("x0"), F.lit(0e0).alias("y0"), F.lit(1e0).alias("x1"), F.lit(1e0).alias("y1"),
        (F.col("scene") * 37 % 100).cast("double").alias("cloud"), (F.col("scene") * 37 % 360).cast("double").alias("azimuth"),
        F.floor(F.col("b2") * 10).cast("int").alias("scene_class"), (F.col("b3") * 3e3).alias("red"), (F.col("b4") * 3e3).alias("nir")
    ).withColumn("green", (F.col("nir") + F.col("red")) / 2e0)
    prob = img.where("r < 48").select("scene", "r", "c", F.explode(F.array(*[F.struct(
        F.lit(n).alias("product"), (F.col("b1") * k).alias("probability")) for n, k in ((2, 0e0), (1, 6e1))])).alias("p")).select("scene", "r", "c", "p.*")
    two = img.select("r", "c", F.date_add(day, 2).alias("dt"), F.floor(F.col("b1") * 1e2).cast("int").alias("qa"),
                     (F.col("b2") * 4e4).alias("red"), (F.col("b3") * 4e4).alias("nir")).withColumn("green", (F.col("nir") + F.col("red")) / 2e0)
    return one, prob, [two]


_DN = lambda v: f"({v}*{d(0.0000275)}+{d(-0.2)})"
_CLEAR = with_views("img") + f""", f as (select scene, r, c, cast(date '2024-01-01'+cast(scene*5 as int) as date) dt, b1*6e1>40 cloud,
        b4*3e3<15e2 and cast(floor(b2*10) as int)<>6 dark, cast(scene*37%360 as double) az, b3*3e3 red, b4*3e3 nir from img where r<48 and scene*37%100<=60 and scene*5<200),
    ca as (select distinct scene, r-cast(floor(i.range*sin(radians(90-az))+5e-1) as bigint) r, c+cast(floor(i.range*cos(radians(90-az))+5e-1) as bigint) c from f cross join range(1,7) i where cloud),
    fl as (select f.*, case when cloud or (dark and ca.r is not null) then 1 else 0 end flag from f left join ca on ca.scene=f.scene and ca.r=f.r and ca.c=f.c),
    er as (select a.scene, a.r, a.c, min(b.flag) flag from fl a cross join {square(1)} join fl b on b.scene=a.scene and b.r=a.r+dr and b.c=a.c+dc where dr*dr+dc*dc<=1 group by 1,2,3),
    di as (select a.scene, a.r, a.c, max(b.flag) flag from er a cross join {square(2)} join er b on b.scene=a.scene and b.r=a.r+dr and b.c=a.c+dc where dr*dr+dc*dc<=4 group by 1,2,3),
    l9 as (select r, c, cast(date '2024-01-01'+cast(scene*5+2 as int) as date) dt, cast(floor(b1*1e2) as int)&24=0 ok, {_DN('b2*4e4')} red, {_DN('b3*4e4')} nir from img where scene*5+2<200),
    clear as (select r, c, dt, case when di.flag=0 then red end red, case when di.flag=0 then nir end nir from fl join di using(scene,r,c)
        union all select r, c, dt, case when ok then red end, case when ok then nir end from l9)"""
_BOUNDS = ((0.0, 0.0, 1.0, 1.0), "2024-01-01", "2024-07-19")


@query("clear_series", _CLEAR + " select r, c, dt, round(red,6) red, round(nir,6) nir from clear")
def _(spark, sf):
    one, prob, rest = collections(spark, sf)
    px = jobs.clear_series(one, prob, rest, ["green", "red", "nir"], *_BOUNDS, max_steps=6, erode=1, dilate=2)
    return rd(px, ["red", "nir"]).drop("green")


@query("transplanting_from_scenes", _CLEAR + ", px_ts as (select r*50+c pix, dt, red, nir from clear)" + _TD[_TD.index(", sp as (select min(dt)"):].replace(
    "ob as (select pix, dt, nir, red from px_ts)", "ob as (select pix, dt, nir, red from px_ts where nir is not null)").replace("2024-01-20", "2024-02-20").replace("(nir+red)/2e0", "red"))
def _(spark, sf):
    one, prob, rest = collections(spark, sf)  # the second index reads red as green, as the SQL does
    px = materialize(jobs.clear_series(one, prob, rest, ["green", "red", "nir"], *_BOUNDS, max_steps=6, erode=1, dilate=2))
    px = px.select((F.col("r") * 50 + F.col("c")).alias("pix"), "dt", F.col("red").alias("green"), "red", "nir")
    z = px.select("pix").distinct().withColumn("norec", F.floor(F.col("pix") / 5))
    return jobs.transplanting_dates(px, z, ["pix"], ("2024-01-01", "2024-02-20"), ("2024-01-08", "2024-04-01"))


@query("block_et0_series", CLIMATE + f", e as (select cast(floor(k/100e0) as bigint) norec, dt, {_ET0} et0 from c2) select norec, dt, round(avg(et0),6) et0 from e group by 1,2")
def _(spark, sf):
    w = view(spark, sf, "weather")
    z = w.select("k", F.floor(F.col("k") / 100).alias("norec"))
    return rd(jobs.block_et0_series(w, z, ["k"]), ["et0"])


@query("block_eta_series")
def _(spark, sf):
    ts = view(spark, sf, "px_ts").select("pix", "dt", "nir", "red")
    w = view(spark, sf, "weather")
    met = ["temp_k", "dew_k", "u", "v", "pressure", "sw", "lw", "rad", "rain_m"]
    # one climate row per image date: the weather of the same day of the year
    per_day = w.groupBy(F.dayofyear("dt").alias("doy")).agg(*[F.avg(c).alias(c) for c in met])
    span = F.expr("sequence(date'2024-01-01', date'2024-12-31')")
    days = per_day.withColumn("start", F.expr("date_add(date'2024-01-01', doy - 1)")).where(F.array_contains(span, F.col("start")))
    climate = days.select("start", F.date_add("start", 1).alias("end"), *met)
    train = derive_climate(w).withColumns({
        "doy": F.dayofyear("dt").cast("double"), "ndvi": (F.col("k") % 10) / 10e0, "red": (F.col("k") % 7) / 7e0})
    train = train.withColumn("eta", F.col("pet") * (0.5 + F.col("ndvi") / 2))
    z = ts.select("pix").distinct().withColumn("norec", F.floor(F.col("pix") / 5))
    return jobs.block_eta_series(ts, climate, train, ["doy", "tmean", "rain", "ea", "vpd", "rad_w", "pet", "ndvi", "red"], z, ["pix"], trees=15)


@query("water_performance", WEEK + _BLOCK + _REL + """ select 'weekly_uniformity' layer, count(distinct year_week) n from wk union all select 'block_uniformity', count(*) from bun
    union all select 'reliability', count(*) from rel union all select 'summary', 1""")
def _(spark, sf):
    return jobs.water_performance(view(spark, sf, "block_daily"), view(spark, sf, "block_dates"), store(spark))


def _long(layer: str, key: str, cols: list[str], src: str) -> str:
    return " union all ".join(f"select '{layer}' layer, cast({key} as varchar) \"key\", '{c}' measure, round(cast({c} as double),6) \"value\" from {src}" for c in cols)


_MEASURES = {
    "weekly_uniformity": ("year_week", ["mean_si", "std_si", "block_count", "uniformity"], "un"),
    "block_uniformity": ("norec", ["mean_si", "std_si", "week_count", "min_si", "max_si", "deviation", "uniformity"], "bun"),
    "reliability": ("norec", ["mean_si", "total_weeks", "weeks_above", "reliability"], "rel"),
    "block_map": ("norec", ["mean_si", "uniformity", "reliability"], "bm"),
    "summary": ("'all'", ["overall_mean", "week_mean", "block_mean", "reliability_mean"], "sm"),
}


@query("water_performance_values", WEEK + _BLOCK + _REL + f""", un0 as (select year_week, {_ST}, count(si) block_count from wk group by 1), un as (select *, {_CLIP} uniformity from un0),
    bm as (select norec, bun.mean_si, uniformity, reliability from bun join rel using(norec)),
    sm as (select (select o from ov) overall_mean, (select avg(uniformity) from un) week_mean, (select avg(uniformity) from bun) block_mean, (select avg(reliability) from rel) reliability_mean)
    """ + " union all ".join(_long(name, *how) for name, how in _MEASURES.items()))
def _(spark, sf):
    s = store(spark)
    zones = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").cast("int").alias("norec"), F.col("c_mktsegment").alias("zone"))
    jobs.water_performance(view(spark, sf, "block_daily"), view(spark, sf, "block_dates"), s, zones)
    out = None
    for name, (key, cols, _) in _MEASURES.items():
        key = F.lit("all") if key.startswith("'") else F.col(key).cast("string")
        long = s.read_layer(name).select(key.alias("key"), *[F.col(c).cast("double").alias(c) for c in cols]).unpivot("key", cols, "measure", "value")
        long = long.select(F.lit(name).alias("layer"), "key", "measure", F.round("value", 6).alias("value"))
        out = long if out is None else out.unionByName(long)
    return out


@query("patch_preparation")
def _(spark, sf):
    img = view(spark, sf, "img").select("scene", "r", "c", "b1", "b2")
    grid = gr.image_size(img).select(
        "scene", F.lit(5e5).alias("x0"), F.lit(9.2e6).alias("y0"), F.lit(10e0).alias("dx"), F.lit(-10e0).alias("dy"), F.col("w").alias("width"), F.col("h").alias("height"))
    return jobs.patch_preparation(img, img, ["b1", "b2"], f"{work_dir(spark)}/{uuid.uuid4().hex}", size=10, scale=3, stride=5, grids=(grid, grid))


_AWAY = [f"abs({a})" for a in ("(c+5e-1)*25e-2-x", "(r+5e-1)*25e-2-y")]


@query("suitability_study", with_views("zone", "sites", "pts") + f""", base as (select cast(y0*4+a.range as bigint) r, cast(x0*4+b.range as bigint) c, grp from zone cross join range(4) a cross join range(4) b),
    t as (select distinct r tr, c tc from base join sites on r=floor(y/25e-2) and c=floor(x/25e-2)),
    near as (select r, c, sqrt(min((r-tr)*(r-tr)+(c-tc)*(c-tc)))*25e-2 dist from base cross join t group by 1,2),
    u as (select r, c, sqrt(pow({_AWAY[0]},2)+pow({_AWAY[1]},2)) u from base join pts on {_AWAY[0]}<=1e0 and {_AWAY[1]}<=1e0),
    heat as (select r, c, sum(pow(1-u*u,2)) dens from u where u<=1 group by 1,2),
    sc as (select r, c, r*2147483648+c n, ({d(0.4)}*grp+{d(0.35)}*(case when dist<=5e-1 then 5 when dist<=1e0 then 4 when dist<=2e0 then 3 when dist<=4e0 then 2 else 1 end)
        +{d(0.25)}*(case when coalesce(dens,0)<=5e-1 then 1 when dens<=15e-1 then 2 when dens<=3e0 then 3 when dens<=6e0 then 4 else 5 end))/{d(4.6)}*100 score
        from base join near using(r,c) left join heat using(r,c)),
    m as (select * from sc where score>=70), e as materialized (select a.n a, b.n b from m a cross join (values (0,1),(1,0),(0,-1),(-1,0)) o(dr,dc) join m b on b.r=a.r+dr and b.c=a.c+dc),
    reach as (select n, n m from m union select reach.n, e.b from reach join e on e.a=reach.m), reg as (select n, min(m) region from reach group by 1)
    select region, count(*) pixels, round(avg(score),6) score from m join reg using(n) group by 1""")
def _(spark, sf):
    z = zone(spark, sf)
    out = jobs.suitability_study(
        z, view(spark, sf, "sites"), view(spark, sf, "pts"), z.withColumnRenamed("zid", "id"), 0.25, limit=70.0)
    return out["regions"].groupBy("region").agg(F.count("*").alias("pixels"), F.round(F.avg("score"), 6).alias("score"))
