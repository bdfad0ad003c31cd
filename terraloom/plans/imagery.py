"""Pixel-table, patch and image-quality queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from terraloom.functions import scalars as sc
from terraloom.functions.fixed_values import ALBEDO_WEIGHTS, RESISTANCE
from terraloom.operators import grids as gr, metrics as mt, raster as rs
from terraloom.plans.registry import query
from terraloom.plans.sqltext import d
from terraloom.sources.fixtures import view, with_views

BANDS = ["b1", "b2", "b3", "b4"]


def rd(df, cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


def square(k: int) -> str:
    return f"(select cast(a.range-{k} as bigint) dr, cast(b.range-{k} as bigint) dc from range({2 * k + 1}) a cross join range({2 * k + 1}) b)"


# --- bands and indices -------------------------------------------------------------------

_IDX = {
    "ndvi": "case when (nir-red)/nullif(nir+red,0)>-1e-1 then (nir-red)/nullif(nir+red,0) end",
    "ndwi": "case when (green-nir)/nullif(green+nir,0)<1e-1 then (green-nir)/nullif(green+nir,0) end",
    "evi": "case when 25e-1*((nir-red)/nullif(nir+6*red-75e-1*blue+1,0))<13e-1 then 25e-1*((nir-red)/nullif(nir+6*red-75e-1*blue+1,0)) end",
    "savi": "(nir-red)/nullif(nir+red+5e-1,0)*15e-1", "gci": "nir/nullif(green,0)",
    "albedo": "+".join(f"{b}*{d(w)}" for b, w in ALBEDO_WEIGHTS.items()),
    "ndvi_plain": "(nir-red)/nullif(nir+red,0)",
}


@query("spectral_index", with_views("px") + " select r, c, " + ", ".join(f"round({v},6) {k}" for k, v in _IDX.items()) + " from px")
def _(spark, sf):
    cols = {k: sc.spectral_index(k) for k in _IDX if k != "ndvi_plain"} | {"ndvi_plain": sc.spectral_index("ndvi", mask=False)}
    return view(spark, sf, "px").select("r", "c", *[F.round(v, 6).alias(k) for k, v in cols.items()])


@query("mask_clouds", with_views("dem") + """ select r, c, cast((cast(z*10 as int)&24)>>3 as int) qa,
    case when (cast(z*10 as int)&8)=0 and (cast(z*10 as int)&16)=0 then z end z from dem""".replace("cast(z*10 as int)", "cast(floor(z*10) as int)"))
def _(spark, sf):
    df = view(spark, sf, "dem").withColumn("bits", F.floor(F.col("z") * 10).cast("int"))
    return sc.mask_clouds(df, ["z"], "bits").select("r", "c", sc.qa_bits(F.col("bits"), 3, 4).alias("qa"), "z")


@query("scale_reflectance", with_views("dem") + f""" select r, c, round(z*1e2*{d(0.0000275)}+{d(-0.2)},6) red, round(cls*{d(0.00341802)}+149e0,6) lst,
    round(case when z*1e2*{d(0.0000275)}+{d(-0.2)} between 0 and 1 then z*1e2*{d(0.0000275)}+{d(-0.2)} end,6) red_clipped from dem""")
def _(spark, sf):
    df = view(spark, sf, "dem").select("r", "c", (F.col("z") * 1e2).alias("red"), F.col("cls").alias("lst"))
    a = sc.scale_reflectance(df, ["red"], ["lst"])
    b = sc.scale_reflectance(df, ["red"], [], clip_range=True).select("r", "c", F.col("red").alias("red_clipped"))
    return rd(a.join(b, ["r", "c"]), ["red", "lst", "red_clipped"])


@query("cloud_shadow_flags", with_views("dem") + " select r, c, z/6e0>40 cloud, z*5e0<15e2 and cls<>6 dark from dem")
def _(spark, sf):
    cloud, dark = sc.cloud_shadow_flags(F.col("z") / 6e0, F.col("z") * 5e0, F.col("cls"))
    return view(spark, sf, "dem").select("r", "c", cloud.alias("cloud"), dark.alias("dark"))


_LAYERS = [f"cls%{n}=0" for n in (1, 2, 3, 4, 5)] + ["z>1e2", "z>2e2", "case when cls=3 then null else z>3e2 end", "r%2=0"]


@query("land_cover_consensus", with_views("dem") + " select r, c, " + "+".join(f"coalesce(cast({x} as int),0)" for x in _LAYERS)
       + " votes, " + "+".join(f"coalesce(cast({x} as int),0)" for x in _LAYERS) + ">=5 agreed from dem")
def _(spark, sf):
    df = view(spark, sf, "dem").select("r", "c", *[F.expr(x).alias(f"l{i}") for i, x in enumerate(_LAYERS)])
    return rs.land_cover_consensus(df, [f"l{i}" for i in range(9)], 5).select("r", "c", "votes", "agreed")


@query("stack_bands", with_views("img") + " select scene, r, c, b1, b2, b3, b4 from img")
def _(spark, sf):
    img = view(spark, sf, "img")
    return rs.stack_bands(rs.unstack_bands(img, BANDS, ["scene", "r", "c"]), BANDS, ["scene", "r", "c"])


# --- neighbourhoods ------------------------------------------------------------------------

@query("focal_min_max_mean", with_views("dem") + f""" select a.r, a.c, min(floor(b.z)) min_z, max(floor(b.z)) max_z, avg(floor(b.z)) mean_z from dem a cross join {square(2)} join dem b on b.r=a.r+dr and b.c=a.c+dc group by 1,2""")
def _(spark, sf):
    df = view(spark, sf, "dem").select("r", "c", F.floor("z").cast("double").alias("z"))
    return rs.focal(df, ["z"], 2, ["min", "max", "mean"], tile=64).drop("z")


@query("focal_circle", with_views("dem") + f""" select a.r, a.c, min(b.z) min_z from dem a cross join {square(3)} join dem b on b.r=a.r+dr and b.c=a.c+dc where dr*dr+dc*dc<=9 group by 1,2""")
def _(spark, sf):
    return rs.focal(view(spark, sf, "dem").select("r", "c", "z"), ["z"], 3, "min", shape="circle", tile=64).drop("z")


_NB = with_views("dem") + ", nb as (select a.r, a.c, " + ", ".join(
    f"max(case when dr={i - 1} and dc={j - 1} then b.z end) z{i}{j}" for i in range(3) for j in range(3)
) + f""" from dem a cross join {square(1)} join dem b on b.r=a.r+dr and b.c=a.c+dc group by 1,2),
    gr as (select r, c, ((z02+2*z12+z22)-(z00+2*z10+z20))/240e0 gx, ((z20+2*z21+z22)-(z00+2*z01+z02))/240e0 gy from nb where z11 is not null),
    gs as (select r, c, gx, gy, case when gx is not null and gy is not null then sqrt(gx*gx+gy*gy) end rise from gr)"""


@query("slope", _NB + " select r, c, round(degrees(atan(rise)),6) slope, round(rise*100,6) slope_pct from gs")
def _(spark, sf):
    dem = view(spark, sf, "dem").select("r", "c", "z")
    return rd(rs.terrain(dem, ["slope", "slope_pct"]).drop("z"), ["slope", "slope_pct"])


@query("hillshade", _NB + """ select r, c, round(greatest(case when rise is not null then cos(radians(45))*cos(atan(rise))+sin(radians(45))*sin(atan(rise))*cos(radians(135)-atan2(gy,-gx)) end,
    case when rise is not null then 0e0 end)*255,6) hillshade from gs""")
def _(spark, sf):
    return rd(rs.hillshade(view(spark, sf, "dem").select("r", "c", "z")).select("r", "c", "hillshade"), ["hillshade"])


_RES = with_views("img") + """, t as (select scene, r*3+a.range rr, c*3+b.range cc, ((r*3+a.range)+5e-1)/3e0-5e-1 pr, ((c*3+b.range)+5e-1)/3e0-5e-1 pc from img cross join range(3) a cross join range(3) b),
    w as (select t.*, i.range di, j.range dj, floor(pr)+i.range sr, floor(pc)+j.range sc, (case when i.range=0 then 1-(pr-floor(pr)) else pr-floor(pr) end)*(case when j.range=0 then 1-(pc-floor(pc)) else pc-floor(pc) end) wt
        from t cross join range(2) i cross join range(2) j)"""


@query("resample_bilinear", _RES + ' select w.scene, rr r, cc c, round(sum(wt*b1)/sum(wt),9) b1 from w join img on img.scene=w.scene and img.r=sr and img.c=sc group by 1,2,3')
def _(spark, sf):
    return rd(rs.resample(view(spark, sf, "img").select("scene", "r", "c", "b1"), "b1", 3, "bilinear", ["scene"]), ["b1"], 9)


@query("resample_nearest", with_views("img") + " select scene, r*2+a.range r, c*2+b.range c, b1 from img cross join range(2) a cross join range(2) b")
def _(spark, sf):
    return rs.resample(view(spark, sf, "img").select("scene", "r", "c", "b1"), "b1", 2, "nearest", ["scene"])


def _cubic(x: str) -> str:
    return f"(case when {x}<=1 then 15e-1*{x}*{x}*{x}-25e-1*{x}*{x}+1 when {x}<2 then -5e-1*{x}*{x}*{x}+25e-1*{x}*{x}-4*{x}+2 else 0e0 end)"


@query("resample_cubic", with_views("img") + f""", t as (select scene, r*3+a.range rr, c*3+b.range cc, ((r*3+a.range)+5e-1)/3e0-5e-1 pr, ((c*3+b.range)+5e-1)/3e0-5e-1 pc from img cross join range(3) a cross join range(3) b),
    w as (select t.*, cast(floor(pr) as bigint)+i.range-1 sr, cast(floor(pc) as bigint)+j.range-1 sc from t cross join range(4) i cross join range(4) j),
    k as (select *, {_cubic('abs(pr-sr)')}*{_cubic('abs(pc-sc)')} wt from w)
    select k.scene, rr r, cc c, round(sum(wt*(b1*{d(0.7390851332)}))/sum(wt),8) b1 from k join img on img.scene=k.scene and img.r=sr and img.c=sc group by 1,2,3""")
def _(spark, sf):
    img = view(spark, sf, "img").select("scene", "r", "c", (F.col("b1") * 0.7390851332).alias("b1"))
    return rd(rs.resample(img, "b1", 3, "cubic", ["scene"]), ["b1"], 8)


# pixels of 3 m from (500000, 9200000); targets of 10/3 m (and 7.5 m) from an origin 1.7 m off
_NEAR = "case when x>=-5e-1 and x<5e-1 then 1e0 else 0e0 end"
_LINEAR = "greatest(1-abs(x),0e0)"
_GRIDS = {"nearest": (10 / 3, _NEAR, 1), "bilinear": (7.5, _LINEAR, 3), "cubic": (10 / 3, _cubic("abs(x)"), 3)}


def _axis_sql(axis: str, size: float, kernel: str, reach: int, sign: str, n: str) -> str:
    """Weights (scene, <axis> of the source, target index, w) along one axis."""
    s, low = ("-3e0", "9200000e0") if sign == "-" else ("3e0", "500000e0")
    t = f"({sign}{d(size)})"
    stretch = "1e0" if kernel == _NEAR else f"greatest({t}/{s},1e0)"
    return f"""(select scene, src {axis}, i t{axis}, w from (select scene, i, src, ({kernel}) w from (
        select scene, i, src, (p-src)/{stretch} x from (select scene, i, p, cast(floor(p) as bigint)+k.range-{reach} src from (
            select scene, n, i.range i, i.range*({t}/{s})+(({low}{sign}{d(1.7)}+{t}/2-{low})/{s}-5e-1) p from (select scene, {n} n from dm) cross join range(60) i)
        cross join range({2 * reach + 2}) k where i<floor(n*3e0/{d(size)}) and p>=-5e-1 and p<n-5e-1))) where w<>0)"""


for _how, (_size, _kern, _reach) in _GRIDS.items():
    def _onto(spark, sf, how=_how, size=_size):
        img = view(spark, sf, "img").select("scene", "r", "c", (F.col("b1") * 0.7390851332).alias("b1"), F.when(
            F.col("b2") > 0.2, F.col("b2") * 0.7390851332).alias("b2"))
        dims = gr.image_size(img)
        grid = lambda x, y, d, n: dims.select(
            "scene", F.lit(x).alias("x0"), F.lit(y).alias("y0"), F.lit(d).alias("dx"), F.lit(-d).alias("dy"), n("w").alias("width"), n("h").alias("height"))
        src = grid(500000e0, 9200000e0, 3e0, F.col)
        dst = grid(500000e0 + 1.7, 9200000e0 - 1.7, size, lambda c: F.floor(F.col(c) * 3e0 / size))
        return rd(gr.resample_to(img, ["b1", "b2"], src, dst, how), ["b1", "b2"], 8)

    query(f"resample_onto_grid_{_how}", with_views("img") + f""", dm as (select scene, max(r)+1 h, max(c)+1 w from img group by 1),
        wr as {_axis_sql('r', _size, _kern, _reach, '-', 'h')}, wc as {_axis_sql('c', _size, _kern, _reach, '+', 'w')}
        select scene, tr r, tc c, round(sum(wr.w*wc.w*(b1*{d(0.7390851332)}))/nullif(sum(wr.w*wc.w) filter(b1 is not null),0),8) b1,
            round(sum(wr.w*wc.w*(b2*{d(0.7390851332)})) filter(b2>2e-1)/nullif(sum(wr.w*wc.w) filter(b2>2e-1),0),8) b2
        from img join wr using(scene,r) join wc using(scene,c) group by 1,2,3""")(_onto)


_SHADOW = with_views("img") + f""", f as (select scene, r, c, b1>75e-2 cloud, b2<3e-1 dark, cast(scene*37%360 as double) az from img),
    st as (select distinct scene, r-cast(floor(i.range*sin(radians(90-az))+5e-1) as bigint) r, c+cast(floor(i.range*cos(radians(90-az))+5e-1) as bigint) c from f cross join range(1,21) i where cloud),
    fl as (select f.*, case when cloud or (dark and st.r is not null) then 1 else 0 end flag from f left join st on st.scene=f.scene and st.r=f.r and st.c=f.c),
    er as (select a.scene, a.r, a.c, min(b.flag) flag from fl a cross join {square(1)} join fl b on b.scene=a.scene and b.r=a.r+dr and b.c=a.c+dc where dr*dr+dc*dc<=1 group by 1,2,3),
    di as (select a.scene, a.r, a.c, max(b.flag) flag from er a cross join {square(3)} join er b on b.scene=a.scene and b.r=a.r+dr and b.c=a.c+dc where dr*dr+dc*dc<=9 group by 1,2,3)"""


@query("project_shadow", _SHADOW + " select fl.scene, fl.r, fl.c, fl.flag, di.flag=1 masked from fl join di using(scene,r,c)")
def _(spark, sf):
    f = view(spark, sf, "img").select("scene", "r", "c", (F.col("b1") > 0.75).alias("cloud"), (F.col("b2") < 0.3).alias("dark"), (F.col("scene") * 37 % 360).cast("double").alias("az"))
    return rs.project_shadow(f, F.col("az"), 20, 1.0, erode=1, dilate=3).select("scene", "r", "c", "flag", "masked")


@query("clip_window_and_mask", with_views("dem") + " select r, c, z from dem a where r>=10 and r<60 and c>=5 and c<50 and exists(select 1 from dem b where b.r=a.r and b.c=a.c and b.cls=3)")
def _(spark, sf):
    dem = view(spark, sf, "dem").select("r", "c", "z", "cls")
    return rs.clip(dem, (10, 5, 60, 50), dem.where("cls = 3")).select("r", "c", "z")


_OV = ", a as (select r, c, z from dem where z>1e2), b as (select r, c, cls from dem where cls<6)"


@query("overlay_clip", with_views("dem") + _OV + " select r, c, z from a semi join b using(r,c)")
def _(spark, sf):
    dem = view(spark, sf, "dem")
    return rs.overlay_cells(dem.where("z > 1e2").select("r", "c", "z"), dem.where("cls < 6").select("r", "c", "cls"), "clip")


@query("overlay_intersection", with_views("dem") + _OV + " select r, c, z, cls from a join b using(r,c)")
def _(spark, sf):
    dem = view(spark, sf, "dem")
    return rs.overlay_cells(dem.where("z > 1e2").select("r", "c", "z"), dem.where("cls < 6").select("r", "c", "cls"), "intersection")


@query("overlay_union", with_views("dem") + _OV + " select r, c, z, cls from a full join b using(r,c)")
def _(spark, sf):
    dem = view(spark, sf, "dem")
    return rs.overlay_cells(dem.where("z > 1e2").select("r", "c", "z"), dem.where("cls < 6").select("r", "c", "cls"), "union")


@query("overlay_difference", with_views("dem") + _OV + " select r, c, z from a anti join b using(r,c)")
def _(spark, sf):
    dem = view(spark, sf, "dem")
    return rs.overlay_cells(dem.where("z > 1e2").select("r", "c", "z"), dem.where("cls < 6").select("r", "c", "cls"), "difference")


def _cross(name: str, a: str, b: str, x0: str, y0: str, dx: int, dy: int) -> str:
    t = f"(lv-{a})/({b}-{a})"
    return f"case when ({a}>=lv)<>({b}>=lv) then row({x0}+{dx}*{t},{y0}+{dy}*{t}) end {name}"


@query("contour", with_views("dem") + f""", q as (select a.r, a.c, a.z z00, b.z z01, x.z z10, y.z z11 from dem a join dem b on b.r=a.r and b.c=a.c+1 join dem x on x.r=a.r+1 and x.c=a.c join dem y on y.r=a.r+1 and y.c=a.c+1),
    l as (select *, g.range*1e2 lv from q cross join range(0,20) g where g.range between floor(least(z00,z01,z10,z11)/1e2)+1 and floor(greatest(z00,z01,z10,z11)/1e2)),
    e as (select *, {_cross('tp', 'z00', 'z01', 'c', 'r', 1, 0)}, {_cross('bo', 'z10', 'z11', 'c', '(r+1)', 1, 0)},
        {_cross('le', 'z00', 'z10', 'c', 'r', 0, 1)}, {_cross('ri', 'z01', 'z11', '(c+1)', 'r', 0, 1)} from l),
    f as (select lv, list_filter([tp,ri,bo,le], lambda p: p is not null) ps, (z00>=lv)=((z00+z01+z10+z11)/4>=lv) same, tp, ri, bo, le from e),
    s as (select lv, ps[1] p, ps[2] q from f where len(ps)=2 union all select lv, tp, case when same then ri else le end from f where len(ps)=4
        union all select lv, case when same then bo else bo end, case when same then le else ri end from f where len(ps)=4)
    select lv "level", round(p[1],6) x0, round(p[2],6) y0, round(q[1],6) x1, round(q[2],6) y1 from s""")
def _(spark, sf):
    return rd(rs.contour(view(spark, sf, "dem").select("r", "c", "z"), "z", 100.0), ["x0", "y0", "x1", "y1"])


# --- time series ---------------------------------------------------------------------------

_INT = with_views("px_ts") + """, sp as (select min(dt) a, max(dt) b from px_ts),
    st as (select pix, cast(unnest(range(0, cast(b-a as bigint), 8)) as int) step, a from (select distinct pix from px_ts), sp),
    sd as (select pix, step, cast(a+step as date) dt from st),
    ob as (select pix, dt, nir, red from px_ts),
    lu as (select s.pix, s.step, s.dt, max(o.dt) filter(o.dt<=s.dt) lo, min(o.dt) filter(o.dt>=s.dt) hi from sd s join ob o using(pix) group by 1,2,3),
    vv as (select lu.*, a.nir ln, b.nir hn, a.red lr, b.red hr from lu left join ob a on a.pix=lu.pix and a.dt=lo left join ob b on b.pix=lu.pix and b.dt=hi),
    iv as (select pix, step, dt, case when lo=hi then ln else ln+(hn-ln)*(dt-lo)/nullif(hi-lo,0) end nir, case when lo=hi then lr else lr+(hr-lr)*(dt-lo)/nullif(hi-lo,0) end red from vv),
    interp as (select pix, step, dt, last_value(nir ignore nulls) over w nir, last_value(red ignore nulls) over w red from iv window w as (partition by pix order by step))"""


@query("interpolate_linear", _INT + " select pix, step, dt, round(nir,6) nir, round(red,6) red from interp")
def _(spark, sf):
    return rd(rs.interpolate_linear(view(spark, sf, "px_ts"), ["nir", "red"], 8), ["nir", "red"])


@query("regular_dates", with_views("px_ts") + " select pix, cast(dt-date '2024-01-01' as int) step, dt \"date\" from px_ts")
def _(spark, sf):
    steps = view(spark, sf, "px_ts").select("pix", F.datediff("dt", F.lit("2024-01-01").cast("date")).alias("step"))
    return rs.regular_dates(steps, "2024-01-01")


for _how, _sql in {
    "max": "max(nir)", "sum": "round(sum(nir),6)", "mean": "round(avg(nir),6)",
    "first": "arg_min(nir,dt)", "last": "arg_max(nir,dt)", "mode": None,
}.items():
    if _sql is None:
        _text = with_views("px_ts") + """, k as (select pix, round(nir,0) nir, count(*) n from px_ts group by 1,2) select pix, arg_max(nir, row(n,-nir)) nir from k group by 1"""
    else:
        _text = with_views("px_ts") + f" select pix, {_sql} nir from px_ts where nir is not null group by 1"

    def _composite(spark, sf, how=_how):
        ts = view(spark, sf, "px_ts")
        if how == "mode":
            ts = ts.withColumn("nir", F.round("nir", 0))
        out = rs.composite(ts, "nir", how, ["pix"])
        return rd(out, ["nir"]) if how in ("sum", "mean") else out

    query(f"composite_{_how}", _text)(_composite)


@query("quality_mosaic", with_views("px_ts") + " select pix, arg_max(red, row(nir,dt)) red from px_ts where dt>=date '2024-01-05' and dt<date '2024-01-20' and nir is not null group by 1")
def _(spark, sf):
    return rs.quality_mosaic(view(spark, sf, "px_ts"), "nir", "red", "2024-01-05", "2024-01-20", ["pix"])


# --- zones -----------------------------------------------------------------------------

_Z = ", zn as (select r, c, cast(floor(r/10e0)*10+floor(c/10e0) as bigint) zid from dem)"


def zones(spark, sf):
    return view(spark, sf, "dem").select("r", "c", (F.floor(F.col("r") / 10) * 10 + F.floor(F.col("c") / 10)).alias("zid"))


@query("zonal_mean", with_views("dem") + _Z + " select zid, cls, avg(floor(z)) z from dem join zn using(r,c) group by 1,2")
def _(spark, sf):
    dem = view(spark, sf, "dem").withColumn("z", F.floor("z").cast("double"))
    return rs.zonal_mean(dem, zones(spark, sf), ["z"], by=["cls"])


@query("zonal_max", with_views("dem") + _Z + " select zid, max(z) z from dem join zn using(r,c) group by 1")
def _(spark, sf):
    return rs.zonal_max(view(spark, sf, "dem"), zones(spark, sf), "z")


_COST = "case cls " + " ".join(f"when {k} then {v}" for k, v in RESISTANCE.items()) + " else 50 end"


@query("permeability", with_views("dem") + _Z + f""", p as (select zid, round(100-sum({_COST})/cast(count(*) as double),2) permeability from dem join zn using(r,c) where cls between 1 and 10 group by 1)
    select zid, coalesce(permeability,50e0) permeability from (select distinct zid from zn) left join p using(zid)""")
def _(spark, sf):
    return rs.permeability(view(spark, sf, "dem"), zones(spark, sf), ["zid"])


@query("global_band_stats", with_views("img") + " " + " union all ".join(
    f"select '{b}' band, count(*) n, round(avg({b}),6) mean, round(sqrt(greatest(avg({b}*{b})-avg({b})*avg({b}),0)),6) std from img where {b}>0" for b in BANDS))
def _(spark, sf):
    return rd(rs.global_band_stats(view(spark, sf, "img"), BANDS), ["mean", "std"])


@query("range_limits", with_views("dem") + """ select 'cumulative' mode, round(quantile_cont(z,2e-2),6) lo, round(quantile_cont(z,98e-2),6) hi from dem
    union all select 'minmax', round(min(z),6), round(max(z),6) from dem union all select 'deviation', round(avg(z)-2*stddev_pop(z),6), round(avg(z)+2*stddev_pop(z),6) from dem""")
def _(spark, sf):
    dem = view(spark, sf, "dem")
    parts = [rs.range_limits(dem, "z", m).select(F.lit(m).alias("mode"), "lo", "hi") for m in ("cumulative", "minmax", "deviation")]
    return rd(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["lo", "hi"])


# --- normalization and patches ---------------------------------------------------------------

_LONG = with_views("img") + ", lg as (" + " union all ".join(f"select scene, r, c, '{b}' band, {b} v from img" for b in BANDS) + ")"


def long(spark, sf):
    return rs.unstack_bands(view(spark, sf, "img"), BANDS, ["scene", "r", "c"])


_NORMS = {
    "minmax": "coalesce((v-lo)/nullif(hi-lo,0),0e0) from lg join (select scene, band, min(v) lo, max(v) hi from lg group by 1,2) using(scene,band)",
    "percentile": "least(greatest(coalesce((v-lo)/nullif(hi-lo,0),0e0),0e0),1e0) from lg left join (select scene, band, quantile_cont(v,2e-2) lo, quantile_cont(v,98e-2) hi from lg where v>0 group by 1,2) using(scene,band)",
    "zscore": "(v-mu)/greatest(sd,1e-8) from lg join (select scene, band, avg(v) filter(v>0) mu, stddev_pop(v) filter(v>0) sd from lg group by 1,2) using(scene,band)",
}
for _how, _sql in _NORMS.items():
    _expr, _src = _sql.split(" from lg", 1)

    def _normalize(spark, sf, how=_how):
        return rd(rs.normalize(long(spark, sf), how), ["value"]).select("scene", "r", "c", "band", "value")

    query(f"normalize_{_how}", _LONG + f' select scene, r, c, band, round({_expr},6) "value" from lg{_src}')(_normalize)


_HR = ", hr as (select scene, r*3+a.range r, c*3+b.range c, b1, case when (r+c)%17=0 then 0e0 else b2 end b2 from img cross join range(3) a cross join range(3) b)"
_PATCH = with_views("img") + _HR + """, dm as (select scene, max(r)+1 h, max(c)+1 w from img group by 1),
    o as (select scene, i.range*5 y0, j.range*5 x0 from dm cross join range(11) i cross join range(11) j where i.range*5<=h-10 and j.range*5<=w-10),
    lv as (select o.scene, y0, x0, sum(cast(b1<>0 as int)+cast(b2<>0 as int))/200e0 lr_valid from o join img on img.scene=o.scene and img.r>=y0 and img.r<y0+10 and img.c>=x0 and img.c<x0+10 group by 1,2,3),
    hv as (select o.scene, y0, x0, sum(cast(b1<>0 as int)+cast(b2<>0 as int))/1800e0 hr_valid from o join hr on hr.scene=o.scene and hr.r>=y0*3 and hr.r<y0*3+30 and hr.c>=x0*3 and hr.c<x0*3+30 group by 1,2,3)"""


def image_pair(spark, sf):
    """An image and its version with pixels three times smaller and more missing values."""
    img = view(spark, sf, "img").select("scene", "r", "c", "b1", "b2")
    three = F.sequence(F.lit(0), F.lit(2))
    return img, img.withColumn("i", F.explode(three)).withColumn("j", F.explode(three)).select(
        "scene", (F.col("r") * 3 + F.col("i")).alias("r"), (F.col("c") * 3 + F.col("j")).alias("c"), "b1",
        F.when((F.col("r") + F.col("c")) % 17 == 0, 0e0).otherwise(F.col("b2")).alias("b2"))


@query("extract_patches", _PATCH + f" select scene, y0, x0, round(lr_valid,6) lr_valid, round(hr_valid,6) hr_valid from lv join hv using(scene,y0,x0) where lr_valid>={d(0.9)} and hr_valid>={d(0.9)}")
def _(spark, sf):
    return rd(gr.extract_patches(*image_pair(spark, sf), ["b1", "b2"], size=10, scale=3, stride=5), ["lr_valid", "hr_valid"])


_ORIG = ", og as (select distinct scene, cast(floor(r/10e0)*10 as bigint) y0, cast(floor(c/10e0)*10 as bigint) x0 from img)"


def origins(spark, sf):
    f = lambda c: (F.floor(F.col(c) / 10) * 10).cast("bigint")
    return view(spark, sf, "img").select("scene", f("r").alias("y0"), f("c").alias("x0")).distinct()


@query("patch_pixels", with_views("img") + " select scene, cast(floor(r/10e0)*10 as bigint) y0, cast(floor(c/10e0)*10 as bigint) x0, cast(r%10 as int) pr, cast(c%10 as int) pc, b1 from img")
def _(spark, sf):
    return rs.patch_pixels(view(spark, sf, "img").select("scene", "r", "c", "b1"), origins(spark, sf), 10).select("scene", "y0", "x0", "pr", "pc", "b1")


def _u(seed: int, *parts: str) -> str:
    text = "||'|'||".join([f"'{seed}'", *parts])
    return f"(cast(('0x'||substr(md5({text}),1,12)) as bigint)/cast(281474976710656 as double))"


_KEY = ("cast(scene as varchar)", "cast(y0 as varchar)", "cast(x0 as varchar)")
_PP = ", pp as (select scene, cast(floor(r/10e0)*10 as bigint) y0, cast(floor(c/10e0)*10 as bigint) x0, cast(r%10 as int) pr, cast(c%10 as int) pc, b1, b2 from img)"


def patch_table(spark, sf):
    f = lambda c: (F.floor(F.col(c) / 10) * 10).cast("bigint")
    return view(spark, sf, "img").select("scene", f("r").alias("y0"), f("c").alias("x0"), (F.col("r") % 10).cast("int").alias("pr"), (F.col("c") % 10).cast("int").alias("pc"), "b1", "b2")


@query("augment", with_views("img") + _PP + f""", f as (select *, case when {_u(5, "'v'", *_KEY)}<5e-1 then 9-pr else pr end p, case when {_u(5, "'h'", *_KEY)}<5e-1 then 9-pc else pc end q, floor({_u(5, "'r'", *_KEY)}*4) k from pp)
    select scene, y0, x0, case k when 0 then p when 1 then 9-q when 2 then 9-p else q end pr, case k when 0 then q when 1 then p when 2 then 9-q else 9-p end pc, b1 from f""")
def _(spark, sf):
    return rs.augment(patch_table(spark, sf).drop("b2"), 10, 5)


@query("jitter", with_views("img") + _PP + f" select scene, y0, x0, pr, pc, round(b1*(1+(2*{_u(5, repr('b1'), *_KEY)}-1)*{d(0.05)}),6) b1, round(b2*(1+(2*{_u(5, repr('b2'), *_KEY)}-1)*{d(0.05)}),6) b2 from pp")
def _(spark, sf):
    return rd(rs.jitter(patch_table(spark, sf), ["b1", "b2"], 5), ["b1", "b2"])


@query("cutout", with_views("img") + _PP + f""", h as (select *, floor({_u(5, "'cy'", *_KEY)}*8) y, floor({_u(5, "'cx'", *_KEY)}*8) x, {_u(5, "'cut'", *_KEY)}<5e-1 hit from pp)
    select scene, y0, x0, pr, pc, case when hit and pr>=y and pr<y+3 and pc>=x and pc<x+3 then 0e0 else b1 end b1 from h""")
def _(spark, sf):
    return rs.cutout(patch_table(spark, sf).drop("b2"), ["b1"], 10, 5, fraction=0.3)


@query("random_patches", with_views("img") + f""", dm as (select scene, max(r)+1 h, max(c)+1 w from img group by 1 having max(r)+1>16 and max(c)+1>16),
    og as (select scene, h, w, cast(y.range as bigint) y0, cast(x.range as bigint) x0 from dm cross join range(1000) y cross join range(1000) x where y.range<=h-16 and x.range<=w-16),
    rw as (select scene, r, c, sum(cast(b1<>0 as int)+cast(b2<>0 as int)) over(partition by scene, r order by c range between current row and 15 following) k from img),
    cl as (select scene, r, c, sum(k) over(partition by scene, c order by r range between current row and 15 following) k from rw),
    sh as (select scene, h, w, y0, x0, {_u(42, "'o'", *_KEY)} u from og join cl using(scene) where r=y0 and c=x0 and k/512e0>={d(0.9)}),
    rk as (select scene, cast(row_number() over(partition by scene order by u, y0, x0) as int) patch, y0, x0 from sh)
    select scene, patch, y0, x0, true "valid" from rk where patch<=5
    union all select scene, 1, cast(h//2-8 as bigint), cast(w//2-8 as bigint), false from dm where scene not in (select scene from sh)""")
def _(spark, sf):
    return gr.random_patches(view(spark, sf, "img").select("scene", "r", "c", "b1", "b2"), ["b1", "b2"], size=16, n=5, seed=42)


_RUN = "sum({k}) over(partition by scene, {by} order by {on} range between current row and {n} following)"


@query("random_patch_pairs", with_views("img") + f""", dm as (select scene, max(r)+1 h, max(c)+1 w from img group by 1 having max(r)+1>16 and max(c)+1>16),
    ok as (select scene, r, c, cast(b1<>0 as int)+cast(b2<>0 as int) l, 9*(cast(b1<>0 as int)+cast((r+c)%17<>0 and b2<>0 as int)) h from img),
    rw as (select scene, r, c, {_RUN.format(k='l', by='r', on='c', n=15)} l, {_RUN.format(k='h', by='r', on='c', n=15)} h from ok),
    cl as (select scene, r, c, {_RUN.format(k='l', by='c', on='r', n=15)} l, {_RUN.format(k='h', by='c', on='r', n=15)} h from rw),
    sh as (select scene, r y0, c x0 from cl join dm using(scene) where r<=dm.h-16 and c<=dm.w-16 and l/512e0>={d(0.9)} and cl.h/4608e0>={d(0.9)}),
    rk as (select *, cast(row_number() over(partition by scene order by {_u(42, "'o'", *_KEY)}, y0, x0) as int) patch from sh)
    select scene, patch, y0, x0, true "valid" from rk where patch<=5
    union all select scene, 1, cast(h//2-8 as bigint), cast(w//2-8 as bigint), false from dm where scene not in (select scene from sh)""")
def _(spark, sf):
    return gr.random_patch_pairs(*image_pair(spark, sf), ["b1", "b2"], size=16, n=5, seed=42)


@query("random_crop", with_views("img") + _PP + f""", o as (select *, cast(floor({_u(5, "'top'", *_KEY)}*7) as int) t, cast(floor({_u(5, "'left'", *_KEY)}*7) as int) l from pp),
    hr as (select o.* exclude(pr,pc), cast(pr*3+a.range as int) pr, cast(pc*3+b.range as int) pc from o cross join range(3) a cross join range(3) b)
    select 'lr' side, scene, y0, x0, pr-t pr, pc-l pc, b1 from o where pr>=t and pr<t+4 and pc>=l and pc<l+4
    union all select 'hr', scene, y0, x0, pr-3*t, pc-3*l, b1 from hr where pr>=3*t and pr<3*t+12 and pc>=3*l and pc<3*l+12""")
def _(spark, sf):
    lr = patch_table(spark, sf).drop("b2")
    three = F.sequence(F.lit(0), F.lit(2))
    hr = lr.withColumn("i", F.explode(three)).withColumn("j", F.explode(three)).withColumns(
        {"pr": F.col("pr") * 3 + F.col("i"), "pc": F.col("pc") * 3 + F.col("j")}).drop("i", "j")
    a, b = gr.random_crop(lr, hr, size=10, crop=12, seed=5)
    return a.withColumn("side", F.lit("lr")).unionByName(b.withColumn("side", F.lit("hr")))


def _wt(p: str) -> str:
    ramp = lambda i: f"5e-1*(1-cos(pi()*{i}/3e0))"
    return f"(case when {p}<4 then {ramp(p)} else 1e0 end)*(case when {p}>=16 then {ramp(f'(19-{p})')} else 1e0 end)"


_BLEND = with_views("img") + f""", dm as (select scene, max(r)+1 h, max(c)+1 w from img group by 1),
    tt as (select distinct scene, least(i.range*16,h-20) y0, least(j.range*16,w-20) x0 from dm cross join range(8) i cross join range(8) j where i.range<greatest(1,ceil((h-4)/16e0)) and j.range<greatest(1,ceil((w-4)/16e0))),
    tp as (select tt.scene, y0, x0, r, c, r-y0 pr, c-x0 pc, b1+y0*1e-2+x0*1e-3 v from tt join img on img.scene=tt.scene and r>=y0 and r<y0+20 and c>=x0 and c<x0+20)"""


@query("tile_origins", _BLEND + " select scene, y0, x0 from tt")
def _(spark, sf):
    dims = view(spark, sf, "img").groupBy("scene").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    return rs.tile_origins(dims, 20, 4).select("scene", "y0", "x0")


@query("blend_tiles", _BLEND + f" select scene, r, c, round(sum({_wt('pr')}*{_wt('pc')}*v)/greatest(sum({_wt('pr')}*{_wt('pc')}),1e-8),9) v from tp group by 1,2,3")
def _(spark, sf):
    img = view(spark, sf, "img").select("scene", "r", "c", "b1")
    dims = img.groupBy("scene").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    tiles = rs.patch_pixels(img, rs.tile_origins(dims, 20, 4), 20).withColumn("v", F.col("b1") + F.col("y0") * 1e-2 + F.col("x0") * 1e-3)
    return rd(rs.blend_tiles(tiles, ["v"], 20, 4), ["v"], 9)


# --- quality -----------------------------------------------------------------------------

def _s(fmt: str) -> str:
    return "(" + "+".join(fmt.format(b=b) for b in BANDS) + ")"


_PAIR = with_views("img", "img_pred") + ", pr as (select scene, r, c, " + ", ".join(f"p.{b} p{b}, t.{b} t{b}" for b in BANDS) + " from img_pred p join img t using(scene,r,c))"
_MSE = "avg((p{b}-t{b})*(p{b}-t{b}))"
_COS = f"{_s('p{b}*t{b}')}/(sqrt({_s('p{b}*p{b}')})*sqrt({_s('t{b}*t{b}')})+1e-8)"
_PSNR = f"10*log10(1/({_s(_MSE)}/4))"
_SAM = f"degrees(avg(acos(least(greatest({_COS},-1e0),1e0))))"
_ERGAS = f"1e2/3*sqrt({_s('coalesce(case when avg(t{b})>0 then ' + _MSE + '/(avg(t{b})*avg(t{b})) end,0e0)')}/4)"


@query("psnr", _PAIR + f" select scene, round({_PSNR},6) psnr, round({_s('10*log10(1/' + _MSE + ')')}/4,6) psnr_per_band from pr group by 1")
def _(spark, sf):
    p = mt.pair(view(spark, sf, "img_pred"), view(spark, sf, "img"), BANDS)
    return rd(mt.measure(p, BANDS, ["psnr", "psnr_per_band"]), ["psnr", "psnr_per_band"])


def _guard(eps: str) -> str:
    cos = f"{_s('p{b}*t{b}')}/(greatest(sqrt({_s('p{b}*p{b}')}),{eps})*greatest(sqrt({_s('t{b}*t{b}')}),{eps}))"
    return f"avg(acos(least(greatest({cos},-(1-{eps})),1-{eps})))"


@query("sam", _PAIR + f" select scene, round({_SAM},5) sam, round(degrees({_guard('1e-8')}),5) sam_metric, round({_guard('1e-6')},6) sam_loss from pr group by 1")
def _(spark, sf):
    p = mt.pair(view(spark, sf, "img_pred"), view(spark, sf, "img"), BANDS)
    return p.groupBy("scene").agg(F.round(mt.sam(BANDS), 5).alias("sam"), F.round(mt.sam(BANDS, "metric"), 5).alias("sam_metric"),
                                  F.round(mt.sam(BANDS, "loss", False), 6).alias("sam_loss"))


@query("ergas", _PAIR + f" select scene, round({_ERGAS},6) ergas, round(1e2/3*sqrt({_s(_MSE + '/pow(greatest(avg(t{b}),1e-8),2)')}/4),6) ergas_clamped from pr group by 1")
def _(spark, sf):
    p = mt.pair(view(spark, sf, "img_pred"), view(spark, sf, "img"), BANDS)
    return p.groupBy("scene").agg(F.round(mt.ergas(BANDS), 6).alias("ergas"), F.round(mt.ergas(BANDS, clamp=True), 6).alias("ergas_clamped"))


_STEP = "+".join(f"avg(abs((p{b}-p{a})-(t{b}-t{a})))" for a, b in zip(BANDS, BANDS[1:]))


@query("sr_error_metrics", _PAIR + f""" select scene, round({_s('avg(abs(p{b}-t{b}))')}/4,6) l1, round({_s('avg(sqrt(pow(p{b}-t{b},2)+1e-12))')}/4,6) charbonnier,
    round({_s('avg(abs(p{b}-t{b}))')}/4+{_guard('1e-6')}*{d(0.1)},6) combined, round(({_STEP})/3,6) spectral_gradient from pr group by 1""")
def _(spark, sf):
    names = ["l1", "charbonnier", "combined", "spectral_gradient"]
    return rd(mt.measure(mt.pair(view(spark, sf, "img_pred"), view(spark, sf, "img"), BANDS), BANDS, names), names)


def _ssim_sql(span: str) -> str:
    u = lambda k: f"({k}/49e0)"
    def one(b: str) -> str:
        ux, uy = u(f"a{b}"), u(f"b{b}")
        n = "(49e0/48e0)"
        vx, vy, vxy = (f"{n}*({u(f'{k}{b}')}-{p}*{q})" for k, p, q in (("aa", ux, ux), ("bb", uy, uy), ("ab", ux, uy)))
        c1, c2 = f"pow(1e-2*{span.format(b=b)},2)", f"pow(3e-2*{span.format(b=b)},2)"
        return f"avg((2*{ux}*{uy}+{c1})*(2*{vxy}+{c2})/(({ux}*{ux}+{uy}*{uy}+{c1})*({vx}+{vy}+{c2})))"
    sums = ", ".join(f"sum(q.p{b}) a{b}, sum(q.t{b}) b{b}, sum(q.p{b}*q.p{b}) aa{b}, sum(q.t{b}*q.t{b}) bb{b}, sum(q.p{b}*q.t{b}) ab{b}" for b in BANDS)
    return f""", wn as (select w.scene, w.r, w.c, count(*) n, {sums} from pr w cross join {square(3)} join pr q on q.scene=w.scene and q.r=w.r+dr and q.c=w.c+dc group by 1,2,3),
    sn as (select scene, {', '.join(f'max(t{b})-min(t{b}) s{b}' for b in BANDS)} from pr group by 1),
    ss as (select scene, ({'+'.join(one(b) for b in BANDS)})/4 ssim from wn join sn using(scene) where n=49 group by 1)"""


@query("ssim", _PAIR + _ssim_sql("1e0") + " select scene, round(ssim,6) ssim from ss")
def _(spark, sf):
    p = mt.pair(view(spark, sf, "img_pred"), view(spark, sf, "img"), BANDS)
    return rd(mt.ssim(p, BANDS), ["ssim"])


def _ssim_mixed_sql() -> str:
    def one(b: str) -> str:
        u = lambda k: f"({k}{b}/cast(n as double))"
        vx, vy, vxy = (f"(n/(n-1e0))*({u(k)}-{u(p)}*{u(q)})" for k, p, q in (("aa", "a", "a"), ("bb", "b", "b"), ("ab", "a", "b")))
        return f"avg((2*{u('a')}*{u('b')}+pow(1e-2*s{b},2))*(2*{vxy}+pow(3e-2*s{b},2))/(({u('a')}*{u('a')}+{u('b')}*{u('b')}+pow(1e-2*s{b},2))*({vx}+{vy}+pow(3e-2*s{b},2))))"
    sums = ", ".join(f"sum(q.p{b}) a{b}, sum(q.t{b}) b{b}, sum(q.p{b}*q.p{b}) aa{b}, sum(q.t{b}*q.t{b}) bb{b}, sum(q.p{b}*q.t{b}) ab{b}" for b in BANDS)
    return f""", pm as (select scene*100+(r//9)*10+c//9 scene, r%9 r, c%9 c, pr.* exclude(scene,r,c) from pr where r%9<2+(scene+r//9)%8 and c%9<3+(scene*2+c//9)%7),
    sn as (select scene, greatest(least((least(max(r),max(c)))//2,3),1) half, {', '.join(f'max(t{b})-min(t{b}) s{b}' for b in BANDS)} from pm group by 1),
    wn as (select w.scene, w.r, w.c, any_value(half) half, count(*) n, {sums} from pm w join sn using(scene) cross join {square(3)} join pm q on q.scene=w.scene and q.r=w.r+dr and q.c=w.c+dc
        where abs(dr)<=half and abs(dc)<=half group by 1,2,3)
    select scene, round(({'+'.join(one(b) for b in BANDS)})/4,6) ssim from wn join sn using(scene) where n=(2*wn.half+1)*(2*wn.half+1) group by 1"""


@query("ssim_small_images", _PAIR + _ssim_mixed_sql())
def _(spark, sf):
    p = mt.pair(view(spark, sf, "img_pred"), view(spark, sf, "img"), BANDS)
    tr, tc = F.floor(F.col("r") / 9), F.floor(F.col("c") / 9)
    small = p.where((F.col("r") % 9 < 2 + (F.col("scene") + tr) % 8) & (F.col("c") % 9 < 3 + (F.col("scene") * 2 + tc) % 7)).withColumns(
        {"scene": F.col("scene") * 100 + tr * 10 + tc, "r": F.col("r") % 9, "c": F.col("c") % 9})
    return rd(mt.ssim(small, BANDS, None), ["ssim"])


_EVAL = _PAIR + _ssim_sql("s{b}") + f", ev as (select scene, {_PSNR} psnr, {_SAM} sam, {_ERGAS} ergas from pr group by 1), al as (select * from ev join ss using(scene))"


@query("evaluate", _EVAL + " select scene, round(psnr,6) psnr, round(sam,5) sam, round(ergas,6) ergas, round(ssim,6) ssim from al")
def _(spark, sf):
    e = mt.evaluate(view(spark, sf, "img_pred"), view(spark, sf, "img"), BANDS)
    return rd(rd(e, ["psnr", "ergas", "ssim"]), ["sam"], 5)


@query("evaluate_dataset_mean", _EVAL + " select round(avg(psnr),6) psnr, round(avg(sam),5) sam, round(avg(ergas),6) ergas, round(avg(ssim),6) ssim, count(*) images from al")
def _(spark, sf):
    e = mt.dataset_mean(mt.evaluate(view(spark, sf, "img_pred"), view(spark, sf, "img"), BANDS))
    return rd(rd(e, ["psnr", "ergas", "ssim"]), ["sam"], 5)
