"""Table, listing, join and file queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terraloom.functions import scalars as sc
from terraloom.functions.fixed_values import EIGHT_BANDS, LANDSAT_5_7, LANDSAT_8_9, S2_SIX, S2_TO_FOUR_BAND, SIX_OF_EIGHT, WORLD_COVER
from terraloom.functions.hexgrid import assign_cell
from terraloom.operators import joins as jn, tables as tb
from terraloom.operators.occurrence import species_years
from terraloom.plans.registry import query
from terraloom.plans.sqltext import SIZE, d, hexed
from terraloom.scale import work_dir
from terraloom.sources import layers as ly
from terraloom.sources.fixtures import table, view, with_views


def folder(spark) -> str:
    return f"{work_dir(spark)}/{uuid.uuid4().hex}"


# --- files -----------------------------------------------------------------------------

_OCC12 = """select cast(rid as string) No, 'survey' Source, species Species, species Common_Name, case when yr>=1999 then 'TARGET' end Status,
    cast(yr as string) Year, '1' Month, 'x' Month_Year, method Survey_Method, cast(null as string) Location,
    case when rid%10=3 then 'n/a' else cast(y as string) end Latitude, case when yr=1997 and method='5-LOW' then null else cast(x as string) end Longitude from {occ}"""


@query("load_occurrences", with_views("occ") + """ select rid "No", species "Species", yr "Year", y "Latitude", x "Longitude" from occ
    where rid%10<>3 and not (yr=1997 and method='5-LOW')""")
def _(spark, sf):
    path = folder(spark)
    ly.write_csv(spark.sql(_OCC12, occ=view(spark, sf, "occ")), path)
    return ly.load_occurrences(spark, path).select("No", "Species", "Year", "Latitude", "Longitude")


@query("read_layer", with_views("zone") + " select * from zone")
def _(spark, sf):
    store = ly.LayerStore(spark, folder(spark))
    store.write_layers({"zone": view(spark, sf, "zone")})
    return store.read_layer("zone")


@query("write_layers", with_views("zone", "pts", "dem") + """ select 'zone' layer, count(*) n from zone union all select 'pts', count(*) from pts
    union all select 'dem', count(*) from dem""")
def _(spark, sf):
    return ly.LayerStore(spark, folder(spark)).write_layers({n: view(spark, sf, n) for n in ("zone", "pts", "dem")})


@query("write_csv", with_views("zone") + " select zid, grp, x0, y0 from zone")
def _(spark, sf):
    path = folder(spark)
    ly.write_csv(view(spark, sf, "zone").select("zid", "grp", "x0", "y0"), path)
    return spark.read.csv(path, header=True, schema="zid bigint, grp int, x0 double, y0 double")


@query("write_geojson", with_views("pts") + " select pid, k, round(x,6) x, round(y,6) y from pts")
def _(spark, sf):
    path = folder(spark)
    ly.write_geojson(view(spark, sf, "pts"), ly.point_geometry("x", "y"), ["pid", "k"], path)
    back = spark.read.schema("geometry struct<coordinates:array<double>>, properties struct<pid:bigint,k:int>").json(path)
    xy = F.col("geometry.coordinates")
    return back.select("properties.pid", "properties.k", F.round(xy[0], 6).alias("x"), F.round(xy[1], 6).alias("y"))


@query("export_attributes", with_views("zone") + " select zid, grp from zone")
def _(spark, sf):
    return ly.export_attributes(view(spark, sf, "zone"), folder(spark), ["x0", "y0", "x1", "y1"])


@query("cached_layer", with_views("pts") + " select seg, count(*) n from pts group by 1")
def _(spark, sf):
    store = ly.LayerStore(spark, folder(spark))
    build = lambda: view(spark, sf, "pts").groupBy("seg").agg(F.count("*").alias("n"))
    store.cached_layer("counts", build)
    return store.cached_layer("counts", lambda: None)


@query("read_patches", with_views("img") + """ select concat(scene,'_',r//10,'_',c//10) stem, cast(round(sum(cast(b1 as float)),4) as double) lr_sum,
    cast(round(sum(cast(b2 as float)),4) as double) hr_sum, count(*) n from img where scene is not null group by 1""")
def _(spark, sf):
    img = view(spark, sf, "img").withColumn("stem", F.concat_ws("_", "scene", F.floor(F.col("r") / 10), F.floor(F.col("c") / 10)))

    def files(band):
        packed = img.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("r", "c", F.col(band).alias("v")))).alias("p"),
            F.countDistinct("r").alias("h"), F.countDistinct("c").alias("w"))
        vals = F.transform("p", lambda s: s["v"].cast("float"))
        return packed.select("stem", ly.encode_patch(vals, F.col("h"), F.col("w")).alias("content"))

    path = folder(spark)
    for band in ("b1", "b2"):
        ly.write_patches(files(band), f"{path}/{band}").collect()
    pairs = ly.read_patches(spark, f"{path}/b1", f"{path}/b2")
    add = lambda c: F.round(F.aggregate(c, F.lit(0e0), lambda a, v: a + v.cast("double")), 4)
    return pairs.select("stem", add("lr").alias("lr_sum"), add("hr").alias("hr_sum"), F.size("lr").cast("bigint").alias("n"))


@query("resolve_columns", "select c_name nama, row_number() over(order by c_custkey) norec, 'Unknown' nomenklatu from customer")
def _(spark, sf):
    return ly.resolve_columns(table(spark, sf, "customer"), {
        "nama": ["name", "c_name"], "norec": ["block_id", "rec_no"], "nomenklatu": ["type", "classification"]},
        {"nomenklatu": "Unknown", "norec": ly.RUNNING}, ["c_custkey"])


@query("write_stats_json", with_views("img") + " select scene, count(*) n from img group by 1")
def _(spark, sf):
    path = folder(spark)
    ly.write_stats_json(view(spark, sf, "img").groupBy("scene").agg(F.count("*").alias("n")), path)
    return spark.read.schema("scene bigint, n bigint").json(path)


@query("create_table_as", "select s_suppkey, s_name nama_desa from supplier")
def _(spark, sf):
    return ly.create_table_as(table(spark, sf, "supplier"), ["s_suppkey", "s_name"], folder(spark)).withColumnRenamed("s_name", "nama_desa")


@query("create_view", "select n_nationkey, n_name from nation")
def _(spark, sf):
    ly.create_view(table(spark, sf, "nation"), "terraloom_nation")
    return spark.sql("select n_nationkey, n_name from terraloom_nation")


_SCENE = ", s as (select id, dt, ox x0, 0e0 y0, ox+1e0 x1, 1e0 y1, cast(id%100 as double) cloud from scenes_a)"


@query("filter_collection", with_views("scenes_a") + _SCENE + """ select id, dt, x0, cloud from s where dt>=date '1996-01-01' and dt<date '1997-01-01'
    and x0<=35e-2 and x1>=2e-1 and cloud<=60""")
def _(spark, sf):
    s = view(spark, sf, "scenes_a").selectExpr("id", "dt", "ox x0", "0e0 y0", "ox+1e0 x1", "1e0 y1", "cast(id%100 as double) cloud")
    return ly.filter_collection(s, (0.2, 0.0, 0.35, 1.0), "1996-01-01", "1997-01-01", 60).select("id", "dt", "x0", "cloud")


@query("flatten_properties", "select event_id, cast(json_extract_string(props,'$.k') as int) k from events")
def _(spark, sf):
    return ly.flatten_properties(table(spark, sf, "events").select("event_id", "props"), "props", "k int")


@query("pick_properties", "select c_custkey, c_name from customer")
def _(spark, sf):
    return ly.pick_properties(table(spark, sf, "customer"), ["c_custkey", "c_name"])


@query("flatten_collections", """select o_orderkey, 'price' field, o_totalprice "value" from orders union all select o_orderkey, 'customer', cast(o_custkey as double) from orders""")
def _(spark, sf):
    item = lambda n, c: F.struct(F.lit(n).alias("field"), F.col(c).cast("double").alias("value"))
    nested = table(spark, sf, "orders").select("o_orderkey", F.array(item("price", "o_totalprice"), item("customer", "o_custkey")).alias("features"))
    return ly.flatten_collections(nested, "features")


# --- filters and fields ------------------------------------------------------------------

@query("select_by_expression", "select * from customer where c_mktsegment='BUILDING' and c_nationkey<>7")
def _(spark, sf):
    return tb.select_by_expression(table(spark, sf, "customer"), "c_mktsegment = 'BUILDING' and c_nationkey != 7")


@query("field_calc", "select c_custkey, case when c_mktsegment='BUILDING' then '7' else c_mktsegment end zone, try_cast(case when c_mktsegment='BUILDING' then '7' else c_mktsegment end as int) zone_no from customer")
def _(spark, sf):
    df = tb.field_calc(table(spark, sf, "customer"), "zone", "case when c_mktsegment='BUILDING' then '7' else c_mktsegment end")
    return tb.field_calc(df, "zone_no", "zone", "int").select("c_custkey", "zone", "zone_no")


@query("lookup_column", "select c_custkey, n_name from customer left join nation on n_nationkey=c_nationkey")
def _(spark, sf):
    nat = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return tb.lookup_column(table(spark, sf, "customer"), nat, ["c_nationkey"], "n_name").select("c_custkey", "n_name")


@query("reclass", "select o_orderkey, cast(case when o_totalprice<=100000 then 1 when o_totalprice<=200000 then 2 else 3 end as int) cls from orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", sc.reclass(F.col("o_totalprice"), [100000, 200000], [1, 2, 3]).alias("cls"))


@query("remap", with_views("dem") + " select r, c, cast(case cls " + " ".join(f"when {a // 10} then {b}" for a, b in WORLD_COVER.items()) + " end as int) landcover from dem")
def _(spark, sf):
    return view(spark, sf, "dem").select("r", "c", sc.remap(F.col("cls"), [k // 10 for k in WORLD_COVER], list(WORLD_COVER.values())).alias("landcover"))


@query("classify_tier", "select o_orderkey, case when o_totalprice/6e5>=7e-1 then 'CRITICAL' when o_totalprice/6e5>=5e-1 then 'HIGH' when o_totalprice/6e5>=3e-1 then 'MEDIUM' else 'LOW' end tier from orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", sc.classify_tier(
        F.col("o_totalprice") / 6e5, [0.7, 0.5, 0.3], ["CRITICAL", "HIGH", "MEDIUM", "LOW"], inclusive=True).alias("tier"))


@query("raster_calc_mask", with_views("dem") + " select r, c, cast(z>=200e0 as int) m from dem")
def _(spark, sf):
    return view(spark, sf, "dem").select("r", "c", sc.raster_calc_mask(F.col("z"), 200.0).alias("m"))


@query("weighted_overlay", with_views("img") + f" select scene, r, c, round((0e0+b1*{d(0.5)}+b2*{d(0.3)}+b3*{d(0.2)})/{d(5 * 0.5 + 4 * 0.3 + 5 * 0.2)}*100e0,6) score from img")
def _(spark, sf):
    return view(spark, sf, "img").select("scene", "r", "c", F.round(
        sc.weighted_overlay({"b1": 0.5, "b2": 0.3, "b3": 0.2}, {"b1": 5, "b2": 4, "b3": 5}), 6).alias("score"))


@query("linear_score", with_views("img") + " select scene, r, c, 15e-1+b1*2e0+b2*-5e-1 score from img")
def _(spark, sf):
    return view(spark, sf, "img").select("scene", "r", "c", sc.linear_score({"b1": 2.0, "b2": -0.5}, 1.5).alias("score"))


@query("extract_date", with_views("scenes_a") + """, n as (select id, case when id%4=0 then name when id%4=1 then 'ps_'||strftime(dt,'%Y-%m-%d')||'_x' when id%4=2 then 'a_'||strftime(dt,'%Y_%m_%d') else 'scene'||id end name, dt from scenes_a)
    select id, case when id%4<3 then dt end dt from n""")
def _(spark, sf):
    n = view(spark, sf, "scenes_a").select("id", F.expr("""case when id%4=0 then name when id%4=1 then concat('ps_', date_format(dt,'yyyy-MM-dd'), '_x')
        when id%4=2 then concat('a_', date_format(dt,'yyyy_MM_dd')) else concat('scene', id) end""").alias("name"))
    return n.select("id", sc.extract_date(F.col("name")).alias("dt"))


@query("coerce_and_drop", """with a as (select o_orderkey k, case when o_orderkey%9=0 then 'bad' else strftime(o_orderdate,'%Y-%m-%d') end dt,
        case when o_orderkey%7=0 then 'x' else cast(o_custkey as varchar) end si, case when o_orderkey%5=0 then null else cast(o_custkey as varchar) end norec from orders)
    select k, try_cast(dt as date) dt, try_cast(si as double) si, cast(coalesce(try_cast(norec as double),0) as int) norec from a
    where try_cast(dt as date) is not null and try_cast(si as double) is not null""")
def _(spark, sf):
    a = table(spark, sf, "orders").selectExpr(
        "o_orderkey k", "case when o_orderkey%9=0 then 'bad' else date_format(o_orderdate,'yyyy-MM-dd') end dt",
        "case when o_orderkey%7=0 then 'x' else cast(o_custkey as string) end si", "case when o_orderkey%5=0 then null else cast(o_custkey as string) end norec")
    return tb.coerce_and_drop(a, ["dt"], ["si"], "norec")


@query("density", "select s_suppkey, round(1e6*s_suppkey/(s_acctbal+2e3),6) density from supplier")
def _(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.round(sc.density(F.col("s_suppkey"), F.col("s_acctbal") + 2e3), 6).alias("density"))


@query("target_grid", with_views("img") + """ select scene, 0e0 x0, 1e1/3 dx, -1e1/3 dy, cast((max(c)+1)*3 as bigint) width, cast((max(r)+1)*3 as bigint) height from img group by 1""")
def _(spark, sf):
    s = view(spark, sf, "img").groupBy("scene").agg((F.max("c") + 1).alias("width"), (F.max("r") + 1).alias("height"))
    return sc.target_grid(s.withColumns({"x0": F.lit(0e0), "dx": F.lit(1e1), "dy": F.lit(-1e1)}), 3)


@query("pick_band_file", """with f as (select l_orderkey scene, concat('T',l_orderkey,'_B0',l_linenumber, case when l_linenumber%2=0 then '_10m.tif' else '.tif' end) name from lineitem),
    k as (select *, case when contains(name,'_B02_10m') then 0 when contains(name,'_B02') then 1 when contains(name,'_B04') then 2 end p from f)
    select scene, arg_min(name,row(p,name)) name, cast(min(p) as int) priority from k where p is not null group by 1""")
def _(spark, sf):
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("scene"), F.concat(
        F.lit("T"), "l_orderkey", F.lit("_B0"), "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, "_10m.tif").otherwise(".tif")).alias("name"))
    return jn.pick_band_file(f, ["_B02_10m", "_B02", "_B04"])


@query("select_bands", with_views("img") + """ select scene, r, c, 'blue' band, b1 "value" from img union all select scene, r, c, 'red', b3 from img""")
def _(spark, sf):
    long = view(spark, sf, "img").unpivot(["scene", "r", "c"], ["b1", "b2", "b3"], "band", "value").replace({"b1": "B02", "b2": "B99", "b3": "B04"}, subset=["band"])
    return sc.select_bands(long, {k: v for k, v in S2_TO_FOUR_BAND.items() if k in ("B02", "B04")})


@query("select_six_of_eight", with_views("img") + " union all ".join(
    (" " if i == 0 else "") + f"select scene, r, c, '{b}' band, b{1 + EIGHT_BANDS.index(b) % 4} \"value\" from img" for i, b in enumerate(SIX_OF_EIGHT)))
def _(spark, sf):
    eight = view(spark, sf, "img").select("scene", "r", "c", *[F.col(f"b{1 + i % 4}").alias(str(i)) for i in range(8)])
    long = eight.unpivot(["scene", "r", "c"], [str(i) for i in range(8)], "band", "value")
    return sc.select_bands(long, {str(i): b for i, b in sc.numbered_bands(EIGHT_BANDS, SIX_OF_EIGHT).items()})


@query("rename_bands_across_sensors", with_views("px") + """ select 's2' sensor, r, c, blue, green, red, nir, swir1, swir2 from px
    union all select 'l9', r, c, blue, green, red, nir, swir1, swir2 from px union all select 'l7', r, c, blue, green, red, nir, swir1, swir2 from px""")
def _(spark, sf):
    px = view(spark, sf, "px").drop("cls")
    out = []
    for sensor, names in (("s2", S2_SIX), ("l9", LANDSAT_8_9), ("l7", LANDSAT_5_7)):
        own = px.select(F.lit(sensor).alias("sensor"), "r", "c", *[F.col(b).alias(a) for a, b in names.items()])
        out.append(sc.rename_bands(own, names))
    return tb.merge_collections(*out)


# --- joins -----------------------------------------------------------------------------

@query("left_join_fill", """select c_custkey, c_name, coalesce(n,0) n from customer left join (select o_custkey c_custkey, count(*) n from orders where o_orderstatus='P' group by 1) using(c_custkey)""")
def _(spark, sf):
    n = table(spark, sf, "orders").where("o_orderstatus='P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return jn.left_join_fill(table(spark, sf, "customer").select("c_custkey", "c_name"), n, ["c_custkey"], 0)


@query("join_series_with_dates", with_views("block_daily", "block_dates") + """ select norec, d, et0, start_doy from block_daily a
    full join (select cast(norec+5 as int) norec, start_doy from block_dates) b using(norec)""")
def _(spark, sf):
    dates = view(spark, sf, "block_dates").selectExpr("cast(norec + 5 as int) norec", "start_doy")  # some keys have no partner
    return jn.join_series_with_dates(view(spark, sf, "block_daily"), dates).select("norec", "d", "et0", "start_doy")


@query("inner_join_suffixed", with_views("block_daily") + """ select a.norec, a.dt, a.nama nama_x, b.nama nama_y, a.et0, b.eta from block_daily a
    join (select norec, dt, min(nama) nama, min(eta) eta from block_daily group by 1, 2) b on a.norec=b.norec and a.dt=b.dt""")
def _(spark, sf):
    b = view(spark, sf, "block_daily")
    return jn.inner_join_suffixed(b.select("norec", "dt", "nama", "et0"), b.select("norec", "dt", "nama", "eta"), ["norec", "dt"])


@query("first_match_join", """with f as (select l_orderkey, arg_min(row(l_suppkey, l_quantity), row(l_linenumber, l_suppkey, l_quantity, l_partkey)) m from lineitem group by 1)
    select o_orderkey l_orderkey, o_custkey, m[1] l_suppkey, m[2] l_quantity from orders join f on l_orderkey=o_orderkey""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_linenumber", "l_partkey")
    return jn.first_match_join(o, li, ["l_orderkey"], ["l_linenumber", "l_suppkey", "l_quantity", "l_partkey"]).select("l_orderkey", "o_custkey", "l_suppkey", "l_quantity")


@query("tolerance_join", with_views("px_ts") + """, cl as (select cast(ts as date) s, cast(ts as date)+1 e, count(*) n from events group by 1,2)
    select pix, dt, cl.s on_day, n from px_ts join cl on abs(datediff('day',e,dt))<=1 or abs(datediff('day',s,dt))<=1""")
def _(spark, sf):
    im = view(spark, sf, "px_ts").select("pix", "dt")
    cl = table(spark, sf, "events").groupBy(F.to_date("ts").alias("s")).agg(F.count("*").alias("n")).withColumn("e", F.date_add("s", 1))
    hit = jn.tolerance_join(im, cl, 1, (), ("dt", "dt"), ("s", "e"))
    return hit.select("pix", "dt", F.col("r.s").alias("on_day"), F.col("r.n").alias("n"))


_NEAR = """, la as (select id, case when id%11=0 then null else dt end dt, cast(tile as double)*2+ox x0, cast(tile as double)*2+ox+1e0 x1 from scenes_a),
    rb as (select id*10+part id, case when part=7 then null else dt end dt, cast(tile as double)*2+ox x0, cast(tile as double)*2+ox+1e0 x1 from scenes_b),
    rb1 as (select id, dt, x0, x1 from rb),
    pr as (select la.id, rb1.id rid, case when la.dt is not null and rb1.dt is not null then abs(datediff('day',la.dt,rb1.dt)) end dd, la.dt ld, rb1.dt rd
        from la join rb1 on floor(la.x0)<=floor(rb1.x1) and floor(rb1.x0)<=floor(la.x1) and floor(la.x0/4) between floor(rb1.x0/4)-1 and floor(rb1.x0/4)+1
        and least(la.x1,rb1.x1)-greatest(la.x0,rb1.x0) > 0 and (least(la.x1,rb1.x1)-greatest(la.x0,rb1.x0))*1e0/(la.x1-la.x0)>=5e-1),
    dd as (select id, min(row(dd,rid)) m from pr where dd<=30 group by 1),
    uu as (select id, min(rid) rid from pr where ld is null or rd is null group by 1)
    select la.id, dt, coalesce(m[2],uu.rid) match_id, cast(m[1] as int) "days" from la left join dd using(id) left join uu using(id)"""


@query("nearest_scene", with_views("scenes_a", "scenes_b") + _NEAR)
def _(spark, sf):
    a = view(spark, sf, "scenes_a").selectExpr(
        "id", "case when id%11=0 then null else dt end dt", "cast(tile as double)*2+ox x0", "0e0 y0", "cast(tile as double)*2+ox+1e0 x1", "1e0 y1")
    b = view(spark, sf, "scenes_b").selectExpr(
        "id*10+part id", "id*10+part ord", "case when part=7 then null else dt end dt", "cast(tile as double)*2+ox x0", "0e0 y0", "cast(tile as double)*2+ox+1e0 x1", "1e0 y1")
    return jn.nearest_scene(a, b, 30).select("id", "dt", "match_id", "days")


@query("tiered_pairs_by_date", with_views("scenes_a", "scenes_b") + """, a as (select dt, max(name) left_name from scenes_a group by 1),
    b as (select dt, max(concat('PS_',id,'_',part)) right_name from scenes_b group by 1) select left_name, right_name, 'date' rule from a join b using(dt)""")
def _(spark, sf):
    a = view(spark, sf, "scenes_a").select("name", F.col("name").alias("stem"), "dt")
    b = view(spark, sf, "scenes_b").select(F.concat(F.lit("PS_"), "id", F.lit("_"), "part").alias("name"), "dt").withColumn("stem", F.col("name"))
    return jn.tiered_pairs(a, b)


@query("tiered_pairs_by_position", """with a as (select s_name left_name, row_number() over(order by s_name) i from supplier), b as (select p_name||p_partkey right_name, row_number() over(order by p_name||p_partkey) i from part)
    select left_name, right_name, 'position' rule from a join b using(i)""")
def _(spark, sf):
    none = F.lit(None).cast("date").alias("dt")
    a = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("a"), "s_suppkey").alias("stem"), none)
    b = table(spark, sf, "part").select(F.concat("p_name", "p_partkey").alias("name"), F.concat(F.lit("b"), "p_partkey").alias("stem"), none)
    return jn.tiered_pairs(a, b)


@query("stem_pairs", """select cast(o_orderkey as varchar) stem, concat('lr/',o_orderkey) left_name, max(concat('hr/',l_orderkey)) right_name from orders join lineitem on l_orderkey=o_orderkey group by 1,2""")
def _(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("stem"), F.concat(F.lit("lr/"), "o_orderkey").alias("name"))
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("stem"), F.concat(F.lit("hr/"), "l_orderkey").alias("name"))
    return jn.stem_pairs(a, b)


@query("pair_by_rule", "select o_orderkey, o_custkey, c_name from orders join customer on o_custkey=c_custkey")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    c = table(spark, sf, "customer").select("c_name", F.col("c_custkey").alias("k"))
    p = jn.pair_by(o, c, lambda a, b: a == b, "k")
    return p.select("left.o_orderkey", F.col("left.k").alias("o_custkey"), "right.c_name")


@query("orders_due", """select o_orderkey "order", cast(o_orderdate as date) due, c_name customer_name from orders join customer on c_custkey=o_custkey
    where cast(o_orderdate as date) between date '1997-03-01' and date '1997-03-03'""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order"), F.to_date("o_orderdate").alias("due"), F.col("o_custkey").alias("customer"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_name").alias("customer_name"))
    return tb.orders_due(o, c, "1997-03-01").select("order", "due", "customer_name")


@query("quantity_per_flavour", """select p_partkey flavour, p_name flavour_name, sum(l_quantity) quantity from lineitem join orders on l_orderkey=o_orderkey join customer on c_custkey=o_custkey
    join part on p_partkey=l_partkey where c_mktsegment='BUILDING' and o_orderstatus='P' group by 1,2""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("segment"))
    i = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_partkey").alias("flavour"), F.col("l_quantity").alias("quantity"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("flavour"), F.col("p_name").alias("flavour_name"))
    return tb.quantity_per_flavour(o, i, p, c, "segment = 'BUILDING' and status = 'P'")


@query("semi_join", "select c_custkey from customer where exists(select 1 from orders where o_custkey=c_custkey and o_orderpriority='1-URGENT')")
def _(spark, sf):
    o = table(spark, sf, "orders").where("o_orderpriority='1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("anti_join", "select c_custkey from customer where not exists(select 1 from orders where o_custkey=c_custkey and o_orderpriority='1-URGENT')")
def _(spark, sf):
    o = table(spark, sf, "orders").where("o_orderpriority='1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("bbox_overlap_fraction", with_views("scenes_a", "scenes_b") + """ select a.id, b.id bid, b.part, b.ox, round(greatest(least(a.ox+1e0,b.ox+1e0)-greatest(a.ox,b.ox),0e0)*1e0/(b.ox+1e0-b.ox),6) f
    from scenes_a a join scenes_b b on a.id=b.id""")
def _(spark, sf):
    a = view(spark, sf, "scenes_a").selectExpr("id", "ox ax0", "0e0 ay0", "ox+1e0 ax1", "1e0 ay1")
    b = view(spark, sf, "scenes_b").selectExpr("id", "id bid", "part", "ox", "ox bx0", "0e0 by0", "ox+1e0 bx1", "1e0 by1")
    f = jn.bbox_overlap_fraction(["ax0", "ay0", "ax1", "ay1"], ["bx0", "by0", "bx1", "by1"])
    return a.join(b, "id").select("id", "bid", "part", "ox", F.round(f, 6).alias("f"))


@query("add_static_layers", with_views("img", "dem") + f""" select scene, img.r, img.c, b1, z, cls, cast(cls as double)*1e-1 temp from img left join dem on img.r=dem.r and img.c=dem.c""")
def _(spark, sf):
    dem = view(spark, sf, "dem")
    clim = dem.select("r", "c", (F.col("cls").cast("double") * 0.1).alias("temp"))
    return jn.add_static_layers(view(spark, sf, "img").select("scene", "r", "c", "b1"), {"terrain": dem.select("r", "c", "z", "cls"), "climate": clim})


# --- order, sample, sets -------------------------------------------------------------------

@query("order_by", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey")
def _(spark, sf):
    return tb.order_by(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", False), ("o_orderkey", True)])


@query("limit_features", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 1000")
def _(spark, sf):
    return tb.limit_features(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 1000, [F.desc("o_totalprice"), "o_orderkey"])


_U = "cast(('0x'||substr(md5('{s}|'||cast(o_orderkey as varchar)),1,12)) as bigint)/cast(281474976710656 as double)"


@query("random_column", f"select o_orderkey, {_U.format(s=42)} u from orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", tb.random_column(["o_orderkey"], 42).alias("u"))


@query("sample", f"select o_orderkey from orders where {_U.format(s=7)} < 2e-1")
def _(spark, sf):
    return tb.sample(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 0.2, 7)


@query("split", f"""with u as (select o_orderkey, row_number() over(order by {_U.format(s=42)}, o_orderkey) i, count(*) over() n from orders)
    select o_orderkey, case when i<=n-floor(n*{d(0.1)})-floor(n*{d(0.15)}) then 'train' when i<=n-floor(n*{d(0.15)}) then 'val' else 'test' end split from u""")
def _(spark, sf):
    return tb.split(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 0.1, 0.15, 42)


@query("merge_collections", "select c_custkey id, c_acctbal v from customer union all select s_suppkey, s_acctbal from supplier")
def _(spark, sf):
    return tb.merge_collections(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v")),
        table(spark, sf, "supplier").select(F.col("s_acctbal").alias("v"), F.col("s_suppkey").alias("id")))


@query("key_difference", "select c_nationkey k from customer except select s_nationkey from supplier where s_acctbal>5000")
def _(spark, sf):
    return tb.key_difference(table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("key_intersection", "select o_custkey k from orders intersect select l_suppkey from lineitem")
def _(spark, sf):
    return tb.key_intersection(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf, "lineitem").select("l_suppkey"))


@query("array_sets", with_views("occ") + ", " + hexed("occ") + """, a as (select q, r, coalesce(list(distinct species) filter(yr<=1997),[]) s, coalesce(list(distinct species) filter(yr>1997),[]) p from occ_c group by 1,2)
    select q, r, cast(len(list_filter(s, lambda x: not list_contains(p,x))) as int) only_s, cast(len(list_intersect(s,p)) as int) common, cast(len(list_distinct(list_concat(s,p))) as int) either from a""")
def _(spark, sf):
    # early and late species sets per cell: bounded by the species list
    small = species_years(assign_cell(view(spark, sf, "occ"), "x", "y", SIZE))
    a = small.groupBy("q", "r").agg(
        F.collect_set(F.when(F.col("yr") <= 1997, F.col("species"))).alias("s"),
        F.collect_set(F.when(F.col("yr") > 1997, F.col("species"))).alias("p"))
    return a.select("q", "r", F.size(F.array_except("s", "p")).alias("only_s"), F.size(F.array_intersect("s", "p")).alias("common"), F.size(F.array_union("s", "p")).alias("either"))


@query("first_per_group", "select o_custkey, arg_min(o_orderkey,row(o_orderdate,o_orderkey)) o_orderkey, min(o_orderdate) o_orderdate from orders group by 1")
def _(spark, sf):
    return tb.first_per_group(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("renumber", 'select o_orderkey, row_number() over(order by o_orderdate, o_orderkey) "No" from orders')
def _(spark, sf):
    return tb.renumber(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "No")


@query("categorize", "select p_partkey, p_type, cast(dense_rank() over(order by p_type) as int) class_id from part")
def _(spark, sf):
    return tb.categorize(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type")


@query("ordered_labels", "select o_orderkey, cast(case o_orderstatus when 'O' then 1 when 'P' then 2 else 0 end as int) n from orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", tb.ordered_labels(F.col("o_orderstatus"), ["O", "P"]).alias("n"))
