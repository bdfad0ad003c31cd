"""Vector, network, class-break and model queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from terraloom.functions import geometry as geo
from terraloom.functions.hexgrid import assign_cell, cell_boundary
from terraloom.functions.scalars import project_utm, to_srid
from terraloom.operators import classify as cl, hexgraph as hg, models as md, network as nw, occurrence as oc, spatial as sp, tables as tb
from terraloom.plans.ecology import K1
from terraloom.plans.imagery import rd
from terraloom.plans.registry import query
from terraloom.plans.sqltext import d, disk, grid, occ_cells
from terraloom.scale import materialize, shuffled
from terraloom.sources.fixtures import table, view, with_views


def zone(spark, sf):
    z = view(spark, sf, "zone")
    ring = geo.box_ring(*[F.col(c) for c in sp.BOX])
    return z.withColumn("edges", geo.ring_edges(ring))


def lines(spark, sf):
    ln = view(spark, sf, "lines")
    return sp.as_shape(ln.select("lid", "seg", F.array(geo.edge(*[F.col(c) for c in sp.BOX])).alias("e")), F.col("e")).drop("e")


def as_points(df, x="x", y="y"):
    return sp.as_shape(df, F.array(geo.edge(F.col(x), F.col(y), F.col(x), F.col(y))))


# --- points, lines and zones ----------------------------------------------------------------

_IN = "p.x>=z.x0 and p.x<z.x1 and p.y>=z.y0 and p.y<z.y1"


@query("points_in_polygons", with_views("pts", "zone") + f" select p.pid, z.zid from pts p join zone z on {_IN}")
def _(spark, sf):
    return sp.points_in_polygons(view(spark, sf, "pts").select("pid", "x", "y"), zone(spark, sf).select("zid", "edges", *sp.BOX)).select("pid", "zid")


@query("count_points_in_polygons", with_views("pts", "zone") + f" select z.zid, count(p.pid) n, count(distinct p.seg) n_unique from zone z left join pts p on {_IN} group by 1")
def _(spark, sf):
    return sp.count_points_in_polygons(view(spark, sf, "pts"), zone(spark, sf), "zid", "seg")


@query("zonal_stats", with_views("pts", "zone") + f' select z.zid, count(*) n, sum(floor(w)) "sum", avg(floor(w)) mean, min(floor(w)) "min", max(floor(w)) "max" from zone z join pts p on {_IN} group by 1')
def _(spark, sf):
    pts = view(spark, sf, "pts").withColumn("w", F.floor("w").cast("double"))
    return sp.zonal_stats(pts, zone(spark, sf), "zid", "w")


@query("polygon_area_centroid", with_views("zone") + " select zid, (x1-x0)*(y1-y0) area, round((x0+x1)/2,6) cx, round((y0+y1)/2,6) cy from zone")
def _(spark, sf):
    z = zone(spark, sf)
    cx, cy = geo.centroid(F.col("edges"))
    return rd(z.select("zid", geo.polygon_area(F.col("edges")).alias("area"), cx.alias("cx"), cy.alias("cy")), ["cx", "cy"])


@query("buffer_bbox", with_views("zone") + " select zid, x0-5e-1 x0, y0-5e-1 y0, x1+5e-1 x1, y1+5e-1 y1 from zone")
def _(spark, sf):
    return zone(spark, sf).select("zid", *geo.buffer_bbox(sp.BOX, 0.5))


@query("layer_extent", with_views("pts") + " select min(x) x0, min(y) y0, max(x) x1, max(y) y1 from pts")
def _(spark, sf):
    return sp.layer_extent(view(spark, sf, "pts")).drop("ring")


@query("within_distance_points", with_views("pts", "sites") + f" select s.sid a, p.pid b from sites s join pts p on (s.x-p.x)*(s.x-p.x)+(s.y-p.y)*(s.y-p.y)<={d(0.7)}*{d(0.7)}")
def _(spark, sf):
    return sp.within_distance(as_points(view(spark, sf, "sites")), as_points(view(spark, sf, "pts")), "sid", "pid", 0.7)


_PSD2 = """pow(l.x0+least(greatest(coalesce(((p.x-l.x0)*(l.x1-l.x0)+(p.y-l.y0)*(l.y1-l.y0))/nullif((l.x1-l.x0)*(l.x1-l.x0)+(l.y1-l.y0)*(l.y1-l.y0),0),0e0),0e0),1e0)*(l.x1-l.x0)-p.x,2)
    +pow(l.y0+least(greatest(coalesce(((p.x-l.x0)*(l.x1-l.x0)+(p.y-l.y0)*(l.y1-l.y0))/nullif((l.x1-l.x0)*(l.x1-l.x0)+(l.y1-l.y0)*(l.y1-l.y0),0),0e0),0e0),1e0)*(l.y1-l.y0)-p.y,2)"""


@query("within_distance_of_lines", with_views("pts", "lines") + f" select l.lid a, p.pid b from lines l join pts p on {_PSD2}<={d(0.05)}*{d(0.05)}")
def _(spark, sf):
    return sp.within_distance(lines(spark, sf), as_points(view(spark, sf, "pts")), "lid", "pid", 0.05)


@query("count_within", with_views("pts", "sites") + " select s.sid, count(p.pid) n_within from sites s left join pts p on (s.x-p.x)*(s.x-p.x)+(s.y-p.y)*(s.y-p.y)<=9e-1*9e-1 group by 1")
def _(spark, sf):
    return sp.count_within(view(spark, sf, "sites").select("sid", "x", "y"), view(spark, sf, "pts"), 0.9).select("sid", "n_within")


@query("nearest_point", with_views("pts", "sites") + """, dd as (select pid, sid, (s.x-p.x)*(s.x-p.x)+(s.y-p.y)*(s.y-p.y) d2 from pts p cross join sites s)
    select pid, arg_min(sid, row(d2,sid)) near_id, round(sqrt(min(d2)),6) near_dist from dd group by 1""")
def _(spark, sf):
    p = sp.point_box(view(spark, sf, "pts").select("pid", "x", "y"))
    s = sp.point_box(view(spark, sf, "sites").select("sid", "x", "y"))
    return rd(sp.nearest(p, s, "sid").select("pid", "near_id", "near_dist"), ["near_dist"])


@query("nearest_line", with_views("sites", "lines") + f""", dd as (select p.sid, l.lid, {_PSD2} d2 from sites p cross join lines l)
    select sid, round(sqrt(min(d2)),6) near_dist from dd group by 1""")
def _(spark, sf):
    p = sp.point_box(view(spark, sf, "sites").select("sid", "x", "y"))
    return rd(sp.nearest(p, view(spark, sf, "lines"), "lid").select("sid", "near_dist"), ["near_dist"])


_ODD = ", a as (select * from zone where grp=0), b as (select * from zone where grp=3)"


@query("nearest_polygon", with_views("zone") + _ODD + """, dd as (select a.zid, b.zid bid, pow(greatest(a.x0-b.x1,b.x0-a.x1,0),2)+pow(greatest(a.y0-b.y1,b.y0-a.y1,0),2) d2 from a cross join b)
    select zid, arg_min(bid, row(d2,bid)) near_id, round(sqrt(min(d2)),6) near_dist from dd group by 1""")
def _(spark, sf):
    z = zone(spark, sf)
    return rd(sp.nearest_shapes(z.where("grp = 0"), z.where("grp = 3"), "zid", "zid"), ["near_dist"])


HEX = occ_cells(0.5)


def sat(size: float) -> str:
    """Separating axes: does the hexagon (q, r) meet the box (x0, y0, x1, y1)?"""
    h = 0.8660254037844386
    cx, cy = f"((q+r/2e0)*{d(size * 2 * h)}-(x0+x1)/2)", f"(r*{d(size * 1.5)}-(y0+y1)/2)"
    bw, bh = "(x1-x0)/2", "(y1-y0)/2"
    return (f"abs({cx})<={d(size * h)}+{bw} and abs({cy})<={d(size)}+{bh} "
            f"and abs({cx}*5e-1+{cy}*{d(h)})<={d(size * h)}+{bw}*5e-1+{bh}*{d(h)} "
            f"and abs({cx}*5e-1-{cy}*{d(h)})<={d(size * h)}+{bw}*5e-1+{bh}*{d(h)}")


def hexes(spark, sf, size=0.5):
    o = assign_cell(view(spark, sf, "occ"), "x", "y", size)
    return o, hg.build_grid(o)


@query("build_grid_in_aoi", HEX + grid() + f""", {with_views('zone')[len('with recursive '):]} select distinct q, r from grid join (select * from zone where grp<3) on {sat(0.5)}""")
def _(spark, sf):
    _, g = hexes(spark, sf)
    cells = sp.as_shape(g.withColumn("cell", F.struct("q", "r")), geo.ring_edges(cell_boundary(0.5)))
    pairs = sp.shape_pairs(cells, zone(spark, sf).where("grp < 3"), "cell", "zid", geo.polygons_intersect)
    return pairs.select("a.q", "a.r").distinct()


_LZ = with_views("lines", "zone") + """, lz as (select l.*, z.zid, z.x0 zx0, z.y0 zy0, z.x1 zx1, z.y1 zy1 from lines l join zone z on least(l.x0,l.x1)<=z.x1 and greatest(l.x0,l.x1)>=z.x0 and least(l.y0,l.y1)<=z.y1 and greatest(l.y0,l.y1)>=z.y0)"""
# a segment meets a box unless the box corners all lie strictly on one side (boxes already meet)
_CORNERS = [f"((x1-x0)*(zy{j}-y0)-(y1-y0)*(zx{i}-x0))" for i in (0, 1) for j in (0, 1)]
_MEETS = f"not (least({','.join(_CORNERS)})>1e-9 or greatest({','.join(_CORNERS)})<-1e-9)"


@query("lines_intersect_polygons", _LZ + f" select lid a, zid b from lz where {_MEETS}")
def _(spark, sf):
    return sp.shape_pairs(lines(spark, sf), zone(spark, sf), "lid", "zid", geo.line_meets_polygon)


@query("lines_within_polygons", _LZ + " select lid a, zid b from lz where least(x0,x1)>zx0 and greatest(x0,x1)<zx1 and least(y0,y1)>zy0 and greatest(y0,y1)<zy1")
def _(spark, sf):
    return sp.shape_pairs(lines(spark, sf), zone(spark, sf), "lid", "zid", geo.within)


def _sd(a: str, b: str, px: str, py: str) -> str:
    v = f"(({a}.x1-{a}.x0)*({b}.{py}-{a}.y0)-({a}.y1-{a}.y0)*({b}.{px}-{a}.x0))"
    return f"(case when abs({v})<=1e-9 then 0 else {v} end)"


@query("lines_cross", with_views("lines") + f""" select a.lid a, b.lid b from lines a join lines b on a.lid<b.lid and least(a.x0,a.x1)<=greatest(b.x0,b.x1) and least(b.x0,b.x1)<=greatest(a.x0,a.x1)
    and least(a.y0,a.y1)<=greatest(b.y0,b.y1) and least(b.y0,b.y1)<=greatest(a.y0,a.y1)
    where {_sd('a', 'b', 'x0', 'y0')}*{_sd('a', 'b', 'x1', 'y1')}<0 and {_sd('b', 'a', 'x0', 'y0')}*{_sd('b', 'a', 'x1', 'y1')}<0""")
def _(spark, sf):
    ln = lines(spark, sf)
    return sp.segment_pairs(ln, ln, "lid", "lid", geo.segments_cross, ordered=True)


@query("lines_connected", with_views("pts") + """, s as (select a.pid lid, round(a.x,2) x0, round(a.y,2) y0, round(b.x,2) x1, round(b.y,2) y1 from pts a join pts b on b.pid=a.pid+1)
    select a.lid a, b.lid b from s a join s b on a.lid<b.lid and ((a.x0=b.x0 and a.y0=b.y0) or (a.x0=b.x1 and a.y0=b.y1) or (a.x1=b.x0 and a.y1=b.y0) or (a.x1=b.x1 and a.y1=b.y1))""")
def _(spark, sf):
    p = view(spark, sf, "pts").select("pid", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))
    nxt = p.select((F.col("pid") - 1).alias("pid"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    s = p.join(shuffled(nxt), "pid").select("pid", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("nx").alias("x1"), F.col("ny").alias("y1"))
    return sp.connected_lines(s, "pid")


@query("polygons_touch", with_views("zone") + """ select a.zid a, b.zid b from zone a join zone b on a.zid<b.zid and a.x0<=b.x1 and b.x0<=a.x1 and a.y0<=b.y1 and b.y0<=a.y1""")
def _(spark, sf):
    z = zone(spark, sf)
    return sp.shape_pairs(z, z, "zid", "zid", geo.polygons_touch, ordered=True)


@query("touches_named_zone", with_views("zone") + """, n as (select * from zone where zid=(select s_suppkey from supplier where s_name='Supplier#000000004'))
    select b.zid from n a join zone b on a.zid<>b.zid and a.x0<=b.x1 and b.x0<=a.x1 and a.y0<=b.y1 and b.y0<=a.y1""")
def _(spark, sf):
    z = zone(spark, sf)
    named = table(spark, sf, "supplier").where("s_name = 'Supplier#000000004'").select("s_suppkey")
    one = z.where(F.col("zid") == named.scalar())
    return sp.shape_pairs(one, z, "zid", "zid", geo.polygons_touch).select(F.col("b").alias("zid"))


@query("polygons_within", with_views("zone") + """, big as (select zid, x0-25e-2 x0, y0-25e-2 y0, x1+25e-2 x1, y1+25e-2 y1 from zone)
    select a.zid a, b.zid b from zone a join big b on a.x0>b.x0 and a.x1<b.x1 and a.y0>b.y0 and a.y1<b.y1""")
def _(spark, sf):
    z = zone(spark, sf)
    grown = z.select("zid", *geo.buffer_bbox(sp.BOX, 0.25))
    grown = grown.withColumn("edges", geo.ring_edges(geo.box_ring(*[F.col(c) for c in sp.BOX])))
    return sp.shape_pairs(z, grown, "zid", "zid", geo.within)


@query("dissolve", with_views("zone") + """, e as (select grp, x0, y0, x1, y0 y1 from zone union all select grp, x0, y1, x1, y1 from zone union all select grp, x0, y0, x0, y1 from zone union all select grp, x1, y0, x1, y1 from zone)
    select grp, x0, y0, x1, y1 from e group by all having count(*)=1""")
def _(spark, sf):
    return sp.cancel_shared(zone(spark, sf), "grp")


@query("dissolve_bricks", with_views("zone") + """, brick as (select grp, cast(zid % 8 * 2 + zid // 8 % 2 as double) x, cast(zid // 8 as double) y from zone),
    unit as (select grp, x + i x, y + j y, 'h' d from brick, range(2) a(i), range(2) b(j) union all select grp, x + i * 2, y, 'v' from brick, range(2) a(i)),
    line as (select grp, x, y, d from unit group by all having count(*) = 1)
    select grp, count(*) / 1e0 "length", any_value(n) * 2e0 area from line join (select grp, count(*) n from brick group by 1) using (grp) group by 1""")
def _(spark, sf):
    row = F.expr("zid div 8")
    b = view(spark, sf, "zone").select("grp", (F.col("zid") % 8 * 2 + row % 2).cast("double").alias("x0"), row.cast("double").alias("y0"))
    b = b.withColumns({"x1": F.col("x0") + 2, "y1": F.col("y0") + 1}).withColumn("edges", geo.ring_edges(geo.box_ring(*[F.col(c) for c in sp.BOX])))
    out = sp.dissolve(b, "grp")
    length = out.groupBy("grp").agg(F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("length"))
    return length.join(sp.outline_rings(out, "grp"), "grp").select("grp", "length", geo.rings_area(F.col("rings")).alias("area"))


@query("rasterize", with_views("zone") + """, px as (select cast(a.range as bigint) r, cast(b.range as bigint) c from range((select cast(max(y1)*5 as bigint) from zone)) a cross join range(50) b)
    select r, c, arg_min(grp, zid) "value" from px join (select zid, grp, x0, y0, x1+5e-1 x1, y1+5e-1 y1 from zone) z on (c+5e-1)*2e-1>=x0 and (c+5e-1)*2e-1<x1 and (r+5e-1)*2e-1>=y0 and (r+5e-1)*2e-1<y1 group by 1,2""")
def _(spark, sf):
    z = view(spark, sf, "zone").withColumns({"x1": F.col("x1") + 0.5, "y1": F.col("y1") + 0.5})
    z = z.withColumn("edges", geo.ring_edges(geo.box_ring(*[F.col(c) for c in sp.BOX])))
    top = z.agg(F.max("y1") - 0.5).first()[0]
    return sp.rasterize(z, F.col("grp"), F.col("zid"), 0.2, (0.0, 0.0, 9.999, top - 1e-3))


@query("rasterize_points", with_views("pts") + ' select cast(floor(y/5e-1) as bigint) r, cast(floor(x/5e-1) as bigint) c, arg_min(k,pid) "value" from pts group by 1,2')
def _(spark, sf):
    return sp.rasterize_points(view(spark, sf, "pts"), F.col("k"), F.col("pid"), 0.5)


@query("proximity", with_views("dem") + """, t as (select r tr, c tc from dem where cls=3 and z>45e1)
    select r, c, round(sqrt(min((r-tr)*(r-tr)+(c-tc)*(c-tc))),6) distance from dem cross join t group by 1,2""")
def _(spark, sf):
    dem = view(spark, sf, "dem")
    return rd(sp.proximity(dem, (F.col("cls") == 3) & (F.col("z") > 450.0)), ["distance"])


_HEAT = with_views("pts") + """, px as (select cast(a.range as bigint)-4 r, cast(b.range as bigint)-4 c from range((select cast(max(y)*4 as bigint)+9 from pts)) a cross join range(49) b),
    u as (select r, c, w, sqrt(pow((c+5e-1)*25e-2-x,2)+pow((r+5e-1)*25e-2-y,2))/8e-1 u from px join pts on abs((c+5e-1)*25e-2-x)<=8e-1 and abs((r+5e-1)*25e-2-y)<=8e-1)"""


@query("heatmap", _HEAT + " select r, c, round(sum(w*pow(1-u*u,2)),4) density from u where u<=1 group by 1,2")
def _(spark, sf):
    return rd(sp.heatmap(view(spark, sf, "pts"), 0.8, 0.25, "quartic", F.col("w")), ["density"], 4)


@query("heatmap_kernels", _HEAT + " select r, c, round(sum(1-u),6) triangular, round(sum(pow(1-u*u,3)),6) triweight, round(sum(1-u*u),6) epanechnikov from u where u<=1 group by 1,2")
def _(spark, sf):
    kernels = ["triangular", "triweight", "epanechnikov"]
    return rd(sp.heatmap(view(spark, sf, "pts"), 0.8, 0.25, kernels), kernels)


@query("point_density", _HEAT + " select r, c, round(count(*)/(pi()*8e-1*8e-1),6) density from u where u<=1 group by 1,2")
def _(spark, sf):
    return rd(sp.point_density(view(spark, sf, "pts"), 0.8, 0.25), ["density"])


_E2 = 1 / 298.257223563 * (2 - 1 / 298.257223563)
_EP2 = _E2 / (1 - _E2)
_UTM = with_views("pts") + f""", p as (select pid, radians(-(y-10*trunc(y/10))) phi, radians(x+105-105e0) lam from pts),
    a as (select pid, phi, {d(6378137.0)}/sqrt(1-{d(_E2)}*pow(sin(phi),2)) n, pow(tan(phi),2) t, {d(_EP2)}*pow(cos(phi),2) c, cos(phi)*lam aa,
        {d(6378137.0)}*({d(1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256)}*phi-{d(3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024)}*sin(2*phi)
        +{d(15 * _E2**2 / 256 + 45 * _E2**3 / 1024)}*sin(4*phi)-{d(35 * _E2**3 / 3072)}*sin(6*phi)) m from p)
    select pid, round({d(0.9996)}*n*(aa+(1-t+c)*pow(aa,3)/6+(5-18*t+t*t+72*c-58*{d(_EP2)})*pow(aa,5)/120)+5e5,3) easting,
        round({d(0.9996)}*(m+n*tan(phi)*(pow(aa,2)/2+(5-t+9*c+4*c*c)*pow(aa,4)/24+(61-58*t+t*t+600*c-330*{d(_EP2)})*pow(aa,6)/720))+1e7,3) northing from a"""


@query("project_utm", _UTM)
def _(spark, sf):
    p = view(spark, sf, "pts").withColumns({"lon": F.col("x") + 105, "lat": -F.col("y") % 10})
    e, n = project_utm(F.col("lon"), F.col("lat"), 48, south=True)
    return p.select("pid", F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


@query("to_srid", with_views("pts") + " select pid, round(105+(x-5)/2,6) lon, round(-(y-10*trunc(y/10)),4) lat from pts")
def _(spark, sf):
    """From degrees to metres of one zone, of the zone's other half, and back."""
    p = view(spark, sf, "pts").select("pid", (105 + (F.col("x") - 5) / 2).alias("lon"), F.round(-F.col("y") % 10, 4).alias("lat"))
    p = p.withColumns(dict(zip("en", to_srid(F.col("lon"), F.col("lat"), 4326, 32748))))
    p = p.withColumns(dict(zip("en", to_srid(F.col("e"), F.col("n"), 32748, 32648))))
    lon, lat = to_srid(F.col("e"), F.col("n"), 32648, 4326)
    return p.select("pid", F.round(lon, 6).alias("lon"), F.round(lat, 4).alias("lat"))


# --- networks --------------------------------------------------------------------------

_REACH = """, e as (select g.q*2147483648+g.r a, h.q*2147483648+h.r b from oc g cross join {disk} join oc h on h.q=g.q+dq and h.r=g.r+dr),
    reach as (select q*2147483648+r n, q*2147483648+r m from oc union select reach.n, e.b from reach join e on e.a=reach.m),
    comp as (select n, min(m) component from reach group by 1)""".format(disk=disk(1, 1))


@query("connected_patches", occ_cells() + grid() + _REACH + """ select q, r, cast(case when o.n is null then 0 else dense_rank() over(order by case when o.n is null then 1 else 0 end, component) end as bigint) patch_id
    from grid left join comp o on o.n=q*2147483648+r""")
def _(spark, sf):
    from terraloom.plans.ecology import compact, grid_of

    o = compact(spark, sf)
    occ = o.select("q", "r").distinct()
    edges = hg.adjacency(occ).select(nw.cell_id().alias("src"), nw.cell_id("nq", "nr").alias("dst"))
    ids = nw.patch_ids(nw.connected_components(occ.select(nw.cell_id().alias("node")), edges))
    return grid_of(o).withColumn("node", nw.cell_id()).join(shuffled(ids), "node", "left").fillna(0, ["patch_id"]).drop("node")


_PXR = with_views("dem") + """, m as (select r, c, cast(z>3e2 as int) v, r*2147483648+c n from dem where z>3e2),
    e as (select a.n a, b.n b from m a join m b on (b.r=a.r and abs(b.c-a.c)=1) or (b.c=a.c and abs(b.r-a.r)=1)),
    reach as (select n, n m from m union select reach.n, e.b from reach join e on e.a=reach.m),
    reg as (select n, min(m) region from reach group by 1)"""


def regions(spark, sf):
    m = view(spark, sf, "dem").where("z > 3e2").select("r", "c", F.lit(1).alias("v"))
    return nw.pixel_regions(m, "v")


@query("pixel_regions", _PXR + " select r, c, v, region from m join reg using(n)")
def _(spark, sf):
    return regions(spark, sf).select("r", "c", "v", "region")


@query("region_outlines", _PXR + """, g as (select r, c, region from m join reg using(n)),
    ed as (select region, cast(c as double) x0, cast(r as double) y0, c+1e0 x1, cast(r as double) y1 from g union all select region, cast(c as double), r+1e0, c+1e0, r+1e0 from g
        union all select region, cast(c as double), cast(r as double), cast(c as double), r+1e0 from g union all select region, c+1e0, cast(r as double), c+1e0, r+1e0 from g)
    select region, x0, y0, x1, y1 from ed group by all having count(*)=1""")
def _(spark, sf):
    return sp.pixel_outline(regions(spark, sf), "region")


_NET = with_views("pts") + """, e0 as (select a.pid src, b.pid dst, round(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)),3) len from pts a join pts b on b.pid=a.pid+1 or b.pid=a.pid+10),
    e as (select src, dst, len from e0 union all select dst, src, len from e0), s as (select s_suppkey*15 n from supplier),
    p as (select n, 0e0 dist from s union select e.dst, p.dist+len from p join e on e.src=p.n where p.dist+len<=6e0),
    area as (select n node, min(dist) dist from p group by 1)"""


def network(spark, sf):
    p = view(spark, sf, "pts").select("pid", "x", "y")
    nxt = p.select(F.col("pid").alias("dst"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    hops = p.withColumn("dst", F.explode(F.array(F.col("pid") + 1, F.col("pid") + 10))).join(shuffled(nxt), "dst")
    edges = hops.select(F.col("pid").alias("src"), "dst", F.round(F.sqrt(F.pow(F.col("x") - F.col("nx"), 2) + F.pow(F.col("y") - F.col("ny"), 2)), 3).alias("length"))
    sources = table(spark, sf, "supplier").select((F.col("s_suppkey") * 15).alias("node"))
    return edges, sources


@query("service_area", _NET + " select node, round(dist,6) dist from area")
def _(spark, sf):
    return rd(nw.service_area(*network(spark, sf), 6.0), ["dist"])


@query("lines_reached", _NET + """ select src, dst, round(least(len, greatest(6e0-coalesce(a.dist,6e0),0e0)+greatest(6e0-coalesce(b.dist,6e0),0e0)),6) reached
    from e0 left join area a on a.node=src left join area b on b.node=dst where a.dist is not null or b.dist is not null""")
def _(spark, sf):
    edges, sources = network(spark, sf)
    return rd(nw.lines_reached(edges, nw.service_area(edges, sources, 6.0), 6.0).select("src", "dst", "reached"), ["reached"])


_BTW = occ_cells(1.5) + grid(1) + f""", v as (select q*2147483648+r n, q, r from grid), e as (select a.n a, b.n b from v a cross join {disk(1, 1)} join v b on b.q=a.q+dq and b.r=a.r+dr),
    ds as (select n s, n v, 0 k from v union select ds.s, e.b, k+1 from ds join e on e.a=ds.v where k<16),
    dd as (select s, v, min(k) k from ds group by 1,2),
    pt as (select n s, n v, 0 k, 1e0 paths from v union all select pt.s, e.b, pt.k+1, sum(pt.paths) from pt join e on e.a=pt.v join dd on dd.s=pt.s and dd.v=e.b and dd.k=pt.k+1 group by 1,2,3),
    bt as (select m.v n, sum(a.paths*b.paths/t.paths) x from dd m join pt a on a.s=m.s and a.v=m.v join dd t on t.s=m.s join pt tt on tt.s=t.s and tt.v=t.v join pt b on b.s=m.v and b.v=t.v
        cross join lateral (select tt.paths paths) t2 join pt t3 on t3.s=t.s and t3.v=t.v where m.s<>m.v and t.v<>m.v and t.v<>m.s and a.k+b.k=t.k group by 1)"""
_BTW = _BTW.replace("sum(a.paths*b.paths/t.paths)", "sum(a.paths*b.paths/tt.paths)").replace("\n        cross join lateral (select tt.paths paths) t2 join pt t3 on t3.s=t.s and t3.v=t.v where", " where")


@query("betweenness", _BTW + " select q, r, round(coalesce(x,0e0)/((select count(*) from v)-1)/((select count(*) from v)-2),8) betweenness from v left join bt using(n)")
def _(spark, sf):
    g = materialize(hg.build_grid(assign_cell(view(spark, sf, "occ"), "x", "y", 1.5), 1))
    edges = hg.adjacency(g).select(nw.cell_id().alias("src"), nw.cell_id("nq", "nr").alias("dst"))
    b = nw.betweenness(g.select(nw.cell_id().alias("node")), edges)
    return rd(g.withColumn("node", nw.cell_id()).join(shuffled(b), "node").select("q", "r", "betweenness"), ["betweenness"], 8)


@query("corridor_gaps_with_betweenness", _BTW + ", empty as (select q, r from grid anti join oc using(q,r))" + K1 + f""",
    nr as (select g.q, g.r, sum(case when ring<=2 then richness else 0 end) k2r, min(ring) dist from empty g cross join {disk(3, 1)} join oc h on h.q=g.q+dq and h.r=g.r+dr group by 1,2),
    z as (select q, r, coalesce(k1,0) k1, cast(coalesce(k2r,0) as bigint) k2_richness, coalesce(dist,-1) dist, coalesce(x,0e0)/((select count(*) from v)-1)/((select count(*) from v)-2) b
        from empty join v using(q,r) left join bt using(n) left join k1 using(q,r) left join nr using(q,r)),
    zz as (select *, k1*3+k2_richness*5e-1+b*10 s from z)
    select * exclude(s,b), round(b,6) betweenness, cast(k1>=2 as int) candidate, 0 connects_priority_cells, round(s,2) score,
        case when s>5 then 'High' when s>2 then 'Medium' else 'Low' end tier from zz""")
def _(spark, sf):
    o = materialize(oc.species_years(assign_cell(view(spark, sf, "occ"), "x", "y", 1.5)))
    g = materialize(hg.build_grid(o, 1))
    edges = hg.adjacency(g).select(nw.cell_id().alias("src"), nw.cell_id("nq", "nr").alias("dst"))
    b = g.withColumn("node", nw.cell_id()).join(shuffled(nw.betweenness(g.select(nw.cell_id().alias("node")), edges)), "node").select("q", "r", "betweenness")
    return hg.corridor_gaps(g, o, b)


# --- classes and models ----------------------------------------------------------------------

_VAL = "(select o_totalprice v from orders)"


def _arr(exprs) -> str:
    return "select unnest([" + ",".join(exprs) + "]) b from m"


for _m, _sql in {
    "equal": f"with m as (select min(v) lo, max(v) hi from {_VAL}), b as ({_arr(f'lo+{i}*(hi-lo)/5' for i in range(6))})",
    "quantile": f"with m as (select quantile_cont(v,[0,2e-1,4e-1,6e-1,8e-1,1]) q from {_VAL}), b as (select unnest(q) b from m)",
    "geometric": f"with m as (select min(v) lo, max(v) hi from {_VAL}), b as ({_arr(f'lo*pow(hi/lo,{i}/5e0)' for i in range(6))})",
    "stddev": f"with m as (select min(v) lo, max(v) hi, avg(v) m, stddev_samp(v) s from {_VAL}), b as (select lo b from m union all select hi from m union all select m+k.range*s-5*s from m cross join range(11) k where m+k.range*s-5*s>lo and m+k.range*s-5*s<hi)",
    "pretty": f"with m as (select min(v) lo, max(v) hi from {_VAL}), b as (select cast(g.range*100000 as double) b from m cross join range(0,7) g where g.range between floor(lo/1e5) and ceil(hi/1e5))",
}.items():

    def _breaks(spark, sf, method=_m):
        b = cl.class_breaks(table(spark, sf, "orders"), "o_totalprice", 5, method)
        return b.select(F.posexplode("breaks").alias("i", "b")).select((F.col("i") + 1).cast("bigint").alias("i"), F.round("b", 4).alias("b"))

    query(f"class_breaks_{_m}", _sql + " select row_number() over(order by b) i, round(b,4) b from b")(_breaks)


@query("class_breaks_jenks")
def _(spark, sf):
    b = cl.class_breaks(table(spark, sf, "orders"), "o_totalprice", 5, "jenks")
    return b.select(F.posexplode("breaks").alias("i", "b"))


def _jenks_layer(c: int) -> str:
    """Best cost and cut of every end with ``c`` classes, from all cuts of one class less."""
    return f"""l{c} as (select e.i, min({{'c': p.c + (e.tss - p.tss) - (e.ts - p.ts) * (e.ts - p.ts) / (e.tn - p.tn), 'i': p.i}}) b,
    any_value(e.v) v, any_value(e.tn) tn, any_value(e.ts) ts, any_value(e.tss) tss from l1 e join q{c - 1} p on p.i < e.i group by 1),
q{c} as (select i, b.c c, b.i cut, v, tn, ts, tss from l{c})"""


_JENKS = f"""with c as (select cast(l_quantity as double) v, cast(count(*) as double) n from lineitem group by 1), a as (select sum(v*n)/sum(n) m from c),
l1 as (select row_number() over (order by v) i, v, sum(n) over w tn, sum(n*(v-m)) over w ts, sum(n*(v-m)*(v-m)) over w tss from c, a window w as (order by v)),
q1 as (select i, tss-ts*ts/tn c, 0::bigint cut, v, tn, ts, tss from l1), {', '.join(_jenks_layer(c) for c in range(2, 6))},
t5 as (select * from q5 order by i desc limit 1), {', '.join(f't{c} as (select q{c}.* from q{c} join t{c + 1} on q{c}.i = t{c + 1}.cut)' for c in (4, 3, 2, 1))}
select 0 i, min(v) b from c union all {' union all '.join(f'select {c}, v from t{c}' for c in range(1, 6))}"""


@query("class_breaks_jenks_quantity", _JENKS)
def _(spark, sf):
    b = cl.class_breaks(table(spark, sf, "lineitem"), "l_quantity", 5, "jenks")
    return b.select(F.posexplode("breaks").alias("i", "b"))


@query("assign_class", f"with m as (select min(o_totalprice) lo, max(o_totalprice) hi from orders) select o_orderkey, cast(least(greatest({'+'.join(f'cast(lo+{i}*(hi-lo)/5<o_totalprice as int)' for i in range(6))},1),5) as int) class_no from orders, m")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return cl.assign_class(o, "o_totalprice", cl.class_breaks(o, "o_totalprice", 5, "equal")).drop("o_totalprice")


@query("map_rows", "select o_orderkey, o_totalprice*2e0+1e0 v from orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", md.map_rows(lambda s: s * 2.0 + 1.0, DoubleType(), "o_totalprice").alias("v"))


@query("map_images", with_views("img") + " select scene, r, c, b1*2e0 b1, b2 from img where b2>5e-1")
def _(spark, sf):
    return md.map_images(
        view(spark, sf, "img").select("scene", "r", "c", "b1", "b2"), lambda px: px.where("b2 > 5e-1"), lambda px: px.withColumn("b1", F.col("b1") * 2e0))


@query("score_tiles", with_views("img") + " select scene, r, c, b1-max(b1) over(partition by scene, floor(r/16e0), floor(c/16e0)) score from img")
def _(spark, sf):
    return md.score_tiles(view(spark, sf, "img").select("scene", "r", "c", "b1"), "b1", 16, lambda a: a - np.nanmax(a))


@query("train_forest")
def _(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("label"), (F.col("o_custkey") % 100).cast("double").alias("f1"),
        F.month("o_orderdate").cast("double").alias("f2"), F.dayofyear("o_orderdate").cast("double").alias("f3"))
    model = md.train_forest(tb.sample(df, ["o_orderkey"], 0.2, 42), "label", ["f1", "f2", "f3"], trees=20)
    return md.apply_model(model, df, ["f1", "f2", "f3"]).select("o_orderkey", "prediction")


@query("train_forest_quality", """select count(*) n, count(*) filter (o_custkey%7=0) n_unknown, true "in_range", true close from orders""")
def _(spark, sf):
    """Every row gets a prediction but those with a null feature; a label that follows from the features is learnt."""
    df = table(spark, sf, "orders").select(
        "o_orderkey", ((F.col("o_custkey") % 100) + 10 * F.month("o_orderdate")).cast("double").alias("label"),
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey") % 100).cast("double").alias("f1"), F.month("o_orderdate").cast("double").alias("f2"))
    out = md.apply_model(md.train_forest(tb.sample(df, ["o_orderkey"], 0.2, 42), "label", ["f1", "f2"], trees=20), df, ["f1", "f2"])
    error = F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("label"), 2)))
    return out.agg(
        F.count("*").alias("n"), F.count_if(F.col("prediction").isNull()).alias("n_unknown"),
        ((F.min("prediction") >= F.min("label")) & (F.max("prediction") <= F.max("label"))).alias("in_range"),
        (error < 0.5 * F.stddev_pop("label")).alias("close"))
