"""Species, grid and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terraloom.functions.fixed_values import PRIORITY_WEIGHTS, RESISTANCE
from terraloom.functions.hexgrid import assign_cell, cell_boundary, cell_center, grid_disk, grid_distance, grid_ring, mean_center
from terraloom.operators import hexgraph as hg, network as nw, occurrence as oc, raster as rs
from terraloom.plans.registry import query
from terraloom.scale import materialize, shuffled
from terraloom.plans.sqltext import SIZE, SLOPE, YEAR_TESTS, YEARS, d, disk, grid, hexed, occ_cells, trend
from terraloom.sources.fixtures import view, with_views

COMMON = {"Brand#11": "First brand", "Brand#12": "Second brand", "Brand#2": "Third brand"}
THREATENED = ["Brand#1", "Brand#11", "Brand#12", "Brand#2", "Brand#3", "Brand#4", "Brand#5"]
WEIGHTS = {"richness": 0.177, "connectivity": 0.181, "threatened": 0.169, "diversity": 0.180, "co_occurrence": 0.180}


def occ(spark: SparkSession, sf: str, size: float = SIZE) -> DataFrame:
    return assign_cell(view(spark, sf, "occ"), "x", "y", size)


def compact(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences reduced to (cell, species, year) and stored, for queries with several passes."""
    return materialize(oc.species_years(occ(spark, sf)))


def grid_of(o: DataFrame, k: int = 2) -> DataFrame:
    return hg.build_grid(o, k)


OCC = occ_cells()
GRID = OCC + grid()
IN = "','".join(THREATENED)

_SUMMARY = f""", sy as (select q, r, yr, count(*) rec, count(distinct species) sp from occ_c group by 1,2,3),
    a as (select q, r, count(*) total_records, count(distinct species) species_richness,
        string_agg(distinct species, ', ' order by species) species_list from occ_c group by 1,2),
    b as (select q, r, {SLOPE} s, min(yr) first_year, max(yr) last_year, count(*) n_years,
        {', '.join(f'sum(case when {t} then rec else 0 end) records_{y}' for y, t in YEAR_TESTS.items())} from sy where yr is not null group by 1,2)
    select q, r, cast(coalesce(total_records,0) as bigint) total_records, cast(coalesce(species_richness,0) as bigint) species_richness,
        coalesce(species_list,'') species_list, first_year, last_year, cast(coalesce(n_years,0) as bigint) n_years,
        {', '.join(f'cast(coalesce(records_{y},0) as bigint) records_{y}' for y in YEAR_TESTS)},
        round(coalesce(s,0),4) trend_slope, {trend('coalesce(s,0)', 'coalesce(n_years,0)', 'No Data')} trend
    from grid left join a using(q,r) left join b using(q,r)"""


@query("cell_summary", GRID + _SUMMARY)
def _(spark, sf):
    o = compact(spark, sf)
    return oc.cell_summary(o, grid_of(o), years=YEARS)


@query("richness_summary", GRID.replace("oc as (", f"occ_all as (select * from occ_c), oc as (", 1)
       + _SUMMARY.replace("from occ_c", f"from (select * from occ_c where species in ('{IN}') and species not in ('Brand#3'))"))
def _(spark, sf):
    o = occ(spark, sf)
    return oc.cell_summary(oc.filter_species(o, THREATENED, ["Brand#3"]), grid_of(o), years=YEARS)


_COMMON_SQL = " ".join(f"when '{k}' then '{v}'" for k, v in COMMON.items())
DIVERSITY = f""", cn as (select q, r, species, count(*) n, min(rid) fr from occ_c group by 1,2,3),
    tr0 as (select q, r, yr, count(distinct species) sp from occ_c where yr is not null group by 1,2,3),
    tr as (select q, r, {SLOPE} s, count(*) ny from tr0 group by 1,2),
    dv as (select q, r, count(*) s, sum(n) n, sum(n*ln(n)) nln, cast(sum(n*n) as double) nn, max(n) mx,
        arg_min(species, row(-n, fr, species)) dom from cn group by 1,2),
    dv2 as (select *, case when s>1 then ln(cast(n as double))-nln/n else 0e0 end h from dv),
    div as (select q, r, cast(dv2.s as bigint) s, cast(n as bigint) n, round(h,4) shannon_h,
        round(1-nn/(cast(n as double)*cast(n as double)),4) simpson_d,
        round(case when dv2.s>1 then h/ln(dv2.s) else 0e0 end,4) pielou_j, round(mx/cast(n as double),4) berger_parker,
        dom dominant_species, coalesce(case dom {_COMMON_SQL} end,'') common_name,
        round(coalesce(tr.s,0),4) trend_slope, coalesce({trend('tr.s', 'ny', 'Stable')},'Stable') trend
        from dv2 left join tr using(q,r))"""


@query("diversity_by_cell", OCC + DIVERSITY + " select * from div")
def _(spark, sf):
    return oc.diversity(occ(spark, sf), common=COMMON)


@query("linear_trend", OCC + f""", t as (select q, r, yr, count(distinct species) sp from occ_c where yr is not null group by 1,2,3),
    u as (select q, r, {SLOPE} s, count(*) n_years from t group by 1,2)
    select q, r, round(s,4) trend_slope, {trend('s', 'n_years', 'No Data')} trend, n_years from u""")
def _(spark, sf):
    return oc.linear_trend(occ(spark, sf))


def _chao_sql(keys: str, extra: str, years: bool = False) -> str:
    seen = (f""", yrs as (select {keys}, count(distinct yr) years_surveyed, string_agg(distinct cast(yr as varchar), ', ' order by cast(yr as varchar)) survey_years
        from occ_c where yr is not null group by all)""" if years else "")
    return f""", sp as (select {keys}, species, count(*) rec from occ_c where yr is not null or {years} group by all),
    ch as (select {keys}, cast(sum(rec) as bigint) n, count(*) s_obs, count(*) filter(rec=1) f1, count(*) filter(rec=2) f2 from sp group by all),
    ce as (select *, case when f2>0 then s_obs+cast(f1*f1 as double)/(2e0*f2) when f1>0 then s_obs+cast(f1*(f1-1) as double)/2e0 else cast(s_obs as double) end c from ch)
    {seen}, chao as (select ce.* exclude(c), round(c,2) chao1, round(s_obs/c*100,1) completeness_pct {extra} from ce {f'left join yrs using({keys})' if years else ''})"""


CHAO = _chao_sql("q, r", ", round(c-s_obs,1) undetected, years_surveyed, survey_years", True)


@query("chao1_by_cell", OCC + CHAO + " select * from chao")
def _(spark, sf):
    return oc.chao1(occ(spark, sf))


@query("chao1_per_period", OCC + _chao_sql("yr", ", round(1-cast(f1 as double)/n,4) coverage") + " select * from chao")
def _(spark, sf):
    return oc.chao1_per_period(occ(spark, sf))


@query("chao1_comparison", OCC + """, sp as (select 'Full' dataset, species, count(*) rec from occ_c group by all
    union all select 'Recent (1999+)', species, count(*) from occ_c where yr>=1999 group by all),
    ch as (select dataset, cast(sum(rec) as bigint) n, count(*) s_obs, count(*) filter(rec=1) f1, count(*) filter(rec=2) f2 from sp group by all),
    ce as (select *, case when f2>0 then s_obs+cast(f1*f1 as double)/(2e0*f2) when f1>0 then s_obs+cast(f1*(f1-1) as double)/2e0 else cast(s_obs as double) end c from ch)
    select * exclude(c), round(c,2) chao1, round(s_obs/c*100,1) completeness_pct from ce""")
def _(spark, sf):
    return oc.chao1_comparison(view(spark, sf, "occ"), 1999, "Recent (1999+)")


@query("effort_per_period", OCC + """ select yr, count(*) records, count(distinct species) n_species, count(distinct (q,r)) n_cells,
    count(distinct method) n_methods, string_agg(distinct method, ', ' order by method) method_list from occ_c where yr is not null group by 1""")
def _(spark, sf):
    return oc.effort_per_period(occ(spark, sf))


@query("temporal_matrix", GRID + f""", sy as (select q, r, yr, count(*) rec, count(distinct species) sp from occ_c where yr is not null group by 1,2,3),
    w as (select q, r, {', '.join(f'sum(case when {t} then rec else 0 end) records_{y}, sum(case when {t} then sp else 0 end) species_{y}' for y, t in YEAR_TESTS.items())},
        sum(rec) total_records, count(*) years_with_data from sy group by 1,2)
    select q, r, {', '.join(f'cast(coalesce(records_{y},0) as bigint) records_{y}, cast(coalesce(species_{y},0) as bigint) species_{y}' for y in YEAR_TESTS)},
        cast(coalesce(total_records,0) as bigint) total_records, cast(coalesce(years_with_data,0) as bigint) years_with_data,
        case when coalesce(total_records,0)>0 then 'Occupied' else 'Empty' end status from grid left join w using(q,r)""")
def _(spark, sf):
    o = compact(spark, sf)
    return oc.temporal_matrix(o, grid_of(o), years=YEARS)


@query("value_counts", with_views("occ") + " select species, count(*) n from occ group by 1")
def _(spark, sf):
    return oc.value_counts(view(spark, sf, "occ"), "species")


@query("spearman_trend", with_views("occ") + f""", y as (select species, yr, count(*) n from occ where yr is not null group by 1,2),
    k as (select *, cast(rank() over(partition by species order by yr) as double) ry,
        rank() over(partition by species order by n)+(count(*) over(partition by species, n)-1)/2e0 rn from y),
    c as (select species, count(*) n_years, case when min(n)=max(n) then null else corr(ry,rn) end rho from k group by 1 having count(*)>=3),
    p as (select *, n_years-2 v, asin(least(abs(rho),1e0)) th, 1-rho*rho c2, sqrt(greatest(1-rho*rho,0)) c1, abs(rho) s from c),
    t as (select species, count(*) total_records from occ group by 1)
    select species, coalesce(case species {_COMMON_SQL} end,'') common_name, n_years, total_records, round(rho,4) rho,
        round(greatest(1-case v when 1 then 2*th/pi() when 2 then s when 3 then 2/pi()*(th+s*c1) when 4 then s*(1+c2/2)
          when 5 then 2/pi()*(th+s*(c1+c1*c2*2/3)) when 6 then s*(1+c2/2+c2*c2*3/8) end,0e0),4) p_value,
        case when rho>{d(0.3)} then 'Increasing' when rho<{d(-0.3)} then 'Decreasing' else 'Stable' end trend
    from p join t using(species)""")
def _(spark, sf):
    return oc.spearman_trend(view(spark, sf, "occ"), COMMON)


@query("co_occurrence", GRID + """ select q, r, case when richness is not null then richness end n_species,
    coalesce(richness*(richness-1)/2e0,0e0) n_pairs from grid left join oc using(q,r)""")
def _(spark, sf):
    o = compact(spark, sf)
    return oc.co_occurrence(o, grid_of(o))


@query("threatened_count", OCC + f" select q, r, count(distinct case when species in ('{IN}') then species end) threatened from occ_c group by 1,2")
def _(spark, sf):
    return oc.threatened_count(occ(spark, sf), THREATENED)


def permeability(spark: SparkSession, sf: str) -> DataFrame:
    """Permeability per cell from the land-cover pixels whose centres lie in it."""
    px = view(spark, sf, "dem").select((F.col("c") / 10 + 0.05).alias("x"), (F.col("r") / 10 + 0.05).alias("y"), "cls")
    return rs.permeability(assign_cell(px, "x", "y", SIZE), None, ["q", "r"])


def parts(o: DataFrame, perm: DataFrame | None = None) -> DataFrame:
    """The measured parts of the priority index per occupied cell; permeability is 50 where nothing is known."""
    g = grid_of(o)
    dv = oc.diversity(o).select("q", "r", F.col("s").alias("richness"), F.col("shannon_h").alias("diversity"))
    conn = hg.connectivity(g, o).select("q", "r", F.col("k1").alias("connectivity"))
    out = (
        dv.join(shuffled(conn), ["q", "r"], "left").join(shuffled(oc.threatened_count(o, THREATENED)), ["q", "r"])
        .withColumn("co_occurrence", F.col("richness") * (F.col("richness") - 1) / 2e0)
    )
    return out if perm is None else out.join(shuffled(perm), ["q", "r"], "left").fillna({"permeability": 50.0})


K1 = f""", k1 as (select g.q, g.r, count(oc.q) k1 from grid g cross join {disk(1, 1)} join grid h on h.q=g.q+dq and h.r=g.r+dr
    left join oc on oc.q=h.q and oc.r=h.r group by 1,2)"""
PARTS = GRID + DIVERSITY + K1 + f""", thr as (select q, r, count(distinct case when species in ('{IN}') then species end) threatened from occ_c group by 1,2),
    parts as (select q, r, s richness, shannon_h diversity, k1 connectivity, threatened, s*(s-1)/2e0 co_occurrence
        from div join k1 using(q,r) join thr using(q,r))"""
_NORM = {c: f"coalesce((cast({c} as double)-(select min({c}) from parts))/nullif(cast((select max({c}) from parts)-(select min({c}) from parts) as double),0),0e0)"
         for c in WEIGHTS}
PRIORITY = PARTS + f""", pri0 as (select *, round(0e0+{'+'.join(f'{_NORM[c]}*{d(w)}' for c, w in WEIGHTS.items())},4) priority_index from parts),
    pri as (select *, case when priority_index>={d(0.7)} then 'CRITICAL' when priority_index>={d(0.5)} then 'HIGH' when priority_index>={d(0.3)} then 'MEDIUM' else 'LOW' end tier,
        row_number() over(order by priority_index desc, q, r) priority_rank from pri0)"""


@query("minmax_normalize", PARTS + f" select q, r, {', '.join(f'round({_NORM[c]},8) n_{c}' for c in WEIGHTS)} from parts")
def _(spark, sf):
    out = oc.minmax_normalize(parts(compact(spark, sf)), list(WEIGHTS))
    return out.select("q", "r", *[F.round(f"n_{c}", 8).alias(f"n_{c}") for c in WEIGHTS])


_PERM = ", " + with_views("dem")[len("with recursive "):] + ", lc as (select cls, c/1e1+5e-2 x, r/1e1+5e-2 y from dem), " + hexed("lc") + f""",
    pm as (select q, r, round(100-sum(case cls {' '.join(f'when {k} then {v}' for k, v in RESISTANCE.items())} else 50 end)/cast(count(*) as double),2) permeability
        from lc_c where cls between 1 and 10 group by 1,2),
    six as (select parts.*, coalesce(permeability,50e0) permeability from parts left join pm using(q,r))"""
_NORM6 = {c: v.replace("from parts", "from six") for c, v in _NORM.items()}
_NORM6["permeability"] = _NORM["richness"].replace("richness", "permeability").replace("from parts", "from six")


_SIX = PARTS + _PERM + f""", p0 as (select *, round(0e0+{'+'.join(f'{_NORM6[c]}*{d(w)}' for c, w in PRIORITY_WEIGHTS.items())},4) priority_index from six)
    select *, case when priority_index>={d(0.7)} then 'CRITICAL' when priority_index>={d(0.5)} then 'HIGH' when priority_index>={d(0.3)} then 'MEDIUM' else 'LOW' end tier,
        row_number() over(order by priority_index desc, q, r) priority_rank from p0"""


@query("priority_index_six_parts", _SIX)
@query("priority_index", _SIX)
def _(spark, sf):
    return oc.priority_index(parts(compact(spark, sf), permeability(spark, sf)), PRIORITY_WEIGHTS)


@query("spearman_matrix", PARTS + f""", rk as (select {', '.join(f'rank() over(order by {c})+(count(*) over(partition by {c})-1)/2e0 {c}' for c in WEIGHTS)} from parts)
    """ + " union all ".join(f"select '{a}' a, '{b}' b, round(corr({a},{b}),4) rho from rk"
                             for i, a in enumerate(WEIGHTS) for b in list(WEIGHTS)[i:]))
def _(spark, sf):
    return oc.spearman_matrix(parts(compact(spark, sf)), ["q", "r"], list(WEIGHTS))


TURN = f""", st as (select q, r, yr, list(distinct species) sp from occ_c where yr is not null group by 1,2,3),
    sv as (select *, lag(sp) over(partition by q,r order by yr) prev from st),
    sg as (select q, r, yr, len(sp) sp, prev is not null hp, len(list_filter(sp, lambda x: not list_contains(prev,x))) gained,
        len(list_filter(prev, lambda x: not list_contains(sv.sp,x))) lost, len(list_distinct(list_concat(prev,sp))) u from sv),
    tt as (select q, r, {SLOPE} s, min(yr) first_detected, max(yr) last_detected, count(*) years_detected,
        sum(case when hp then gained else 0 end) colonisations, sum(case when hp then lost else 0 end) extinctions,
        round(avg(case when hp then (gained+lost)/cast(u as double) end),4) mean_beta,
        {', '.join(f'sum(case when {t} then sp else 0 end) rich_{y}' for y, t in YEAR_TESTS.items())} from sg group by 1,2),
    turn as (select q, r, first_detected, last_detected, cast(coalesce(years_detected,0) as bigint) years_detected,
        cast(coalesce(colonisations,0) as bigint) colonisations, cast(coalesce(extinctions,0) as bigint) extinctions,
        coalesce(mean_beta,0e0) mean_beta, cast(coalesce(richness,0) as bigint) species_ever,
        {', '.join(f'cast(coalesce(rich_{y},0) as bigint) rich_{y}' for y in YEAR_TESTS)},
        case when years_detected is null then 'Never Detected' when years_detected>=3 then 'Persistent' when last_detected>=2000 then 'Recent' else 'Historical' end status,
        case when years_detected is null then 'No Data' else {trend('s', 'years_detected', 'Stable')} end richness_trend
    from grid left join tt using(q,r) left join oc using(q,r))"""


@query("temporal_turnover", GRID + TURN + " select * from turn")
def _(spark, sf):
    o = compact(spark, sf)
    return oc.temporal_turnover(o, grid_of(o), recent_from=2000, years=YEARS)


@query("harmonize_names", with_views("occ") + """ select case species when 'Brand#1' then 'Brand#11' when 'Brand#2' then 'Brand#12' else species end species,
    count(*) n, sum(case when species in ('Brand#1','Brand#2') then 1 else 0 end)::bigint changed from occ group by 1""")
def _(spark, sf):
    h = oc.harmonize(view(spark, sf, "occ"), "species", {"Brand#1": "Brand#11", "Brand#2": "Brand#12"})
    return h.groupBy("species").agg(
        F.count("*").alias("n"), F.count_if(F.col("species") != F.col("species_original")).alias("changed"))


@query("filter_species", with_views("occ") + f" select * from occ where species in ('{IN}') and species not in ('Brand#3')")
def _(spark, sf):
    return oc.filter_species(view(spark, sf, "occ"), THREATENED, ["Brand#3"])


@query("species_list", with_views("occ") + " select yr, string_agg(distinct species, ', ' order by species) species from occ group by 1")
def _(spark, sf):
    return view(spark, sf, "occ").groupBy("yr").agg(oc.species_list("species").alias("species"))


# --- grid ------------------------------------------------------------------------------

@query("assign_cell", OCC + " select rid, x, y, q, r from occ_c")
def _(spark, sf):
    return occ(spark, sf).select("rid", "x", "y", "q", "r")


@query("cell_center", OCC + f" select q, r, round((q+r/2e0)*{d(SIZE * 1.7320508075688772)},6) cx, round(r*{d(SIZE * 1.5)},6) cy from oc")
def _(spark, sf):
    cx, cy = cell_center(SIZE)
    return occ(spark, sf).select("q", "r").distinct().select("q", "r", F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"))


@query("cell_boundary", OCC + f""" select q, r, i, round((q+r/2e0)*{d(SIZE * 1.7320508075688772)}+{d(SIZE)}*cos((i*60-30)*pi()/180),6) x,
    round(r*{d(SIZE * 1.5)}+{d(SIZE)}*sin((i*60-30)*pi()/180),6) y from oc cross join (select cast(range as int) i from range(7))""")
def _(spark, sf):
    ring = occ(spark, sf).select("q", "r").distinct().select("q", "r", F.posexplode(cell_boundary(SIZE)).alias("i", "p"))
    return ring.select("q", "r", "i", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("grid_disk", OCC + f" select q, r, q+dq nq, r+dr nr, ring from oc cross join {disk(2)}")
def _(spark, sf):
    return grid_disk(occ(spark, sf).select("q", "r").distinct(), 2)


@query("grid_ring", OCC + f" select q, r, q+dq nq, r+dr nr, ring from oc cross join {disk(3, 3)}")
def _(spark, sf):
    return grid_ring(occ(spark, sf).select("q", "r").distinct(), 3)


@query("grid_distance", OCC + " select q, r, cast((abs(q)+abs(r)+abs(q+r))/2 as int) dist from oc")
def _(spark, sf):
    c = occ(spark, sf).select("q", "r").distinct()
    return c.withColumn("dist", grid_distance(F.col("q"), F.col("r"), F.lit(0), F.lit(0)))


@query("build_grid", GRID + " select * from grid")
def _(spark, sf):
    return grid_of(occ(spark, sf))


@query("adjacency", GRID + f" select g.q, g.r, h.q nq, h.r nr from grid g cross join {disk(1, 1)} join grid h on h.q=g.q+dq and h.r=g.r+dr")
def _(spark, sf):
    return hg.adjacency(grid_of(occ(spark, sf)))


@query("connectivity", GRID + K1 + f""", k2 as (select g.q, g.r, count(*) k2 from grid g cross join {disk(2, 1)} join oc h on h.q=g.q+dq and h.r=g.r+dr group by 1,2),
    cs as (select distinct q, r, species from occ_c),
    rs as (select g.q, g.r, count(distinct species) species_k2 from grid g cross join {disk(2, 1)} join cs h on h.q=g.q+dq and h.r=g.r+dr group by 1,2)
    select q, r, cast(case when richness is null then 0 else 1 end as int) occupied, coalesce(k1,0) k1, coalesce(k2,0) k2, coalesce(species_k2,0) species_k2,
        2*coalesce(k1,0)+coalesce(k2,0) eco_score, case when richness is null then 'Empty' else 'Occupied' end cell_type
    from grid left join oc using(q,r) left join k1 using(q,r) left join k2 using(q,r) left join rs using(q,r)""")
def _(spark, sf):
    o = compact(spark, sf)
    return hg.connectivity(grid_of(o), o)


EMPTY = GRID + ", empty as (select q, r from grid anti join oc using(q,r))"


@query("corridor_gaps", EMPTY + K1 + f""", nr as (select g.q, g.r, sum(case when ring<=2 then richness else 0 end) k2r, min(ring) dist
        from empty g cross join {disk(3, 1)} join oc h on h.q=g.q+dq and h.r=g.r+dr group by 1,2),
    z as (select q, r, coalesce(k1,0) k1, cast(coalesce(k2r,0) as bigint) k2_richness, coalesce(dist,-1) dist, 0e0 betweenness from empty left join k1 using(q,r) left join nr using(q,r)),
    zz as (select *, k1*3+k2_richness*5e-1+betweenness*10 s from z)
    select * exclude(s), cast(k1>=2 as int) candidate, 0 connects_priority_cells, round(s,2) score,
        case when s>5 then 'High' when s>2 then 'Medium' else 'Low' end tier from zz""")
def _(spark, sf):
    o = compact(spark, sf)
    return hg.corridor_gaps(grid_of(o), o)


@query("isolation_risk", PRIORITY + f""", nb as (select g.q, g.r, h.q nq, h.r nr, oc.q is not null o from oc g cross join {disk(1, 1)} join grid h on h.q=g.q+dq and h.r=g.r+dr
        left join oc on oc.q=h.q and oc.r=h.r),
    dr1 as (select q, r, count(*) filter(o) direct, count(*) filter(not o) gaps from nb group by 1,2),
    sec as (select distinct n.q, n.r, n.nq+dq eq, n.nr+dr er from (select * from nb where not o) n cross join {disk(1, 1)}),
    ex as (select s.q, s.r, count(*) extra from sec s join oc on oc.q=eq and oc.r=er
        where not (eq=s.q and er=s.r) and not exists(select 1 from nb where nb.o and nb.q=s.q and nb.r=s.r and nb.nq=eq and nb.nr=er) group by 1,2)
    select q, r, oc.richness, coalesce(direct,0) direct, coalesce(gaps,0) gaps, coalesce(extra,0) extra, coalesce(direct,0)+coalesce(extra,0) total,
        coalesce(priority_index,0e0) priority_index, coalesce(tier,'LOW') tier
    from oc left join dr1 using(q,r) left join ex using(q,r) left join (select q, r, priority_index, tier from pri) p using(q,r)""")
def _(spark, sf):
    o = compact(spark, sf)
    return hg.isolation_risk(grid_of(o), o, oc.priority_index(parts(o), WEIGHTS))


SGAP = f""", n2 as (select g.q, g.r, count(*) filter(ring=1) k1, count(*) k2, sum(case when ring=1 then richness else 0 end) k1r, sum(richness) k2r
        from empty g cross join {disk(2, 1)} join oc h on h.q=g.q+dq and h.r=g.r+dr group by 1,2),
    n5 as (select g.q, g.r, min(ring) dist from empty g cross join {disk(5, 1)} join oc h on h.q=g.q+dq and h.r=g.r+dr group by 1,2),
    z as (select q, r, coalesce(k1,0) k1, coalesce(k2,0) k2, cast(coalesce(k1r,0) as bigint) k1_richness, cast(coalesce(k2r,0) as bigint) k2_richness,
        coalesce(dist,-1) dist_km from empty left join n2 using(q,r) left join n5 using(q,r)),
    zz as (select *, cast(k1>=2 as int) candidate, k1_richness*2+k2_richness*5e-1+10*cast(k1>=2 as int) s from z),
    sgap as (select * exclude(s), round(s,2) score, case when s>10 then 'High' when s>3 then 'Medium' else 'Low' end survey_priority from zz)"""


@query("survey_gaps", EMPTY + SGAP + " select * from sgap")
def _(spark, sf):
    o = compact(spark, sf)
    return hg.survey_gaps(grid_of(o), o)


@query("survey_targets", PRIORITY + CHAO + EMPTY[len(GRID):] + SGAP + """ select q, r, 'undersampled' reason from pri join chao using(q,r)
    where tier in ('CRITICAL','HIGH') and completeness_pct<80 and years_surveyed<3
    union all select q, r, 'high_value_gap' from sgap where survey_priority='High' and candidate=1 and k1_richness>5""")
def _(spark, sf):
    o = compact(spark, sf)
    return hg.survey_targets(oc.priority_index(parts(o), WEIGHTS), oc.chao1(o), hg.survey_gaps(grid_of(o), o))


@query("master_join", PRIORITY + CHAO + """ select q, r, s, n, shannon_h, simpson_d, pielou_j, berger_parker, dominant_species, common_name, trend_slope, trend,
    richness, diversity, connectivity, threatened, co_occurrence, priority_index, tier, priority_rank,
    chao.n n_chao, s_obs, f1, f2, chao1, completeness_pct, undetected, years_surveyed, survey_years
    from div left join pri using(q,r) left join chao using(q,r)""".replace("select q, r, s, n,", "select q, r, s, div.n n,"))
def _(spark, sf):
    o = compact(spark, sf)
    return hg.master_join(
        oc.diversity(o, common=COMMON), [(oc.priority_index(parts(o), WEIGHTS), ""), (oc.chao1(o), "_chao")])


@query("hexbin", with_views("pts") + ", " + hexed("pts", 0.5) + " select q, r, count(*) n from pts_c group by 1,2")
def _(spark, sf):
    return hg.hexbin(assign_cell(view(spark, sf, "pts"), "x", "y", 0.5))


@query("mean_center", OCC + f""" select round(avg((q+r/2e0)*{d(SIZE * 1.7320508075688772)}),6) cx, round(avg(r*{d(SIZE * 1.5)}),6) cy from oc""")
def _(spark, sf):
    return mean_center(occ(spark, sf), SIZE).select(F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))
