"""Climate, calendar and irrigation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.functions import scalars as sc
from terraloom.operators import irrigation as ir
from terraloom.plans.registry import query
from terraloom.plans.sqltext import d
from terraloom.scale import materialize
from terraloom.sources.fixtures import view, with_views


def r(name: str, n: int = 6):
    return F.round(name, n).alias(name)


_ET0 = """(408e-3*slope*rnet+(psy*(900/(t+273)))*wind*(es-ea))/(slope+psy*(34e-2*wind+1))"""
CLIMATE = with_views("weather") + f""", c0 as (select *, temp_k-{d(273.15)} t, dew_k-{d(273.15)} td from weather),
    c1 as (select *, {d(6.11)}*pow(10e0,75e-1*td/({d(237.3)}+td))/10e0 ea, {d(0.6108)}*exp({d(17.27)}*t/(t+{d(237.3)})) es, sqrt(u*u+v*v) wind,
        sw/1e6-lw/1e6 rnet, pressure*1e-3*665e-6 psy from c0),
    c2 as (select *, 4090*es/pow(t+{d(237.3)},2) slope from c1)"""


@query("reference_et0", CLIMATE + f" select k, dt, round({_ET0},6) et0 from c2")
def _(spark, sf):
    w = view(spark, sf, "weather")
    cols = [F.col(c) for c in ("temp_k", "dew_k", "u", "v", "pressure", "sw", "lw")]
    return w.select("k", "dt", F.round(sc.reference_et0(*cols), 6).alias("et0"))


@query("derive_climate", CLIMATE + f""" select k, dt, round(t,6) tmean, round(td,6) tdew, round(rain_m*1000,6) rain, round(ea,6) ea, round(es-ea,6) vpd,
    rad/86400 rad_w, round({_ET0},6) pet from c2""")
def _(spark, sf):
    c = sc.derive_climate(view(spark, sf, "weather"))
    return c.select("k", "dt", "rad_w", *[r(n) for n in ("tmean", "tdew", "rain", "ea", "vpd", "pet")])


@query("date_parts", """select o_orderkey k, cast(year(o_orderdate) as int) "year", cast(month(o_orderdate) as int) "month", cast(day(o_orderdate) as int) "day",
    cast(dayofyear(o_orderdate) as int) doy, strftime(o_orderdate,'%Y-%m-%d') "date", strftime(o_orderdate,'%-m/%-d/%Y') date_us from orders""")
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("k"), "o_orderdate")
    return sc.date_parts(o, "o_orderdate").drop("o_orderdate")


_DOY_IN = """select o_orderkey k, case when o_orderkey%5=0 then strftime(o_orderdate,'%Y-%m-%d') when o_orderkey%5=1 then cast(o_custkey as varchar)
    when o_orderkey%5=2 then cast(-o_custkey as varchar) when o_orderkey%5=3 then cast(o_custkey%366 as varchar)||'.5' end v from orders"""


@query("to_doy", f"""with a as ({_DOY_IN}), b as (select *, try_cast(v as double) n from a)
    select k, cast(least(greatest(coalesce(case when n between 1 and 366 then floor(n) when n>366 then floor(n%366)+1 when n is not null then floor(abs(n)%366)+1
        else dayofyear(try_cast(v as date)) end,100),1),366) as int) doy from b""")
def _(spark, sf):
    text = _DOY_IN.replace("strftime(o_orderdate,'%Y-%m-%d')", "date_format(o_orderdate,'yyyy-MM-dd')").replace("as varchar)", "as string)")
    src = spark.sql(text.replace("from orders", "from {orders}"), orders=spark.read.parquet(f"{sf}/orders.parquet"))
    return src.select("k", sc.to_doy(F.col("v"), 100).alias("doy"))


@query("season_length", with_views("block_dates") + """ select norec, case when end_doy<start_doy then end_doy-start_doy+365 else end_doy-start_doy end length,
    end_doy-start_doy plain from block_dates""")
def _(spark, sf):
    s, e = F.col("start_doy"), F.col("end_doy")
    return view(spark, sf, "block_dates").select("norec", sc.season_length(s, e).alias("length"), sc.season_length(s, e, wrap=False).alias("plain"))


@query("week_key", with_views("scenes_a") + " select id, strftime(dt,'%Y-W%U') year_week from scenes_a")
def _(spark, sf):
    return view(spark, sf, "scenes_a").select("id", sc.week_key(F.col("dt")).alias("year_week"))


@query("iso_week_key", with_views("scenes_a") + " select id, strftime(dt,'%Y')||'_W'||strftime(dt,'%V') year_week from scenes_a")
def _(spark, sf):
    return view(spark, sf, "scenes_a").select("id", sc.iso_week_key(F.col("dt")).alias("year_week"))


@query("unit_scale", with_views("block_daily") + " select norec, dt, round(eta*100e0*1e-1/8e0,6) mm from block_daily")
def _(spark, sf):
    return view(spark, sf, "block_daily").select("norec", "dt", F.round(sc.unit_scale(F.col("eta") * 100e0, 0.1, 8), 6).alias("mm"))


_KC = f"""case when day<=10 then {d(1.05)} when day<=40 then round({d(1.05)}+{d(1.15 - 1.05)}*(day-10)/30,3)
    when day<=80 then round({d(1.15)}+{d(1.2 - 1.15)}*(day-40)/40,3) else round({d(1.2)}+{d(0.95 - 1.2)}*(day-80)/30,3) end"""
# the start of a season is carried over the 110 days that follow it; a block has one start
GROW = with_views("block_daily", "block_dates") + f""", st as (select b.*, max(case when dayofyear(b.dt)=e.start_doy then b.dt end) over (
        partition by b.norec order by b.dt range between interval 109 days preceding and current row) s from block_daily b join block_dates e on b.norec=e.norec),
    gr as (select * exclude (s), cast(date_diff('day', cast(s as date), cast(dt as date))+1 as int) "day" from st where s is not null),
    cw as (select *, {_KC} kc, et0*{_KC} cwr from gr),
    sat as (select *, case when cwr=0 and eta>0 then 1e0 else greatest(least(eta*{d(1.2)}/nullif(cwr,0),1e0),0e0) end si from cw)"""
WEEK = GROW + ", wk as (select norec, strftime(dt,'%Y-W%U') year_week, avg(si) si, min(dt) dt from sat group by 1,2)"
_ST = "round(avg(si),4) mean_si, round(stddev_samp(si),4) std_si"
_MM = "round(min(si),4) min_si, round(max(si),4) max_si"
_CLIP = "case when mean_si=0 and std_si<>0 then 0e0 else least(greatest(coalesce(1-std_si/nullif(mean_si,0),1e0),0e0),1e0) end"


def sat(spark, sf):
    return ir.daily_satisfaction(view(spark, sf, "block_daily"), view(spark, sf, "block_dates"))


def weekly(spark, sf):
    return ir.weekly_si(sat(spark, sf))


@query("growing_days", GROW + ' select norec, dt, "day", et0 from gr')
def _(spark, sf):
    return ir.growing_days(view(spark, sf, "block_daily"), view(spark, sf, "block_dates")).select("norec", "dt", "day", "et0")


@query("kc_curve", GROW + ' select norec, "day", kc from cw')
def _(spark, sf):
    g = ir.growing_days(view(spark, sf, "block_daily"), view(spark, sf, "block_dates")).select("norec", "day")
    return g.join(sc.kc_curve(spark), "day")


@query("crop_water_need", GROW + ' select norec, dt, "day", kc, round(cwr,6) cwr from cw')
def _(spark, sf):
    return ir.crop_water_need(view(spark, sf, "block_daily"), view(spark, sf, "block_dates")).select("norec", "dt", "day", "kc", r("cwr"))


@query("satisfaction_index", GROW + " select norec, dt, round(si,6) si from sat")
def _(spark, sf):
    return sat(spark, sf).select("norec", "dt", r("si"))


@query("eta_adjusted", GROW + f""", e as (select norec, dt, si, cwr, case when d%3=0 then null else eta end eta from sat)
    select norec, dt, round(coalesce(eta, si*cwr/{d(1.2)})*{d(1.2)},6) eta_adjusted from e""")
def _(spark, sf):
    s = sat(spark, sf).withColumn("eta", F.when(F.col("d") % 3 != 0, F.col("eta")))
    return ir.with_adjusted_eta(s).select("norec", "dt", r("eta_adjusted"))


@query("weekly_si", WEEK + " select norec, year_week, round(si,6) si, dt from wk")
def _(spark, sf):
    return weekly(spark, sf).select("norec", "year_week", r("si"), "dt")


@query("weekly_resample", GROW + """, w as (select norec, nama, cast(dt+cast((7-isodow(dt)) as int) as date) week_end, avg(case when d not between 40 and 60 then si end) si, avg(case when d not between 40 and 60 then et0 end) et0 from sat group by 1,2,3),
    fs as (select norec, cast(min(dt) as date) start_date, cast(cast(min(dt) as date)+109 as date) end_date from sat where "day"=1 group by 1),
    sp as (select norec, min(nama) nama, min(week_end) a, max(week_end) b from w group by 1),
    al as (select norec, nama, cast(unnest(generate_series(a,b,interval 7 day)) as date) week_end from sp)
    select norec, al.nama, week_end, cast(year(week_end) as int) "year", cast(month(week_end) as int) "month", cast(day(week_end) as int) "day", cast(weekofyear(week_end) as int) week_of_year,
        strftime(week_end,'%Y')||'_W'||strftime(week_end,'%V') year_week, strftime(week_end,'%m/%d/%Y') date_new, start_date, end_date, round(si,4) si, round(et0,4) et0
    from al join fs using(norec) left join (select * exclude(nama) from w) w using(norec, week_end)""")
def _(spark, sf):
    gap = F.col("d").between(40, 60)  # weeks without values
    return ir.weekly_resample(sat(spark, sf).withColumns({c: F.when(~gap, F.col(c)) for c in ("si", "et0")}), ["si", "et0"])


@query("weekly_uniformity", WEEK + f""", u as (select year_week, {_ST}, count(si) block_count from wk group by 1)
    select *, round(std_si/nullif(mean_si,0)*100,6) cv_pct, round({_CLIP},6) uniformity from u""")
def _(spark, sf):
    return ir.weekly_uniformity(weekly(spark, sf)).withColumns({c: F.round(c, 6) for c in ("cv_pct", "uniformity")})


_BLOCK = f""", ov as (select avg(si) o from wk), bu as (select norec, {_ST}, count(si) week_count, {_MM} from wk group by 1),
    bun as (select bu.*, abs(mean_si-o) deviation, least(greatest(coalesce(1-abs(mean_si-o)/nullif(o,0),1e0),0e0),1e0) uniformity from bu, ov)"""


@query("block_uniformity", WEEK + _BLOCK + " select * exclude(deviation,uniformity), round(deviation,6) deviation, round(uniformity,6) uniformity from bun")
def _(spark, sf):
    return ir.block_uniformity(materialize(weekly(spark, sf))).withColumns({c: F.round(c, 6) for c in ("deviation", "uniformity")})


_REL = f""", re as (select norec, {_ST}, count(si) total_weeks, {_MM}, count(*) filter(si>5e-1) weeks_above from wk group by 1),
    rel as (select *, least(greatest(weeks_above/cast(nullif(total_weeks,0) as double),0e0),1e0) reliability from re)"""


@query("reliability_threshold", WEEK + _REL + " select * exclude(reliability), round(reliability,6) reliability from rel")
def _(spark, sf):
    return ir.reliability_threshold(weekly(spark, sf)).withColumn("reliability", F.round("reliability", 6))


@query("reliability_cv", WEEK + f""", b as (select norec, {_ST}, count(si) week_count, {_MM} from wk group by 1)
    select *, round(std_si/nullif(mean_si,0)*100,6) cv_pct, round({_CLIP},6) reliability from b""")
def _(spark, sf):
    return ir.reliability_cv(weekly(spark, sf)).withColumns({c: F.round(c, 6) for c in ("cv_pct", "reliability")})


@query("performance_summary", WEEK + _BLOCK + _REL + f""", u0 as (select year_week, {_ST} from wk group by 1), u as (select {_CLIP} uniformity from u0)
    select round((select o from ov),6) overall_mean, round((select avg(uniformity) from u),6) week_mean, round((select min(uniformity) from u),6) week_min,
        round((select max(uniformity) from u),6) week_max, (select count(*) from u where uniformity>{d(0.85)}) week_above, (select count(*) from u) week_n,
        round((select avg(uniformity) from bun),6) block_mean, round((select min(uniformity) from bun),6) block_min, round((select max(uniformity) from bun),6) block_max,
        round((select avg(reliability) from rel),6) reliability_mean, round((select min(reliability) from rel),6) reliability_min,
        round((select max(reliability) from rel),6) reliability_max, (select count(*) from rel where reliability>{d(0.75)}) reliability_above, (select count(*) from rel) reliability_n""")
def _(spark, sf):
    s = ir.performance_summary(materialize(weekly(spark, sf)))
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in s.dtypes])


@query("block_map", WEEK + _BLOCK + _REL + """, z as (select cast(c_custkey as int) norec, c_mktsegment zone from customer)
    select norec, bun.mean_si, round(uniformity,6) uniformity, round(reliability,6) reliability, zone from bun join rel using(norec) join z using(norec)""")
def _(spark, sf):
    w = materialize(weekly(spark, sf))
    zones = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").cast("int").alias("norec"), F.col("c_mktsegment").alias("zone"))
    return ir.block_map(ir.block_uniformity(w), ir.reliability_threshold(w), zones).withColumns(
        {c: F.round(c, 6) for c in ("uniformity", "reliability")})
