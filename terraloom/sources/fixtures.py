"""Observation tables derived from the driver tables.

Each view is one SELECT understood by Spark and DuckDB alike, so the Spark job and its
oracle start from the same definition.  The world is a strip 10 units wide that grows
with the number of customers: density per unit area stays constant at any scale.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from terraloom.scale import shuffled

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_X = "cast({k}*7919%1000 as double)/1e2"
_Y = "floor({k}/150e0)+cast({k}*104729%997 as double)/997e0"

VIEWS: dict[str, str] = {
    # species occurrences: one row per line item, placed at its customer
    "occ": f"""select cast(l_orderkey*10+l_linenumber as bigint) rid, p_brand species,
        cast(year(l_shipdate) as int) yr, o_orderpriority method,
        {_X.format(k='o_custkey')} x, {_Y.format(k='o_custkey')} y
        from lineitem join orders on l_orderkey=o_orderkey join part on l_partkey=p_partkey""",
    # points with weight
    "pts": f"""select c_custkey pid, c_nationkey k, c_acctbal w, c_mktsegment seg,
        {_X.format(k='c_custkey')} x, {_Y.format(k='c_custkey')} y from customer""",
    # second point layer (facilities)
    "sites": f"""select s_suppkey sid, s_acctbal cap,
        cast(s_suppkey*619%100 as double)/1e1+5e-2 x,
        floor(s_suppkey/10e0)+cast(s_suppkey*389%97 as double)/97e0 y from supplier""",
    # unit squares covering the strip, ten per row; grp forms irregular regions
    "zone": """select s_suppkey zid, cast(s_nationkey%5 as int) grp,
        cast(s_suppkey%10 as double) x0, floor(s_suppkey/10e0)+0e0 y0,
        cast(s_suppkey%10+1 as double) x1, floor(s_suppkey/10e0)+1e0 y1 from supplier""",
    # line from each customer's place half-way towards the next customer's place
    "lines": f"""select c_custkey lid, c_mktsegment seg,
        {_X.format(k='c_custkey')} x0, {_Y.format(k='c_custkey')} y0,
        {_X.format(k='c_custkey')}+cast(c_custkey*31%21-10 as double)/2e1 x1,
        {_Y.format(k='c_custkey')}+cast(c_custkey*17%19-9 as double)/2e1 y1 from customer""",
    # elevation and land-cover raster, 100 columns, growing in rows
    "dem": """select cast(floor(o_orderkey/100e0) as bigint) r,
        cast(o_orderkey%100 as bigint) c, o_totalprice/1e3 z, cast(o_custkey%12 as int) cls from orders""",
    # multi-band image in scenes of 50 x 50 pixels; 0 is nodata
    "img": """select cast(floor(o_orderkey/2500e0) as bigint) scene, cast(floor(o_orderkey%2500/50e0) as bigint) r,
        cast(o_orderkey%50 as bigint) c,
        case when o_orderkey%37=0 then 0e0 else o_totalprice/6e5 end b1,
        case when o_orderkey%37=0 then 0e0 else cast(o_custkey%997+1 as double)/1e3 end b2,
        case when o_orderkey%37=0 then 0e0 else cast(o_orderkey*31%503+1 as double)/6e2 end b3,
        case when o_orderkey%37=0 then 0e0 else cast(o_custkey*7%811+1 as double)/9e2 end b4 from orders""",
    # predicted version of img
    "img_pred": """select scene, r, c, b1+cast((r*7+c)%7-3 as double)/1e2 b1, b2+cast((r+c*3)%5-2 as double)/1e2 b2,
        b3+cast((r*2+c)%9-4 as double)/1e2 b3, b4+cast((r+c)%3-1 as double)/1e2 b4 from img""",
    # classified pixels with reflectance-like bands
    "px": """select cast(floor(vec_id/25e0) as bigint) r, cast(vec_id%25 as bigint) c, cast(label as int) cls,
        cast(abs(embedding[{0}]) as double) blue, cast(abs(embedding[{1}]) as double) green,
        cast(abs(embedding[{2}]) as double) red, cast(abs(embedding[{3}]) as double) nir,
        cast(abs(embedding[{4}]) as double) swir1, cast(abs(embedding[{5}]) as double) swir2 from embeddings""",
    # irregular image series per pixel
    "px_ts": """select user_id pix, cast(ts as date) dt, avg(value) nir, avg(cast({json} as double)) red,
        max(event_type) kind from events group by 1,2""",
    # daily reference and actual evapotranspiration per block, 183 days from 2023-10-01
    "block_daily": """select cast(c_custkey as int) norec, c_name nama, d, {day} dt,
        cast((c_custkey*31+d*17)%50 as double)/10e0+1e0 et0,
        cast((c_custkey*13+d*29)%60 as double)/10e0 eta from customer {days}""",
    # start (flooding) and end (peak) day of year per block
    "block_dates": """select cast(c_custkey as int) norec, cast(280+c_custkey%40 as int) start_doy,
        cast(10+c_custkey%60 as int) end_doy from customer""",
    # daily weather at each order
    "weather": """select o_orderkey k, cast(o_orderdate as date) dt, 290e0+cast(o_custkey%20 as double) temp_k,
        285e0+cast(o_custkey%5 as double) dew_k, cast(o_orderkey%7 as double)/2e0 u, cast(o_orderkey%5 as double)/3e0 v,
        98000e0+cast(o_custkey%3000 as double) pressure, 1.5e7+o_totalprice sw, 3e6+cast(o_orderkey%1000 as double)*1e3 lw,
        2e7+o_totalprice*2e0 rad, cast(o_orderkey%11 as double)/1e3 rain_m from orders""",
    # scene listings of two sensors, named with their acquisition date
    "scenes_a": """select cast(o_orderkey as bigint) id, concat('S2_', {ymd}, '_', cast(o_orderkey as varchar(20))) name,
        cast(o_orderdate as date) dt, cast(o_custkey as bigint) tile, cast(o_custkey%7 as double)/1e1 ox from orders""",
    "scenes_b": """select cast(l_orderkey as bigint) id, cast(l_linenumber as bigint) part,
        cast(l_shipdate as date) dt, cast(o_custkey as bigint) tile, cast(l_partkey%7 as double)/1e1 ox
        from lineitem join orders on l_orderkey=o_orderkey""",
}

_SPARK = {
    "px": [str(i) for i in range(6)],
    "json": "get_json_object(props,'$.k')",
    "day": "date_add(date'2023-10-01',d)",
    "days": "lateral view explode(sequence(0,182)) as d",
    "ymd": "date_format(o_orderdate,'yyyyMMdd')",
}
_DUCK = {
    "px": [str(i) for i in range(1, 7)],
    "json": "json_extract_string(props,'$.k')",
    "day": "cast(date '2023-10-01'+cast(d as int) as date)",
    "days": "cross join (select cast(range as int) d from range(183))",
    "ymd": "strftime(o_orderdate,'%Y%m%d')",
}


def _text(name: str, words: dict) -> str:
    return VIEWS[name].format(*words["px"], **{k: v for k, v in words.items() if k != "px"})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named observation table as a lazy DataFrame."""
    text = _text(name, _SPARK)
    inputs = {}
    for other in [*TABLES, *VIEWS]:
        if other != name and re.search(rf"(from|join) {other}\b", text):
            inputs[other] = view(spark, sf_dir, other) if other in VIEWS else table(spark, sf_dir, other)
            if re.search(rf"join {other}\b", text):
                inputs[other] = shuffled(inputs[other])
            text = re.sub(rf"(from|join) {other}\b", rf"\1 {{{other}}}", text)
    return spark.sql(text, **inputs)


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the views for DuckDB."""
    todo: list[str] = []

    def visit(name: str) -> None:
        text = _text(name, _DUCK)
        for other in VIEWS:
            if other != name and re.search(rf"(from|join) {other}\b", text):
                visit(other)
        if name not in todo:
            todo.append(name)

    for n in names:
        visit(n)
    return "with recursive " + ", ".join(f"{n} as ({_text(n, _DUCK)})" for n in todo)
