"""Pieces of DuckDB text shared by the oracles."""

from __future__ import annotations

from terraloom.functions.hexgrid import SQRT3, offsets
from terraloom.sources.fixtures import with_views

SIZE = 0.2
YEARS = list(range(1995, 2003))
YEAR_TESTS = {**{str(y): f"yr={y}" for y in YEARS}, "other": f"yr not in ({','.join(map(str, YEARS))})"}


def d(v: float) -> str:
    """A double literal DuckDB does not read as DECIMAL."""
    return f"cast({v!r} as double)"


def hexed(view: str, size: float = SIZE) -> str:
    """CTE ``<view>_c``: the view with its hexagon key (q, r)."""
    return f"""{view}_f as (select *, (x*{d(SQRT3 / 3)}-y/3e0)/{d(float(size))} fq, (y*{d(2 / 3)})/{d(float(size))} fr from {view}),
    {view}_n as (select *, floor(fq+5e-1) nq, floor(fr+5e-1) nr, floor(-fq-fr+5e-1) ns from {view}_f),
    {view}_d as (select *, abs(nq-fq) dq, abs(nr-fr) dr, abs(ns-(-fq-fr)) ds from {view}_n),
    {view}_c as (select * exclude(fq,fr,nq,nr,ns,dq,dr,ds),
        cast(case when dq>dr and dq>ds then -nr-ns else nq end as bigint) q,
        cast(case when dq>dr and dq>ds then nr when dr>ds then -nq-ns else nr end as bigint) r from {view}_d)"""


def disk(k: int, ring_from: int = 0) -> str:
    """Inline table of hexagon offsets (dq, dr, ring)."""
    return "(values " + ",".join(f"({a},{b},{g})" for a, b, g in offsets(k, ring_from)) + ") o(dq,dr,ring)"


def occ_cells(size: float = SIZE) -> str:
    """occ_c plus oc (occupied cells with richness)."""
    return with_views("occ") + ", " + hexed("occ", size) + """,
    oc as (select q, r, count(distinct species) richness from occ_c group by 1,2)"""


def grid(k: int = 2) -> str:
    return f", grid as (select distinct q+dq q, r+dr r from oc cross join {disk(k)})"


SLOPE = """case when count(*)>=2 then cast(count(*)*sum(cast(yr as bigint)*sp)-sum(cast(yr as bigint))*sum(sp) as double)
    /nullif(cast(count(*)*sum(cast(yr as bigint)*yr)-sum(cast(yr as bigint))*sum(cast(yr as bigint)) as double),0) else 0e0 end"""


def trend(slope: str, n: str, default: str) -> str:
    return (f"case when {n}<2 then '{default}' when {slope}>{d(0.01)} then 'Increasing' "
            f"when {slope}<{d(-0.01)} then 'Decreasing' else 'Stable' end")
