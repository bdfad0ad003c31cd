"""Planar hexagon cells (pointy top, axial key ``q, r``) as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SQRT3 = 1.7320508075688772


def _near(v: Column) -> Column:
    return F.floor(v + 0.5)


def assign_cell(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Add the cell (q, r) holding the point (x, y); cube rounding of the axial position."""
    fq = (F.col(x) * (SQRT3 / 3) - F.col(y) / 3e0) / F.lit(float(size))
    fr = (F.col(y) * (2 / 3)) / F.lit(float(size))
    df = df.withColumns({"_fq": fq, "_fr": fr})
    fq, fr = F.col("_fq"), F.col("_fr")
    fs = -fq - fr
    dq, dr, ds = F.abs(_near(fq) - fq), F.abs(_near(fr) - fr), F.abs(_near(fs) - fs)
    q = F.when((dq > dr) & (dq > ds), -_near(fr) - _near(fs)).otherwise(_near(fq))
    r = F.when((dq > dr) & (dq > ds), _near(fr)).when(dr > ds, -_near(fq) - _near(fs)).otherwise(_near(fr))
    return df.withColumns({"q": q.cast("bigint"), "r": r.cast("bigint")}).drop("_fq", "_fr")


def cell_center(size: float, q: str = "q", r: str = "r") -> tuple[Column, Column]:
    return (
        (F.col(q) + F.col(r) / 2e0) * F.lit(size * SQRT3),
        F.col(r) * F.lit(size * 1.5),
    )


def cell_boundary(size: float, q: str = "q", r: str = "r") -> Column:
    """Closed ring of the six corners, counter-clockwise from the right."""
    cx, cy = cell_center(size, q, r)
    w, h = size * SQRT3 / 2, size / 2
    corners = [(w, -h), (w, h), (0.0, size), (-w, h), (-w, -h), (0.0, -size), (w, -h)]
    return F.array(*[F.struct((cx + F.lit(dx)).alias("x"), (cy + F.lit(dy)).alias("y")) for dx, dy in corners])


def grid_distance(q1: Column, r1: Column, q2: Column, r2: Column) -> Column:
    dq, dr = q1 - q2, r1 - r2
    return ((F.abs(dq) + F.abs(dr) + F.abs(dq + dr)) / 2).cast("int")


def offsets(k: int, ring_from: int = 0) -> list[tuple[int, int, int]]:
    """(dq, dr, ring) of the cells within ``k`` rings."""
    found = []
    for dq in range(-k, k + 1):
        for dr in range(-k, k + 1):
            d = (abs(dq) + abs(dr) + abs(dq + dr)) // 2
            if ring_from <= d <= k:
                found.append((dq, dr, d))
    return found


def grid_disk(df: DataFrame, k: int, ring_from: int = 0, q: str = "q", r: str = "r") -> DataFrame:
    """Each row once per cell within ``k`` rings: adds nq, nr, ring (fixed fan-out)."""
    moves = F.array(*[
        F.struct(F.lit(a).cast("bigint").alias("dq"), F.lit(b).cast("bigint").alias("dr"), F.lit(d).alias("ring"))
        for a, b, d in offsets(k, ring_from)
    ])
    return (
        df.withColumn("_m", F.explode(moves))
        .withColumns({"nq": F.col(q) + F.col("_m.dq"), "nr": F.col(r) + F.col("_m.dr"), "ring": F.col("_m.ring")})
        .drop("_m")
    )


def grid_ring(df: DataFrame, k: int) -> DataFrame:
    return grid_disk(df, k, ring_from=k)


def mean_center(cells: DataFrame, size: float) -> DataFrame:
    """Mean of the centres of the distinct cells (q, r): one row cx, cy."""
    cx, cy = cell_center(size)
    return cells.select("q", "r").distinct().agg(F.avg(cx).alias("cx"), F.avg(cy).alias("cy"))
