"""Neighbourhood, corridor and gap layers over a hexagon grid.

Every ring lookup is an equi-join on the neighbour's key after a fixed fan-out of the
distinct cells; occurrence rows are reduced to cells before the fan-out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terraloom.functions.hexgrid import grid_disk
from terraloom.functions.scalars import classify_tier
from terraloom.scale import shuffled

CELL = ["q", "r"]


def occupied_cells(occ: DataFrame) -> DataFrame:
    """Cells with records and their species count."""
    return occ.select(*CELL, "species").distinct().groupBy(*CELL).agg(F.count("species").alias("richness"))


def build_grid(occ: DataFrame, k: int = 2) -> DataFrame:
    """Distinct cells within ``k`` rings of any record."""
    return grid_disk(occ.select(*CELL).distinct(), k).select(F.col("nq").alias("q"), F.col("nr").alias("r")).distinct()


def _at(df: DataFrame) -> DataFrame:
    """Rename the cell key to the neighbour key."""
    return df.withColumnsRenamed({"q": "nq", "r": "nr"})


def adjacency(grid: DataFrame) -> DataFrame:
    """Directed edges (q, r, nq, nr) between grid cells at distance one."""
    return grid_disk(grid.select(*CELL), 1, ring_from=1).drop("ring").join(shuffled(_at(grid.select(*CELL))), ["nq", "nr"], "left_semi").select(
        "q", "r", "nq", "nr")


def ring_stats(cells: DataFrame, occ_cells: DataFrame, k: int, aggs: list[Column]) -> DataFrame:
    """Aggregate the occupied cells found within 1..k rings of each cell."""
    found = grid_disk(cells.select(*CELL), k, ring_from=1).join(shuffled(_at(occ_cells)), ["nq", "nr"])
    return found.groupBy(*CELL).agg(*aggs)


def connectivity(grid: DataFrame, occ: DataFrame) -> DataFrame:
    """K1 (grid cells only) and K2 occupied neighbours, species reachable, score and cell type."""
    cells = occ.select(*CELL, "species").distinct()
    occupied = cells.select(*CELL).distinct()
    in_grid = grid.select(*CELL).withColumn("in_grid", F.lit(1))
    flagged = occupied.join(shuffled(in_grid), CELL, "left")
    near = ring_stats(grid, flagged, 2, [
        F.count_if((F.col("ring") == 1) & F.col("in_grid").isNotNull()).alias("k1"),
        F.count("*").alias("k2"),
    ])
    # species sets are bounded by the species list; distinct pairs are formed before counting
    reach = grid_disk(grid.select(*CELL), 2, ring_from=1).join(shuffled(_at(cells)), ["nq", "nr"]).select(*CELL, "species").distinct(
    ).groupBy(*CELL).agg(F.count("species").alias("species_k2"))
    out = (
        grid.select(*CELL).join(shuffled(occupied.withColumn("occupied", F.lit(1))), CELL, "left")
        .join(shuffled(near), CELL, "left").join(shuffled(reach), CELL, "left").fillna(0, ["occupied", "k1", "k2", "species_k2"])
    )
    return out.withColumns({
        "eco_score": 2 * F.col("k1") + F.col("k2"),
        "cell_type": F.when(F.col("occupied") == 1, "Occupied").otherwise("Empty"),
    })


def empty_cells(grid: DataFrame, occ_cells: DataFrame) -> DataFrame:
    return grid.select(*CELL).join(shuffled(occ_cells.select(*CELL)), CELL, "left_anti")


def corridor_gaps(grid: DataFrame, occ: DataFrame, centrality: DataFrame | None = None) -> DataFrame:
    """Empty cells as stepping stones; ``centrality`` (q, r, betweenness) defaults to zero."""
    oc = occupied_cells(occ)
    in_grid = oc.join(shuffled(grid.select(*CELL).withColumn("in_grid", F.lit(1))), CELL, "left")
    empty = empty_cells(grid, oc)
    ring = F.col("ring")
    near = ring_stats(empty, in_grid, 3, [
        F.count_if((ring == 1) & F.col("in_grid").isNotNull()).alias("k1"),
        F.sum(F.when(ring <= 2, F.col("richness")).otherwise(0)).alias("k2_richness"),
        F.min(ring).alias("dist"),
    ])
    out = empty.join(shuffled(near), CELL, "left").fillna(0, ["k1", "k2_richness"]).fillna(-1, ["dist"])
    if centrality is None:
        out = out.withColumn("betweenness", F.lit(0e0))
    else:
        out = out.join(shuffled(centrality), CELL, "left").fillna(0.0, ["betweenness"])
    out = out.withColumn("_s", F.col("k1") * 3 + F.col("k2_richness") * 0.5 + F.col("betweenness") * 10)
    return out.withColumns({
        "candidate": (F.col("k1") >= 2).cast("int"),
        "connects_priority_cells": F.lit(0),
        "score": F.round("_s", 2),
        "tier": classify_tier(F.col("_s"), [5, 2], ["High", "Medium", "Low"]),
        "betweenness": F.round("betweenness", 6),
    }).drop("_s")


def isolation_risk(grid: DataFrame, occ: DataFrame, priority: DataFrame) -> DataFrame:
    """Occupied cells: direct neighbours, gaps, and cells reached only through a gap."""
    oc = occupied_cells(occ)
    flags = grid.select(*CELL).join(shuffled(oc.select(*CELL, F.lit(True).alias("occ"))), CELL, "left")
    first = grid_disk(oc.select(*CELL), 1, ring_from=1).join(shuffled(_at(flags)), ["nq", "nr"])
    direct = first.groupBy(*CELL).agg(
        F.count_if("occ").alias("direct"), F.count_if(F.col("occ").isNull()).alias("gaps"))
    gaps = first.where("occ is null").select(*CELL, F.col("nq").alias("gq"), F.col("nr").alias("gr"))
    second = (
        grid_disk(gaps, 1, ring_from=1, q="gq", r="gr")
        .select(*CELL, "nq", "nr").distinct()
        .where("not (nq = q and nr = r)")
        .join(shuffled(_at(oc.select(*CELL))), ["nq", "nr"], "left_semi")
        .join(shuffled(first.where("occ").select(*CELL, "nq", "nr")), [*CELL, "nq", "nr"], "left_anti")
        .groupBy(*CELL).agg(F.count("*").alias("extra"))
    )
    return (
        oc.join(shuffled(direct), CELL, "left").join(shuffled(second), CELL, "left").fillna(0, ["direct", "gaps", "extra"])
        .withColumn("total", F.col("direct") + F.col("extra"))
        .join(shuffled(priority.select(*CELL, "priority_index", "tier")), CELL, "left")
        .fillna({"priority_index": 0.0, "tier": "LOW"})
    )


def survey_gaps(grid: DataFrame, occ: DataFrame) -> DataFrame:
    """Empty cells by survey need; ``dist_km`` is a ring count (1..5, -1 beyond)."""
    oc = occupied_cells(occ)
    empty = empty_cells(grid, oc)
    ring, rich = F.col("ring"), F.col("richness")
    inside = oc.join(shuffled(grid.select(*CELL)), CELL, "left_semi")
    near = ring_stats(empty, inside, 2, [
        F.count_if(ring == 1).alias("k1"), F.count("*").alias("k2"),
        F.sum(F.when(ring == 1, rich).otherwise(0)).alias("k1_richness"),
        F.sum(rich).alias("k2_richness"),
    ])
    dist = ring_stats(empty, oc.select(*CELL), 5, [F.min(ring).alias("dist_km")])
    out = empty.join(shuffled(near), CELL, "left").join(shuffled(dist), CELL, "left").fillna(
        0, ["k1", "k2", "k1_richness", "k2_richness"]).fillna(-1, ["dist_km"])
    cand = (F.col("k1") >= 2).cast("int")
    score = F.col("k1_richness") * 2 + F.col("k2_richness") * 0.5 + cand * 10
    return out.withColumns({
        "candidate": cand, "score": F.round(score, 2),
        "survey_priority": classify_tier(score, [10, 3], ["High", "Medium", "Low"]),
    })


def survey_targets(priority: DataFrame, completeness: DataFrame, gaps: DataFrame) -> DataFrame:
    """Under-sampled priority cells and high-value gaps, labelled."""
    under = (
        priority.join(shuffled(completeness), CELL)
        .where(F.col("tier").isin("CRITICAL", "HIGH") & (F.col("completeness_pct") < 80) & (F.col("years_surveyed") < 3))
        .select(*CELL, F.lit("undersampled").alias("reason"))
    )
    high = gaps.where("survey_priority = 'High' and candidate = 1 and k1_richness > 5").select(
        *CELL, F.lit("high_value_gap").alias("reason"))
    return under.unionByName(high)


def master_join(base: DataFrame, parts: list[tuple[DataFrame, str]], on=CELL) -> DataFrame:
    """Chained left joins on the cell; a part with suffix '' loses columns the base already has,
    others keep them under their suffix."""
    for part, suffix in parts:
        clash = [c for c in part.columns if c in base.columns and c not in on]
        part = part.drop(*clash) if suffix == "" else part.withColumnsRenamed({c: c + suffix for c in clash})
        base = base.join(shuffled(part), list(on), "left")
    return base


def hexbin(points: DataFrame) -> DataFrame:
    """Point count per cell that holds any."""
    return points.groupBy(*CELL).agg(F.count("*").alias("n"))
