"""Layers that several others build on are computed once."""

from terraloom.operators import hexgraph as hg
from terraloom.plans import jobs
from terraloom.sources.layers import LayerStore


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_layers_of_the_master_table_are_stored(spark, tmp_path, monkeypatch):
    src, out = LayerStore(spark, f"{tmp_path}/a"), LayerStore(spark, f"{tmp_path}/b")
    occ = spark.range(60).selectExpr("id rid", "concat('s', id % 4) species", "cast(2000 + id % 5 as int) yr", "'m' method", "0e0 x", "0e0 y", "id % 3 q", "id % 2 r")
    src.write_layers({"occurrences": occ, "cells": hg.build_grid(occ), "aoi": spark.range(1)})
    parts, seen = [], []
    join, gaps = hg.master_join, hg.survey_gaps
    monkeypatch.setattr(hg, "master_join", lambda base, more, *a: parts.extend([base, *[df for df, _ in more]]) or join(base, more, *a))
    monkeypatch.setattr(hg, "survey_gaps", lambda grid, rows: seen.append(rows) or gaps(grid, rows))
    made = {r.layer: r.n for r in jobs.grid_analyses(src, out, None, [], ["s1"], centrality=False).collect()}
    assert len(parts) == 6 and not any("Exchange" in plan(df) for df in parts)
    assert sorted(seen[0].columns) == ["q", "r", "species"] and "Exchange" not in plan(seen[0])
    assert made["master_occupied"] == made["diversity"] == made["chao1"] == 6 and made["occurrences"] == 60
