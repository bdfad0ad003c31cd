"""Physical plans: one scan per input, pruned columns, no single-task windows, hot keys split at run time."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from terraloom import scale

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["diversity_by_cell", "linear_trend", "chao1_by_cell", "effort_per_period", "spearman_trend", "richness_summary"])
def test_one_scan_of_the_facts(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    scans = len(re.findall(r"FileScan parquet \[l_", text))
    grid = 1 if name == "richness_summary" else 0  # the grid itself needs the occupied cells
    assert scans == 1 + grid


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(entry.queries()["limit_features"](spark, SF))
    assert "TakeOrderedAndProject" in text and "o_custkey" not in text
    text = plan(entry.queries()["select_by_expression"](spark, SF))
    assert "PushedFilters: [IsNotNull(c_mktsegment), IsNotNull(c_nationkey), EqualTo(c_mktsegment,BUILDING)" in text


@pytest.mark.parametrize("name", ["priority_index", "renumber", "split", "categorize", "temporal_turnover", "interpolate_linear", "slope",
                                  "spearman_matrix", "class_breaks_quantile", "ssim"])
def test_no_window_over_everything(spark, name):
    lines = plan(entry.queries()[name](spark, SF)).splitlines()
    for i, line in enumerate(lines):
        if re.search(r"\bWindow \[", line) and any("SinglePartition" in x for x in lines[i + 1:i + 4]):
            # only the per-range totals may be combined in one task
            assert "_sum" in line or "_offset" in line, line


def test_no_cartesian_products(spark):
    for name in ("nearest_point", "count_within", "lines_cross", "points_in_polygons", "nearest_scene", "tolerance_join", "block_uniformity", "minmax_normalize"):
        text = plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_adaptive_handling_splits_a_hot_key(spark):
    """Joins are plain; a key with nearly all rows is dealt to several tasks at run time, and no row is lost."""
    put = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
           "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        many = spark.range(200_000).select(F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(-1).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
        ranked = scale.average_rank(many, "v")
        assert ranked.count() == 200_000 and ranked.agg(F.max("rank")).first()[0] > 0
        got = many.join(spark.range(-1, 200_000).select(F.col("id").alias("v")), "v")
        assert len(got.collect()) == 200_000 and "skew=true" in plan(got)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", [
    "growing_days", "crop_water_need", "satisfaction_index", "eta_adjusted", "weekly_resample", "reliability_cv", "reliability_threshold", "inner_join_suffixed"])
def test_series_are_not_gathered_by_the_driver(spark, name):
    """Daily rows come from ``explode``, which Spark's estimate of a side's size does not count."""
    assert "Broadcast" not in plan(entry.queries()[name](spark, SF))


def test_seasons_of_repeated_dates(spark):
    """A start listed twice gives its days twice, one that no day has gives none."""
    from terraloom.operators.irrigation import growing_days

    daily = spark.sql("select 1 norec, date_add(date'2024-01-01', d) dt, d from (select explode(sequence(0, 9)) d) union all select null, date'2024-01-03', 0")
    dates = spark.sql("select * from values (1, 3), (1, 3), (1, 300), (2, 3), (null, 3) t(norec, start_doy)")
    got = sorted((r.norec, r.d, r.day) for r in growing_days(daily, dates, 4).collect())
    assert got == sorted([(1, 2 + k, 1 + k) for k in range(4)] * 2)


@pytest.mark.parametrize("name", ["patch_pixels", "blend_tiles"])
def test_pixels_of_patches_are_not_gathered_by_the_driver(spark, name):
    assert "Broadcast" not in plan(entry.queries()[name](spark, SF))


@pytest.mark.parametrize("name", ["minmax_normalize", "connectivity", "survey_gaps", "corridor_gaps"])
def test_cells_are_not_gathered_by_the_driver(spark, name):
    """Rings of cells come from ``explode``, parts and orders pack well in Parquet."""
    assert "Broadcast" not in plan(entry.queries()[name](spark, SF))
