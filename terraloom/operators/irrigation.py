"""Crop-water need, satisfaction, uniformity and reliability of irrigation blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from terraloom.functions.fixed_values import KC_DAYS
from terraloom.functions.scalars import eta_adjusted, iso_week_key, kc_on, satisfaction_index, week_key
from terraloom.scale import shuffled


def growing_days(daily: DataFrame, dates: DataFrame, days: int = KC_DAYS) -> DataFrame:
    """Daily rows of each block in the ``days`` from every date whose day of year is its start.

    Daily rows are placed once, by block; the latest start up to a row is carried along the
    block's days, so no start is turned into single dates.  ``days`` must be below 366: a
    day of year does not come again within a season.
    """
    if days > 365:
        raise ValueError(f"seasons of {days} days overlap")
    both = daily.join(shuffled(dates.select("norec", "start_doy")), "norec")
    number = F.datediff("dt", F.lit("1970-01-01").cast("date"))
    until = W.partitionBy("norec", "start_doy").orderBy(number).rangeBetween(W.unboundedPreceding, W.currentRow)
    start = F.max(F.when(F.dayofyear("dt") == F.col("start_doy"), number)).over(until)
    return both.withColumn("day", number - start + 1).where(F.col("day") <= days).select("norec", "dt", *[c for c in daily.columns if c not in ("norec", "dt")], "day")


def crop_water_need(daily: DataFrame, dates: DataFrame) -> DataFrame:
    """ET0 times the crop coefficient of the day after planting."""
    return growing_days(daily, dates).withColumn("kc", kc_on(F.col("day"))).withColumn("cwr", F.col("et0") * F.col("kc"))


def daily_satisfaction(daily: DataFrame, dates: DataFrame, floor_zero: bool = True) -> DataFrame:
    need = crop_water_need(daily, dates)
    return need.withColumn("si", satisfaction_index(F.col("eta"), F.col("cwr"), floor_zero))


def weekly_si(si: DataFrame) -> DataFrame:
    """Mean index and first date per block and Sunday-started week."""
    return si.groupBy("norec", week_key(F.col("dt")).alias("year_week")).agg(
        F.avg("si").alias("si"), F.min("dt").alias("dt"))


def weekly_resample(si: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Means per block and week ending Sunday, with the first season's start and end date of the block; empty weeks inside the span stay as nulls."""
    sunday = F.next_day(F.date_sub("dt", 1), "SUN")
    weekly = si.groupBy("norec", sunday.alias("week_end")).agg(
        *[F.avg(c).alias(c) for c in cols],
        F.min_by("nama", "dt").alias("_nama"), F.min_by(F.date_sub("dt", F.col("day") - 1), "dt").alias("_start"))
    per = W.partitionBy("norec").orderBy("week_end")
    filled = weekly.withColumns({"nama": F.first("_nama").over(per), "start_date": F.first("_start").over(per), "_next": F.lead("week_end").over(per)})
    # a week brings the empty weeks before the next one
    weeks = F.expr("sequence(week_end, coalesce(date_sub(_next, 7), week_end), interval 7 days)")
    out = filled.withColumn("_week", F.explode(weeks)).select(
        "norec", "nama", "start_date", F.col("_week").alias("week_end"), *[F.when(F.col("_week") == F.col("week_end"), F.col(c)).alias(c) for c in cols])
    w = F.col("week_end")
    return out.select(
        "norec", "nama", w, F.year(w).alias("year"), F.month(w).alias("month"), F.day(w).alias("day"),
        F.weekofyear(w).alias("week_of_year"), iso_week_key(w).alias("year_week"),
        F.date_format(w, "MM/dd/yyyy").alias("date_new"), "start_date", F.date_add("start_date", KC_DAYS - 1).alias("end_date"), *[F.round(c, 4).alias(c) for c in cols])


def _spread(std: Column, mean: Column) -> Column:
    v = F.when((mean == 0) & (std != 0), 0e0).otherwise(F.coalesce(1 - F.try_divide(std, mean), F.lit(1e0)))
    return F.least(F.greatest(v, F.lit(0e0)), F.lit(1e0))


def _stats(count: str, *extra: Column) -> list[Column]:
    return [
        F.round(F.avg("si"), 4).alias("mean_si"), F.round(F.stddev_samp("si"), 4).alias("std_si"),
        F.count("si").alias(count), *extra]


def weekly_uniformity(weekly: DataFrame) -> DataFrame:
    """Spread of the index over blocks in each week, from statistics rounded first."""
    w = weekly.groupBy("year_week").agg(*_stats("block_count"))
    return w.withColumns({
        "cv_pct": F.try_divide(F.col("std_si"), F.col("mean_si")) * 100,
        "uniformity": _spread(F.col("std_si"), F.col("mean_si")),
    })


def _min_max() -> list[Column]:
    return [F.round(F.min("si"), 4).alias("min_si"), F.round(F.max("si"), 4).alias("max_si")]


def block_uniformity(weekly: DataFrame) -> DataFrame:
    """Deviation of each block's mean from the overall mean."""
    overall = weekly.agg(F.avg("si")).scalar()
    b = weekly.groupBy("norec").agg(*_stats("week_count", *_min_max())).withColumn("_all", overall)
    dev = F.abs(F.col("mean_si") - F.col("_all"))
    return b.withColumns({"deviation": dev, "uniformity": _spread(dev, F.col("_all"))}).drop("_all")


def reliability_threshold(weekly: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of a block's weeks above the threshold."""
    above = F.count_if(F.col("si") > threshold).alias("weeks_above")
    b = weekly.groupBy("norec").agg(*_stats("total_weeks", *_min_max(), above))
    share = F.try_divide(F.col("weeks_above").cast("double"), F.col("total_weeks").cast("double"))
    return b.withColumn("reliability", F.least(F.greatest(share, F.lit(0e0)), F.lit(1e0)))


def reliability_cv(weekly: DataFrame) -> DataFrame:
    """One minus the coefficient of variation of a block's weeks."""
    b = weekly.groupBy("norec").agg(*_stats("week_count", *_min_max()))
    return b.withColumns({
        "cv_pct": F.try_divide(F.col("std_si"), F.col("mean_si")) * 100,
        "reliability": _spread(F.col("std_si"), F.col("mean_si")),
    })


def performance_summary(weekly: DataFrame, uniformity_target: float = 0.85, reliability_target: float = 0.75) -> DataFrame:
    """One row: overall mean, ranges and counts above the targets."""
    def part(df: DataFrame, col: str, name: str, target: float | None) -> DataFrame:
        aggs = [F.avg(col).alias(f"{name}_mean"), F.min(col).alias(f"{name}_min"), F.max(col).alias(f"{name}_max")]
        if target is not None:
            aggs += [F.count_if(F.col(col) > target).alias(f"{name}_above"), F.count("*").alias(f"{name}_n")]
        return df.agg(F.struct(*aggs))

    one = weekly.agg(F.avg("si").alias("overall_mean"))
    return one.withColumns({
        "w": part(weekly_uniformity(weekly), "uniformity", "week", uniformity_target).scalar(),
        "b": part(block_uniformity(weekly), "uniformity", "block", None).scalar(),
        "r": part(reliability_threshold(weekly), "reliability", "reliability", reliability_target).scalar(),
    }).select("overall_mean", "w.*", "b.*", "r.*")


def with_adjusted_eta(df: DataFrame) -> DataFrame:
    return df.withColumn("eta_adjusted", eta_adjusted(F.col("eta"), F.col("si"), F.col("cwr")))


def block_map(uniformity: DataFrame, reliability: DataFrame, zones: DataFrame) -> DataFrame:
    """Results joined to the block geometry for mapping."""
    u = uniformity.select("norec", "mean_si", "uniformity")
    return u.join(shuffled(reliability.select("norec", "reliability")), "norec").join(shuffled(zones), "norec")
