"""Seasons of blocks: daily rows are placed once, and weeks without values stay."""

import datetime as dt
import re

import pytest

from terraloom.operators import irrigation as ir


def series(spark):
    """Two years of block 1 with a day twice and one without date, a block without start, and its starts."""
    daily = spark.sql("""select 1 norec, case when d < 400 then 'old' else 'new' end nama, d, date_add(date'2023-01-01', d) dt, 1e0 * (d % 7) si from (select explode(sequence(0, 729)) d)
        union all select 1, 'twice', 50, date'2023-02-20', 9e0 union all select 1, 'none', 0, null, 1e0 union all select 2, 'b', 0, date'2023-02-10', 1e0""")
    return daily, spark.sql("select * from values (1, 41), (1, 60), (3, 1), (2, cast(null as int)) t(norec, start_doy)")


def test_overlapping_starts_give_their_own_days(spark):
    daily, dates = series(spark)
    got = sorted((r.norec, r.dt, r.nama == "twice", r.day) for r in ir.growing_days(daily, dates, 30).collect())
    want = []
    for year in (2023, 2024):
        for doy in (41, 60):
            first = dt.date(year, 1, 1) + dt.timedelta(doy - 1)
            want += [(1, first + dt.timedelta(k), False, k + 1) for k in range(30)]
    want.append((1, dt.date(2023, 2, 20), True, 11))
    assert got == sorted(want)
    with pytest.raises(ValueError):
        ir.growing_days(daily, dates, 366)


def test_daily_rows_of_a_season_are_placed_once(spark):
    daily, dates = series(spark)
    text = ir.weekly_resample(ir.growing_days(daily, dates), ["si"])._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2  # the days and the starts


def test_empty_weeks_stay(spark):
    daily = spark.sql("select 1 norec, 'a' nama, date_add(date'2023-01-02', d) dt, 1 day, 2e0 si from (select explode(array(0, 1, 22)) d)")
    got = [(r.week_end, r.nama, r.start_date, r.si) for r in ir.weekly_resample(daily, ["si"]).orderBy("week_end").collect()]
    sunday = dt.date(2023, 1, 8)
    assert got == [(sunday + dt.timedelta(7 * k), "a", dt.date(2023, 1, 2), 2.0 if k in (0, 3) else None) for k in range(4)]
