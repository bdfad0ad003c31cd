"""All six parts of the priority index, on rows made here."""

import datetime as dt

import pytest

import __spark_entry__ as entry
from terraloom.functions.fixed_values import PRIORITY_WEIGHTS, RESISTANCE
from terraloom.operators import raster as rs


def test_priority_index_has_all_six_parts(spark, tmp_path):
    customers = [5, 37, 74, 111, 148]
    # order keys of pixels in the first rows; one order comes twice
    orders = [(k, customers[k % 5], float(k), "1-URGENT") for k in range(0, 400, 3)] + [(3, customers[3], 3.0, "1-URGENT")]
    items = [(k, n, (k + n) % 7, dt.date(1995 + k % 4, 5, 1)) for k, *_ in orders for n in range(1, 2 + k % 3)]
    parts = [(k, f"Brand#{k + 1}") for k in range(7)]
    for name, rows, schema in (
            ("orders", orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string"),
            ("lineitem", items, "l_orderkey long, l_linenumber int, l_partkey long, l_shipdate date"), ("part", parts, "p_partkey long, p_brand string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = [r.asDict() for r in entry.queries()["priority_index"](spark, str(tmp_path)).collect()]
    assert len({r["permeability"] for r in got}) > 1
    span = {c: (min(r[c] for r in got), max(r[c] for r in got)) for c in PRIORITY_WEIGHTS}
    for r in got:
        want = sum(w * (r[c] - span[c][0]) / (span[c][1] - span[c][0] or 1) for c, w in PRIORITY_WEIGHTS.items())
        assert r["priority_index"] == pytest.approx(want, abs=1e-4)
    assert [r["priority_rank"] for r in sorted(got, key=lambda r: (-r["priority_index"], r["q"], r["r"]))] == list(range(1, len(got) + 1))


def test_a_pixel_that_comes_twice_counts_twice(spark):
    """Pixels that carry their zone are not paired with each other."""
    px = spark.sql("select * from values (1, 4), (1, 4), (1, 3), (1, 0), (2, 0), (2, 11), (3, null) t(zid, cls)")
    got = {r.zid: r.permeability for r in rs.permeability(px, None, ["zid"]).collect()}
    assert got == {1: round(100 - (2 * RESISTANCE[4] + RESISTANCE[3]) / 3, 2), 2: 50.0, 3: 50.0}
