import random
import re

import pytest
from pyspark.sql import functions as F

from terraloom.llm.substring import remove_repeats

SCHEMA = "lesson_id bigint, body string, kept string, n_words int"


def brute(rows, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", b or "")) for i, b, *_ in rows]
    low = {}
    big = 1 << 62
    for i, ws in words:
        for s in range(len(ws) - window + 1):
            k = tuple(ws[s : s + window])
            low[k] = min(low.get(k, big), big if i is None else i)
    out = []
    for i, ws in words:
        gone = set()
        for s in range(len(ws) - window + 1):
            if low[tuple(ws[s : s + window])] < (big if i is None else i):
                gone |= set(range(s, s + window))
        out.append((i, len(ws), len(gone), " ".join(x for p, x in enumerate(ws) if p not in gone)))
    return sorted(out, key=repr)


def run(spark, rows, window, **sizes):
    got = remove_repeats(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), window, **sizes).collect()
    for r in got:
        assert sum(x["last"] - x["first"] + 1 for x in r["repeats"]) == r["n_removed"]
    return sorted(((r["lesson_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=repr)


@pytest.mark.parametrize("window", [13, 12, 5, 2])
def test_against_brute_force(spark, window):
    rng = random.Random(window)
    vocabulary = ["danau", "peta", "é", "grid", "x", "sawah", "jalan,"]
    passage = [[rng.choice(vocabulary) + str(rng.randrange(9)) for _ in range(rng.randrange(window, 3 * window))] for _ in range(6)]
    rows = []
    for i in range(120):
        ws = []
        for _ in range(rng.randrange(4)):
            ws += [rng.choice(vocabulary) for _ in range(rng.randrange(9))] + rng.choice(passage)
        rows.append((i % 110, rng.choice([" ", "\n", "\t  "]).join(ws)))
    rows += [(None, rows[5][1]), (None, rows[5][1]), (500, None), (501, ""), (502, " \n\t"), (503, "x " * 5000), (504, "a b " * 40)]
    assert run(spark, rows, window, group_bytes=4000, bucket_bytes=4000) == brute(rows, window)


def test_one_id_is_spread_over_groups(spark):
    rows = [(None, f"lesson {i} " + "has the same words as the others " * 3) for i in range(60)] + [(1, "has the same words as the others " * 3)]
    assert run(spark, rows, 5, group_bytes=400) == brute(rows, 5)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        got = remove_repeats(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), 5, group_bytes=400)
        held = [r["count"] for r in got.where("lesson_id is null").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set(name, before)
    assert sum(held) == 60 and max(held) <= 45


def test_empty_table(spark):
    assert run(spark, [], 13) == []


def test_window_is_checked(spark):
    with pytest.raises(ValueError):
        remove_repeats(spark.createDataFrame([], SCHEMA), 1)
