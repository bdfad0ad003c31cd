import math
import random

from terraloom.llm.negatives import hard_negatives

SCHEMA = "block int, at int, patch_id bigint, bands array<float>, cover int, anchor_id int"


def brute(rows, every, positives=5, negatives=10):
    ok = [(i, [math.floor(256 * x) for x in v], c, k) for k, (i, v, c) in enumerate(rows)
          if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda i: (i is None, i or 0)
    out = []
    for i, v, c, k in ok:
        if i is None or i % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, u)), j, d, m) for j, u, d, m in ok if m != k]
        scored.sort(key=lambda s: (-s[0], key(s[1]), s[3]))
        for p, j, _, _ in [s for s in scored if s[2] == c][:positives]:
            window = [s for s in scored if s[2] != c and 30 * p <= 100 * s[0] <= 90 * p][:negatives]
            out += [(i, j, r, s[1], p, s[0]) for r, s in enumerate(window, 1)]
    return sorted(out, key=repr)


def run(spark, rows, every):
    table = spark.createDataFrame([(1, 2, i, v, c, 3) for i, v, c in rows], SCHEMA)
    got = hard_negatives(table, every)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_against_brute_force(spark, monkeypatch):
    import terraloom.llm.negatives as n

    rng = random.Random(4)
    rows = []
    for i in range(300):
        base = rng.choice([0.1, 0.2, 0.3])
        rows.append((i, [round(base + rng.gauss(0, 0.1), 2) for _ in range(12)], rng.randrange(4)))
    same = [0.25] * 12
    rows += [(1000 + i, same, i % 3) for i in range(60)]  # one vector many times: ties by id
    rows += [(7, rows[7][1], rows[7][2]), (20, rows[20][1], rows[20][2]), (None, same, 1)]  # repeated rows, a null id
    rows += [(2000, None, 1), (2020, same, None), (2040, [0.1, None], 1), (2060, [float("nan")], 1), (2080, [float("-inf")] * 12, 2)]
    rows += [(2100, [], 1), (2120, [0.3, 0.4], 2)]  # shorter vectors
    monkeypatch.setattr(n, "ROWS", 50)
    monkeypatch.setattr(n, "ANCHORS", 7)
    want = brute(rows, 20)
    assert want and run(spark, rows, 20) == want


def test_large_components_are_exact(spark):
    rng = random.Random(8)
    rows = [(i, [float(rng.randrange(1, 9)) * 2.0**18 for _ in range(6)], i % 3) for i in range(60)]
    want = brute(rows, 10)
    assert want and run(spark, rows, 10) == want


def test_nothing_to_mine(spark):
    assert run(spark, [], 10) == []
    assert run(spark, [(0, [0.5], 1)], 10) == []
    assert run(spark, [(0, [0.5], 1), (3, [0.5], 2)], 10) == []  # no positive
