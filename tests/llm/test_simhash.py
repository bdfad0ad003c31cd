import itertools
import random
import re

import numpy as np
import xxhash

from terraloom.llm import simhash

SCHEMA = "fingerprint string, lesson_id bigint, body string, bucket int, table int"


def brute_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [words[i : i + k] for i in range(len(words) - k + 1)] or ([words] if words else [])
    hashes = [xxhash.xxh64(" ".join(r).encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=2):
    prints = [brute_print(t) for _, t in rows]
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(root, 2):
        if (a ^ b).bit_count() <= radius:
            root[find(a)] = find(b)
    ids = {}
    for (i, _), p in zip(rows, prints):
        ids.setdefault(find(p), []).append(i)
    return sorted([(i, f"{p:016x}", min((x for x in ids[find(p)] if x is not None), default=None)) for (i, _), p in zip(rows, prints)], key=repr)


def test_lessons_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.choice("Ab é Danau peta GIS".split()) + str(rng.randrange(60))
    rows = []
    for _ in range(120):
        ws = [word() for _ in range(rng.choice([0, 1, 2, 3, 4, 9, 60, 150]))]
        rows.append(" ".join(ws))
        for _ in range(rng.choice([0, 1, 3])):
            copy = list(ws)
            if copy:
                copy[rng.randrange(len(copy))] = word()
            rows.append(rng.choice([" ", "\n\t"]).join(copy))
    rows = list(enumerate(rows))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (None, rows[3][1]), (None, "alone with no id"), (3, rows[3][1]), (5003, "gunung " * 40_000)]
    got = simhash.near_fingerprints(spark.createDataFrame([("x", *r, 1, 2) for r in rows], SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_every_pair_within_the_radius_shares_a_table():
    for radius in (1, 2, 3):
        covering = simhash.masks(range(64), radius)
        assert len(covering) == 2 ** (radius + 1) - 1 and max(m.bit_count() for m in covering) < 64
        for bits in itertools.combinations(range(64), radius):
            d = sum(1 << b for b in bits)
            assert any(not m & d for m in covering)


def test_crowded_buckets_are_dealt_again(spark):
    """Many values that differ in few positions: buckets far above the limit, no link lost."""
    rng = np.random.default_rng(1)
    spots = rng.choice(64, 26, replace=False)
    base = rng.integers(0, 2**64, 3, dtype=np.uint64)
    flips = rng.integers(0, 2, (1500, 26)).astype(bool)
    values = [int(base[i % 3]) ^ sum(1 << int(s) for s, f in zip(spots, row) if f) for i, row in enumerate(flips)]
    values = sorted(set(values) | {v ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for v in values[::3]})
    table = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fingerprint bigint")
    edges = [(r["src"] % 2**64, r["dst"] % 2**64) for r in simhash.links(table, 2, bucket=16).collect()]
    assert all((a ^ b) and a in set(values) and b in set(values) for a, b in edges[:50])

    def parts(pairs):
        root = {v: v for v in values}

        def find(v):
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        for a, b in pairs:
            root[find(a)] = find(b)
        return {frozenset(g) for g in _groups(find)}

    def _groups(find):
        out = {}
        for v in values:
            out.setdefault(find(v), []).append(v)
        return out.values()

    near = [(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 2]
    assert near and parts(edges) == parts(near)


def test_empty_table(spark):
    assert simhash.near_fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
