import hashlib
import random
import re
from collections import defaultdict

import pytest

from terraloom.llm.exact import _trim, collapse_copies

SCHEMA = "lesson_id bigint, body string, digest int, at string"


def brute(rows):
    groups = defaultdict(list)
    for i, b in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", b or "")].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("counters", [1, 3, 1000])
def test_against_brute_force(spark, counters):
    rng = random.Random(1)
    rows = [(i, rng.choice(["peta  danau", "peta danau", "peta\tdanau", "é x", "é x", "a" * 50000, f"own {i}", None, "", " "])) for i in range(300)]
    rows += [(5, "same"), (5, "same"), (None, "same"), (None, "only null"), (None, "only null")]
    got = collapse_copies(spark.createDataFrame([(*r, 7, "z") for r in rows], SCHEMA), counters).collect()
    assert sorted(((r["lesson_id"], r["keep_id"], r["group_size"], r["body_sha256"]) for r in got), key=repr) == brute(rows)
    kept = [(r["body_sha256"], r["lesson_id"], r["keep_id"]) for r in got if r["kept"]]
    assert len(kept) == len({k[0] for k in kept}) == len({r["body_sha256"] for r in got})
    assert all(a == b for _, a, b in kept)


def test_empty_table(spark):
    assert collapse_copies(spark.createDataFrame([], SCHEMA)).collect() == []


def test_trim_keeps_every_frequent_digest():
    rng = random.Random(2)
    items = [rng.choice([b"a", b"b"]) if rng.random() < 0.6 else b"%d" % rng.randrange(10**6) for _ in range(5000)]
    counts = {}
    for x in items:
        counts[x] = counts.get(x, 0) + 1
        counts = _trim(counts, 4)
    assert len(counts) <= 4 and {b"a", b"b"} <= set(counts)
