import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from terraloom.llm.packing import best_fit, completion, cut, fewest, pack_lessons, packing_plan

JSON = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "sequence_id string, lesson_id bigint, body string"


def first_fit_decreasing(lengths, room):
    left = []
    for n in sorted(lengths, reverse=True):
        k = next((k for k, x in enumerate(left) if x >= n), None)
        if k is None:
            left.append(room - n)
        else:
            left[k] -= n
    return len(left)


def test_packing_is_gapless_and_whole(spark):
    rng = random.Random(4)
    rows = [("s", i, " ".join("danau peta grid sawah"[rng.randrange(18) :] for _ in range(rng.choice([1, 3, 9, 40])))) for i in range(200)]
    rows += [("s", 300, None), ("s", 301, ""), ("s", None, "peta"), ("s", 5, "twice"), ("s", 5, "twice"), ("s", 302, "air " * 5000)] + [("s", 400 + i, "same text") for i in range(90)]
    got = pack_lessons(spark.createDataFrame(rows, SCHEMA), JSON, room=64).collect()
    tool = Tokenizer.from_file(JSON)
    want = defaultdict(int)
    for _, i, t in rows:
        ids = np.array([*tool.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (s, n) in enumerate(cut(len(ids), 64)):
            want[i, k, s, n, zlib.crc32(ids[s : s + n])] += 1
    have = defaultdict(int)
    bins = defaultdict(list)
    for r in got:
        have[r["lesson_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert have == want
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= first_fit_decreasing([r["length"] for r in got], 64)


def test_empty_table(spark):
    assert pack_lessons(spark.createDataFrame([], SCHEMA), JSON).collect() == []


@pytest.mark.parametrize("seed", range(30))
def test_completion_has_least_waste(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 40): rng.randrange(1, 3) for _ in range(6)}
    items = [s for s, n in counts.items() for _ in range(n)]
    room = rng.randrange(1, 90)
    best = max(sum(c) for k in range(len(items) + 1) for c in combinations(items, k) if sum(c) <= room)
    got = completion(sorted(counts), counts, room)
    assert sum(got) == best and all(got.count(s) <= counts[s] for s in got)


def test_cut():
    assert cut(1, 8) == [(0, 1)] and cut(8, 8) == [(0, 8)] and cut(9, 8) == [(0, 1), (1, 8)] and cut(24, 8) == [(0, 8), (8, 8), (16, 8)]


def test_plan_places_every_piece():
    histogram = {5: 7, 3: 100, 60: 4, 64 - 5: 3, 1: 50}
    plan = packing_plan(histogram, 64)
    used = defaultdict(int)
    for times, lengths in plan:
        assert sum(lengths) <= 64
        for s in lengths:
            used[s] += times
    assert used == histogram


def test_many_empty_lessons_fill_a_sequence(spark):
    """A sequence of 2048 tokens takes more pieces than calls may be nested."""
    assert packing_plan({1: 5000}, 2048) == [(2, [1] * 2048), (1, [1] * 904)]
    assert packing_plan({2: 1024}, 2048) == [(1, [2] * 1024)]
    rows = [("s", i, None if i % 2 else "") for i in range(5000)] + [("s", 5000, "danau peta")]
    got = pack_lessons(spark.createDataFrame(rows, SCHEMA), JSON).collect()
    assert len(got) == 5001 and len({r["sequence_id"] for r in got}) == 3
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 5001


def best_fit_decreasing(lengths, room):
    left = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k in range(len(left)) if left[k] >= n]
        if fit:
            left[min(fit, key=left.__getitem__)] -= n
        else:
            left.append(room - n)
    return len(left)


def exhaustive(lengths, room):
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def go(i, left):
        nonlocal best
        if len(left) >= best:
            return
        if i == len(lengths):
            best = len(left)
            return
        for k in {x: k for k, x in enumerate(left) if x >= lengths[i]}.values():
            go(i + 1, [*left[:k], left[k] - lengths[i], *left[k + 1 :]])
        go(i + 1, [*left, room - lengths[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_search_finds_the_fewest_sequences(seed):
    rng = random.Random(seed)
    room = rng.choice([20, 50, 100])
    lengths = [rng.randrange(1, room if seed % 3 else room * 2 // 3) for _ in range(rng.randrange(1, 12))]
    plan = packing_plan(Counter(lengths), room)
    assert Counter(s for times, pieces in plan for s in pieces * times) == Counter(lengths)
    assert fewest(Counter(lengths), room) <= exhaustive(lengths, room) == sum(t for t, _ in plan)


@pytest.mark.parametrize("low, high, n, seed", [(*x, s) for x in ((500, 900, 60), (300, 1100, 300), (1, 2047, 2000)) for s in range(4)])
def test_never_more_than_best_fit_decreasing(low, high, n, seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(low, high) for _ in range(n)]
    decreasing = best_fit_decreasing(lengths, 2048)
    assert sum(t for t, _ in best_fit(Counter(lengths), 2048)) == decreasing
    assert fewest(Counter(lengths), 2048) <= sum(t for t, _ in packing_plan(Counter(lengths), 2048)) <= decreasing


def test_many_lengths_are_searched_like_few():
    """Over 64 different lengths the first way down had no other fillings to come back to (one sequence more)."""
    histogram = {s: 1 for s in random.Random(15).sample(range(1, 256), 120)}
    plan = packing_plan(histogram, 256)
    assert Counter(s for times, pieces in plan for s in pieces * times) == Counter(histogram)
    assert sum(t for t, _ in plan) == fewest(histogram, 256) == 59
