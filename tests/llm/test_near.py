import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from terraloom.llm import near
from terraloom.llm.near import aligned, near_copies, shingles, similarity

SCHEMA = "node string, lesson_id bigint, body string, class_id int"


def brute_shingles(text, k=5):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)] or ([tuple(ws)] if ws else [])
    seen, out = Counter(), []
    for r in runs:
        out.append((r, seen[r]))
        seen[r] += 1
    return out


def brute_similarity(a, b):
    if not a or not b:
        return 0
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1] / (len(a) + len(b) - row[-1])


def brute_classes(rows, least=0.8):
    texts = sorted({r[1] or "" for r in rows})
    sh = {t: brute_shingles(t) for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if len(set(sh[a]) & set(sh[b])) >= 0.5 * len(sh[a]) and brute_similarity(sh[a], sh[b]) >= least:
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for i, t in rows:
        ids[find(t or "")].append(i)
    return sorted(((i, min((x for x in c if x is not None), default=None), len(c)) for c in ids.values() for i in c), key=repr)


def lessons(rng, n):
    word = lambda: rng.choice("ab é danau peta".split()) + str(rng.randrange(300))
    rows, common = [], [word() for _ in range(40)]
    for i in range(n):
        ws = [word() for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 9, 30, 80, 150]))]
        if rng.random() < 0.3:
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = common
        rows.append(" ".join(ws))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            copy = list(ws)
            for _ in range(rng.randrange(4)):
                if copy:
                    k = rng.randrange(len(copy))
                    copy[k : k + rng.randrange(3)] = [word() for _ in range(rng.randrange(3))]
            rows.append(rng.choice([" ", "\n"]).join(copy))
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = lessons(rng, 60)
    origin = ["w%d" % rng.randrange(10**6) for _ in range(120)]
    for i in range(80):  # a large group around one origin
        ws = list(origin)
        ws[rng.randrange(len(ws))] = f"new{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(ws)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (None, rows[3][1]), (None, "only one here with no id at all"), (7, rows[3][1]), (7, rows[3][1]), (2003, "long " * 20000)]
    got = near_copies(spark.createDataFrame([("x", *r, 1) for r in rows], SCHEMA)).collect()
    assert sorted(((r["lesson_id"], r["class_id"], r["class_size"]) for r in got), key=repr) == brute_classes(rows)
    kept = [r for r in got if r["kept"]]
    assert all(r["lesson_id"] == r["class_id"] for r in kept)
    assert len(kept) == sum(round(x) for x in [sum(1 / r["class_size"] for r in got)])


def test_loosely_linked_group(spark):
    """Copies of which only some pairs are links: nearly every lesson must still be in its class."""
    rng = random.Random(6)
    origin = ["w%d" % rng.randrange(10**6) for _ in range(120)]
    rows = []
    for i in range(80):
        ws = list(origin)
        for _ in range(2):
            ws[rng.randrange(len(ws))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    want = {i: c for i, c, _ in brute_classes(rows)}
    got = {r["lesson_id"]: r["class_id"] for r in near_copies(spark.createDataFrame([("x", *r, 1) for r in rows], SCHEMA)).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.9 * len(want)
    assert all(want[i] == want[got[i]] for i in want)  # nothing is joined without a link


def test_one_bridging_link_in_a_large_bucket(spark):
    """Two families in the same buckets that one link joins, and a text that is linked to one member only.

    Without random rounds, so that chance cannot find the links.
    """
    rng = random.Random(11)
    origin = ["w%d" % rng.randrange(10**6) for _ in range(200)]

    def changed(base, *at):
        ws = list(base)
        for k in at:
            ws[k] = f"new{rng.randrange(10**9)}"
        return ws

    other = changed(origin, 10, 20, 30, 40)  # four changes apart are a link, five are none
    texts = [changed(base, rng.randrange(60, 190)) for base in (origin, other) for _ in range(600)]
    bridge = changed(origin, 140, 150)
    texts += [bridge, bridge[:60], [*other[:60], *bridge[60:]]]
    single = changed(texts[0], 46, 52, 195, 199)
    texts.append(single)
    rows = [("x", i, " ".join(ws), 1) for i, ws in enumerate(texts)]
    got = Counter(r["class_id"] for r in near_copies(spark.createDataFrame(rows, SCHEMA), idle_rounds=0).collect())
    assert got == {0: 1203, 1201: 1}


def test_empty_table(spark):
    assert near_copies(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_near_copies(spark):
    rows = [("x", i, f"lesson {i} on its own", 1) for i in range(5)] + [("x", 9, None, 1)]
    assert all(r["class_size"] == 1 and r["kept"] for r in near_copies(spark.createDataFrame(rows, SCHEMA)).collect())


def test_alignment_keeps_order():
    rng = random.Random(3)
    for _ in range(200):
        a = rng.sample(range(40), rng.randrange(1, 30))
        b = [x for x in a if rng.random() < 0.8] + rng.sample(range(40, 60), 3)
        if rng.random() < 0.5:
            rng.shuffle(b)
        best = brute_similarity(a, b)
        common = best * (len(a) + len(b)) / (1 + best)
        assert aligned(np.array(a), np.array(b), 99) == round(common)
        want = best if best >= 0.8 else 0
        got = similarity(np.array(a), np.array(b), 0.8)
        assert got == pytest.approx(best) if want else got < 0.8


def test_shingles_are_labelled():
    texts = ["a b c d e a b c d e a b c d e", "a b", None, "", "a b c d e"]
    labels, offsets = shingles(pa.array(texts), 5)
    got = [len(set(labels[a:b].tolist())) for a, b in zip(offsets, offsets[1:])]
    assert got == [11, 1, 0, 0, 1] and np.diff(offsets).tolist() == [11, 1, 0, 0, 1]
    assert labels[offsets[4]] == labels[0]


def classes_of(spark, texts, **settings):
    got = near_copies(spark.createDataFrame([("x", i, t, 1) for i, t in enumerate(texts)], SCHEMA), **settings).collect()
    return {r["lesson_id"]: r["class_id"] for r in got}


def test_links_at_the_limit_that_share_no_band(spark):
    """40 of 50 shingles in common; none of the 16 bands of these pairs agrees."""
    texts = []
    for i in (4707, 60652, 84168):
        ws = [f"w{i}x{j}" for j in range(49)]
        texts += [" ".join(ws), " ".join([*ws[:20], f"n{i}", *ws[21:]])]
    assert classes_of(spark, texts) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


@pytest.mark.parametrize("seed", [3, 4])
def test_bands_do_not_change_the_classes(spark, seed):
    rng = random.Random(seed)
    rows = lessons(rng, 60)
    want = {i: c for i, c, _ in brute_classes(rows)}
    assert classes_of(spark, [t for _, t in rows], bands=1, picks=9) == want


def test_links_in_a_large_bucket_that_few_are_left_of(spark):
    """All share a passage and a band, but only three pairs have a link."""
    passage = [f"p{j}" for j in range(204)]
    ends = [[f"e{i}x{j}" for j in range(40)] for i in range(46)]
    texts = [" ".join(passage + e) for e in ends]
    texts += [" ".join([*passage, *e[:20], f"n{i}", *e[21:]]) for i, e in enumerate(ends[:6])]
    want = {i: i for i in range(46)} | {46 + i: i for i in range(6)}
    for settings in ({}, {"bands": 1, "picks": 1}):
        assert classes_of(spark, texts, least=0.9, **settings) == want


def test_classes_that_fill_lots(spark, monkeypatch):
    """Lots of a few shingles, a large class over several of them, and one pair that no band finds."""
    monkeypatch.setattr(near, "CLASS_LOT", 200)
    rng = random.Random(9)
    ws = [f"o{j}" for j in range(120)]
    texts = []
    for _ in range(50):
        copy = list(ws)
        copy[rng.randrange(120)] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    pairs = [[f"w{i}x{j}" for j in range(49)] for i in (4707, 60652)]
    for i, p in zip((4707, 60652), pairs):
        texts += [" ".join(p), " ".join([*p[:20], f"n{i}", *p[21:]])]
    assert Counter(classes_of(spark, texts).values()) == {0: 50, 50: 2, 52: 2}


def test_texts_that_can_have_no_link_are_placed_once(spark, monkeypatch):
    """All share a passage; only the texts of the one pair with a link are kept for the searches."""
    kept, real = [], near.materialize

    def keep(df):
        made = real(df)
        if "body" in made.columns:
            kept.append(made.count())
        return made

    monkeypatch.setattr(near, "materialize", keep)
    passage = [f"p{j}" for j in range(60)]
    texts = [" ".join([*passage, *[f"e{i}x{j}" for j in range(100)]]) for i in range(40)]
    texts.append(texts[3].replace("e3x50", "new"))
    assert classes_of(spark, [*texts, texts[5]]) == {i: i for i in range(40)} | {40: 3, 41: 5}
    assert kept == [2]


@pytest.mark.parametrize("seed", [5, 6])
def test_linked_nodes_share_a_bucket(spark, seed, monkeypatch):
    monkeypatch.setattr(near, "CLASS_LOT", 500)
    rng = random.Random(seed)
    texts = sorted({t for _, t in lessons(rng, 50)})
    rows = spark.createDataFrame([(bytes([i % 256, i // 256]), t) for i, t in enumerate(texts)], "node binary, body string")
    got = {r["body"]: set(r["buckets"]) for r in near._linked_nodes(rows.unionByName(rows), 5, 0.8, 4, 3).collect()}
    sh = {t: brute_shingles(t) for t in texts}
    linked = [(a, b) for i, a in enumerate(texts) for b in texts[:i] if brute_similarity(sh[a], sh[b]) >= 0.8]
    assert linked and all(got[a] & got[b] for a, b in linked)


def test_shingles_repeated_in_one_text_only():
    labels, offsets = shingles(pa.array(["a b a b a b", "c d e", "a b a b"]), 2)
    got = [labels[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert len(set(got[0])) == 5 and got[2] == got[0][:3] and not set(got[1]) & set(got[0])
