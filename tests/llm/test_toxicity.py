import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from terraloom.llm.toxicity import Tokens, marginals, score_lessons, train

SCHEMA = "toxic string, lesson_id bigint, body string, score int"
RUDE = ["bodohsekali", "Bodohlah", "idiot"]


def lessons(n, seed=0):
    rng = random.Random(seed)
    words = ["sawah", "peta", "danau", "jalan", "irigasi", "grid"] + [f"kata{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        ws = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(3):
                ws.insert(rng.randrange(len(ws)), rng.choice(RUDE))
        rows.append(("no", i, rng.choice([" ", "\n", "*** "]).join(ws), 1))
        labels.append((i, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = lessons(500)
    return train(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(3, None), (None, 1)], "lesson_id bigint, toxic int"))


def test_held_out_lessons_and_places(spark, model):
    rows, labels = lessons(300, seed=9)
    extra = [("x", 900, None, 1), ("x", 901, "", 1), ("x", 902, "...\n", 1), ("x", None, "peta idiot", 1), ("x", 903, "peta danau " * 30000 + "é idiot! Bodohlah", 1), ("x", 901, "", 1)]
    got = score_lessons(spark.createDataFrame(rows + extra, SCHEMA), model).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r["lesson_id"]: r for r in got}
    assert np.mean([by[i]["flagged"] == (t == 1) for i, t in labels]) > 0.97
    text = {i: b for _, i, b, _ in rows + extra}
    found = [text[i][p["first"] : p["after"]] for i, t in labels if t for p in by[i]["places"]]
    assert sum(any(r in f for r in RUDE) for f in found) / len(found) > 0.9
    assert [text[903][p["first"] : p["after"]] for p in by[903]["places"]] == ["idiot! Bodohlah"]
    assert by[900]["places"] == by[901]["places"] == by[902]["places"] == [] and not by[902]["flagged"]
    assert all(0 <= r["score"] <= 1 for r in got)


def test_marginals_against_all_paths():
    rng = np.random.default_rng(1)
    energy, at, n = rng.normal(size=9) * 2, np.array([0, 4, 5]), np.array([4, 1, 4])
    chain = rng.normal(size=(3, 2))
    p, pairs, log_z = marginals(energy, at, n, chain)
    want, want_pairs, want_z = np.zeros(9), np.zeros((2, 2)), 0.0
    for a, m in zip(at, n):
        paths = list(itertools.product([0, 1], repeat=m))
        weight = [np.exp(chain[2, y[0]] + sum(energy[a + t] * y[t] for t in range(m)) + sum(chain[y[t - 1], y[t]] for t in range(1, m))) for y in paths]
        want_z += np.log(sum(weight))
        for y, x in zip(paths, np.array(weight) / sum(weight)):
            want[a : a + m] += x * np.array(y)
            for t in range(1, m):
                want_pairs[y[t - 1], y[t]] += x
    assert p == pytest.approx(want) and pairs == pytest.approx(want_pairs) and log_z == pytest.approx(want_z)


def test_chains_cover_all_tokens():
    t = Tokens(pa.array(["a b\nc", None, "", "x " * 200, "É é"]))
    assert t.chain_n.sum() == len(t.starts) == 205 and t.chain_n.max() == 64
    assert t.word[-1] == t.word[-2]


def test_without_labels(spark):
    df = spark.createDataFrame(lessons(5)[0], SCHEMA)
    for labels, want in (([], 0.0), ([(1, 0), (2, 0)], 0.0), ([(1, 1)], 1.0)):
        got = score_lessons(df, train(df, spark.createDataFrame(labels, "lesson_id bigint, toxic int"))).collect()
        assert {r["score"] for r in got} == {want} and {tuple(r["places"]) for r in got} == {()}


def test_empty_table(spark, model):
    assert score_lessons(spark.createDataFrame([], SCHEMA), model).collect() == []
