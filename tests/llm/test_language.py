import math
import random
import unicodedata
from collections import Counter

import pyarrow as pa
import pytest

from terraloom.llm.language import ORDER, UNDETERMINED, identify, train

SCHEMA = "language string, lesson_id bigint, body string, confidence int"
WORDS = {"id": ["sawah", "peta", "danau", "irigasi", "jalan", "dan", "yang", "kelas"], "en": ["rice", "map", "lake", "water", "road", "and", "the", "class"]}


def lessons(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        language = rng.choice(list(WORDS))
        out.append((language, i, " ".join(rng.choice(WORDS[language]) for _ in range(rng.randrange(3, 60))) + rng.choice([".", "!\n 12", ""]), 1))
    return out


def normal(text):
    out = "".join(c.lower() if unicodedata.category(c)[0] in "LM" else " " for c in text)
    return " ".join(out.split()) + (" " if out.endswith(" ") and out.strip() else "")


def brute_bits(rows, text):
    """Interpolated Kneser-Ney with dictionaries."""
    bits, alphabet = {}, {c for _, _, b, _ in rows for c in normal(b)}
    for language in sorted({r[0] for r in rows}):
        levels = [Counter() for _ in range(ORDER + 1)]
        for lang, _, b, _ in rows:
            t = " " * (ORDER - 1) + normal(b)
            for i in range(ORDER - 1, len(t)):
                levels[ORDER][t[i - ORDER + 1 : i + 1]] += lang == language
        levels[ORDER] = +levels[ORDER]
        for n in range(ORDER - 1, 0, -1):
            levels[n] = Counter(g[1:] for g in levels[n + 1])

        def p(g):
            n = len(g)
            if n == 0:
                return 1 / (len(alphabet) + 1)
            level = levels[n]
            n1, n2 = (sum(c == k for c in level.values()) for k in (1, 2))
            d = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
            same = [c for h, c in level.items() if h[:-1] == g[:-1]]
            if not same:
                return p(g[1:])
            return max(level[g] - d, 0) / sum(same) + d * len(same) / sum(same) * p(g[1:])

        t = " " * (ORDER - 1) + normal(text)
        grams = [t[i - ORDER + 1 : i + 1] for i in range(ORDER - 1, len(t))]
        bits[language] = -sum(math.log2(p(g)) for g in grams) / len(grams)
    return bits


@pytest.fixture(scope="module")
def trained(spark):
    rows = lessons(150)
    return rows, train(spark.createDataFrame(rows + [(None, 900, "no language", 1), ("en", 901, None, 1)], SCHEMA))


def test_bits_against_brute_force(trained):
    rows, models = trained
    texts = ["the map and the lake", "peta danau", "xyz quite unlike, ÉÀ", "a", "Water sawah 𐐨𐐩"]
    got, _, _ = models.bits(pa.array(texts))
    for text, row in zip(texts, got):
        want = brute_bits(rows, text)
        assert dict(zip(models.languages, row)) == pytest.approx(want, rel=1e-4)


def test_held_out_lessons_and_rejection(spark, trained):
    _, models = trained
    rows = lessons(200, seed=5)
    rows += [("zz", 500, "zqj vvkx qqq wzzx jjqv zzkq xxvj " * 20, 1), (None, 501, None, 1), ("en", 502, "", 1), ("en", 503, "123 !?\n", 1), (None, None, "the map and the lake", 1), ("en", 504, "the lake " * 30000, 1)]
    got = identify(spark.createDataFrame(rows, SCHEMA), models).collect()
    assert len(got) == len(rows)
    by = {r["lesson_id"]: r for r in got}
    assert all(by[i]["language_found"] == language and not by[i]["rejected"] for language, i, _, _ in rows[:200])
    assert by[500]["rejected"] and by[None]["language_found"] == by[504]["language_found"] == "en"
    for i in (501, 502, 503):
        assert (by[i]["language_found"], by[i]["confidence"], by[i]["bits"], by[i]["rejected"]) == (UNDETERMINED, 0, None, True)
    assert all(0 <= r["confidence"] <= 1 for r in got)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert train(empty) is None
    assert identify(empty, None).collect() == []
    assert [r["language_found"] for r in identify(spark.createDataFrame([("en", 1, "map", 1)], SCHEMA), None).collect()] == [UNDETERMINED]


def test_one_language(spark):
    rows = [r for r in lessons(60) if r[0] == "id"]
    models = train(spark.createDataFrame(rows, SCHEMA))
    assert {r["language_found"] for r in identify(spark.createDataFrame(rows, SCHEMA), models).collect()} == {"id"}


def test_limits_come_from_all_lessons(spark):
    rows = lessons(4300, seed=9)
    models = train(spark.createDataFrame(rows, SCHEMA).repartition(4))
    bits, n, _ = models.bits(pa.array([r[2] for r in rows]))
    for k, name in enumerate(models.languages):
        mine = [i for i, r in enumerate(rows) if r[0] == name and n[i]]
        own = sum(bits[i][k] * n[i] for i in mine) / sum(n[i] for i in mine)
        other = sum(min(b for j, b in enumerate(bits[i]) if j != k) * n[i] for i in mine) / sum(n[i] for i in mine)
        assert models.limit[k] == pytest.approx(own + max(0.5, (other - own) / 2), rel=1e-9)
