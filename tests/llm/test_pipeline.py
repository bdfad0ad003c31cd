import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_near import brute_classes
from tests.llm.test_packing import cut, first_fit_decreasing
from tests.llm.test_substring import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = {"id": ["sawah", "peta", "danau", "irigasi", "jalan", "dan", "yang", "kelas"], "en": ["rice", "map", "lake", "water", "road", "and", "the", "class"]}


def documents():
    rng = random.Random(11)
    rows = []
    for i in range(80):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "s", "an", ",", "."]) for _ in range(rng.randrange(20, 90))), lang))
    passage = " ".join(rng.choice(WORDS["en"]) + str(k % 7) for k in range(30))
    rows += [(100 + i, rows[i][1] + " " + passage, rows[i][2]) for i in range(40, 44)]
    rows += [(200 + i, rows[i][1].replace(" ", "  "), rows[i][2]) for i in range(5)]  # copies up to white space
    rows += [(300 + i, rows[i][1] + " peta", rows[i][2]) for i in range(10, 15) if len(rows[i][1].split()) > 40]
    rows += [(400, None, "en"), (401, "", None), (402, "12345 !!", "en"), (None, "the lake and the map without an id", "en"), (7, rows[7][1], "en")]
    return [(i, t, lang, "src0", None if t is None else len(t)) for i, t, lang in rows]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    df = spark.createDataFrame(documents(), SCHEMA)
    out = [df]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, df, "").write.parquet(f"{folder}/{k}")
        df = spark.read.parquet(f"{folder}/{k}")
        out.append(df)
    return out


def rows_of(df):
    return sorted([(r["doc_id"], r["text"]) for r in df.collect()], key=repr)


def test_columns(steps):
    for df in steps[:-1]:
        assert df.dtypes == steps[0].dtypes


def test_language_drops_only_what_has_none(steps):
    assert set(rows_of(steps[0])) - set(rows_of(steps[1])) == {(400, None), (401, ""), (402, "12345 !!")}
    assert steps[1].count() == steps[0].count() - 3


def test_exact_copies(steps):
    best = {}
    for i, t in rows_of(steps[1]):
        k = " ".join(t.split())
        if k not in best or (i is not None and (best[k][0] is None or i < best[k][0])):
            best[k] = (i, t)
    assert rows_of(steps[2]) == sorted(best.values(), key=repr)


def test_near_copies(steps):
    rows = rows_of(steps[2])
    keep = {c for _, c, _ in brute_classes(rows)}
    assert rows_of(steps[3]) == [r for r in rows if r[0] in keep]
    assert steps[3].count() < steps[2].count()


def test_repeats_are_cut(steps):
    before = rows_of(steps[3])
    want = {i: (removed, kept) for i, _, removed, kept in brute(before, 13)}
    assert any(removed for removed, _ in want.values())
    assert rows_of(steps[4]) == sorted(((i, want[i][1] if want[i][0] else t) for i, t in before), key=repr)
    assert steps[4].where(F.length("text") != F.col("n_chars")).count() == 0


def test_packing(steps):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(cp.VOCABULARY)
    want = sorted(((i, k, s, n) for i, t in rows_of(steps[4]) for k, (s, n) in enumerate(cut(len(tool.encode(t, add_special_tokens=False).ids) + 1, 2048))), key=repr)
    got = steps[5].collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"]) for r in got), key=repr) == want
    assert len({r["sequence_id"] for r in got}) <= first_fit_decreasing([r["length"] for r in got], 2048)


def test_run(spark, tmp_path):
    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() > 0


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_with_clashing_names(spark):
    """Columns named like an operator's own go through every stage, empty tables and nulls too."""
    extra = "body string, lesson_id bigint, language string, kept boolean, n_removed bigint, bits double, other_5 string"
    rows = [(*r, "b", 1, "l", True, 2, 0.5, "o") for r in documents()[:60]] + [(None,) * 12]
    for some in (rows, []):
        docs = spark.createDataFrame(some, f"{SCHEMA}, {extra}")
        for name, stage in cp.STAGES[:-1]:
            got = stage(spark, docs, "")
            assert got.dtypes == docs.dtypes, name
            for r in got.collect():
                assert (r["body"], r["lesson_id"], r["language"], r["kept"], r["n_removed"], r["bits"], r["other_5"]) in {
                    ("b", 1, "l", True, 2, 0.5, "o"), (None,) * 7}, name
        assert cp.STAGES[-1][1](spark, docs, "").count() == len(some)


def test_kept_columns_named_like_results_are_refused(spark):
    from terraloom.llm import language, substring

    lessons = spark.createDataFrame([(1, "satu dua", "id", True)], "lesson_id bigint, body string, language string, Kept boolean")
    with pytest.raises(ValueError):
        substring.remove_repeats(lessons, keep=["Kept"])
    with pytest.raises(ValueError):
        language.identify(lessons.withColumnRenamed("Kept", "bits"), None, keep=["bits"])
