"""Helpers for ordered and skewed work, on data where one key holds most rows."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terraloom import scale


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({"id": np.arange(n), "k": np.where(rng.random(n) < 0.6, "hot", rng.integers(0, 9, n).astype(str)),
                        "v": np.where(rng.random(n) < 0.4, 5.0, np.round(rng.normal(0, 10, n), 1))})
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_running_total(skewed):
    pdf, df = skewed
    got = scale.running_total(df, ["v", "id"], "id", ["k"]).toPandas().sort_values("id")
    want = pdf.sort_values(["v", "id"]).groupby("k")["id"].cumsum().sort_index()
    assert (got["running"].to_numpy() == want.to_numpy()).all()


def test_global_row_number(skewed):
    pdf, df = skewed
    got = scale.global_row_number(df, [F.desc("v"), "id"]).toPandas().sort_values("row_number")
    want = pdf.sort_values(["v", "id"], ascending=[False, True])["id"].to_list()
    assert got["row_number"].to_list() == list(range(1, len(pdf) + 1)) and got["id"].to_list() == want


def test_average_rank(skewed):
    pdf, df = skewed
    got = scale.average_rank(df, "v", ["k"]).toPandas().sort_values("id")["rank"]
    assert np.allclose(got, pdf.groupby("k")["v"].rank())


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_exact_percentiles(skewed, keys):
    pdf, df = skewed
    got = scale.exact_percentiles(df, "v", {"a": 0.02, "m": 0.5, "z": 0.98}, keys).toPandas()
    groups = pdf.groupby("k")["v"] if keys else [("all", pdf["v"])]
    for key, v in groups:
        row = got[got["k"] == key].iloc[0] if keys else got.iloc[0]
        assert np.allclose([row.a, row.m, row.z], np.percentile(v, [2, 50, 98]))


def test_materialize_uses_the_session_folder(spark):
    df = scale.materialize(spark.range(10))
    assert df.count() == 10 and scale.work_dir(spark) in df.inputFiles()[0]


def test_materialize_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before, setting = disk.getAllFiles().size(), spark.conf.get(scale.SHUFFLES_GO)
    made = scale.materialize(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count())
    for _ in range(50):
        if disk.getAllFiles().size() <= before:
            break
        time.sleep(0.1)
    assert disk.getAllFiles().size() <= before and spark.conf.get(scale.SHUFFLES_GO) == setting
    assert made.count() == 10
